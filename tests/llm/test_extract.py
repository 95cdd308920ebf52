"""Pages with known articles."""

import html
import re
from collections import Counter

from spanloom.llm import extract
from spanloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def article(page):
    body = re.search(r"<article.*?</article>", page or "", re.S)[0]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>|</?b>", " ", p))).strip() for p in re.split(r"</?(?:p|h1|article)>", body)]
    return "\n".join(p for p in parts if p)


def test_articles_of_the_test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op7_style_tree"](spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: article(v) for k, v in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def run(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")
    return {r["row"]["page_id"]: r["text"] for r in extract.main_text(df).collect()}


def test_branches_that_a_site_repeats_are_removed(spark):
    page = "<div class=top>Site of everything</div><div class=links><a href=/{i}>go {i}</a> <a>and {i}</a></div><div class=b><h2>Title {i}</h2><p>Text {i} &lt;here&gt;<p>more{i}</div><div class=c>All rights</div>"
    got = run(spark, [("http://A.org/x", page.format(i=i)) for i in range(12)] + [("http://b.org/", page.format(i=99))])
    assert got[3] == "Title 3\nText 3 <here>\nmore3"
    # Nothing is known about a host with one page.
    assert got[12].startswith("Site of everything") and got[12].endswith("All rights")


def _one_site(spark, pages):
    return spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in pages.items()], "page_id long, url string, html string")


def test_the_tree_alone_finds_the_articles(spark):
    """Names are taken away: no class, no id, no role, and every block container a div."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    bare = {k: re.sub(r"<(/?)(?:nav|article|footer|aside|header|main|section|div)\b[^>]*>", r"<\1div>", v) for k, v in pages.items()}
    got = {r["row"]["page_id"]: r["text"] for r in extract.main_text(_one_site(spark, bare)).collect()}
    right = [got[k] == article(v) for k, v in pages.items()]
    assert sum(right) >= 0.95 * len(right)


def test_the_tree_removes_nodes_of_the_test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    site = _one_site(spark, pages).selectExpr("'a.org' AS host", "html")
    found = extract.low_branches(site).collect()
    low, slots = ({r["path"] for r in found if r["slot"] is x} for x in (False, True))
    tags = Counter(n.tag if n.label == n.tag else n.label for h in pages.values() for n in extract.tree_removes(extract.tree(h), low, slots))
    assert min(tags["nav"], tags["div.ad"], tags["footer"]) == len(pages)
    assert not tags.keys() & {"article", "p", "h1"}


def test_what_elements_say_of_themselves(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>H</header><div class="cookie-notice">We use</div>
    <div id=main><h1>A &amp; B</h1><p>One <i>two</i>three<br>four
      five <p>six<ul><li>x<li>y</ul><div class="share">tweet</div><table><tr><td>1<td>2</table><form>Name</form>
    <script>var a = "<p>no</p>";</script></div><div class="comments"><p>nice</div><footer>F</footer>"""
    assert run(spark, [(None, page)])[0] == "A & B\nOne twothree four five\nsix\nx\ny\n1\n2"


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    got = run(spark, [(None, None), ("x", ""), ("http://c.org", "plain  text"), ("http://c.org", "<p>a<p>"), ("http://d.org", deep), ("http://e.org", "<nav>only</nav>"), ("http://f.org", "<<<>&#x;&amp")])
    assert [got[i] for i in range(6)] == ["", "", "plain text", "a", "deep", ""]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.main_text(empty).collect() == []
