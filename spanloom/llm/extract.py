"""Main text of web pages by a site style tree.

The pages of a host are laid over each other, whole: articles, menus, comments and notices
alike. A node of the tree is a path of elements with their classes and roles (elements
without any are told apart by their places); it knows in how many presentations it comes
(sequences of children) and in how many contents. Both have an entropy: how evenly the
pages that have the node spread over them. A node's own importance is the mean of the two,
less the share of its text that is links; its importance weighs its children in. Counts
are Spark aggregations over (host, path, hash), with one row for each page and path, and
copies of a page count once.

What the tree finds low is removed first: what is the same on all pages, what is links,
and whole branches that are far less important than the one beside them (a slot that is
always built alike, next to an article that is not). Entropy cannot see reader comments,
nor anything on a host of few pages. What elements say of themselves is a prior for that:
menus, adverts, comments or forms by name, role or class are worth nothing at any
entropy. Where an element says that it is the article, only what is in it counts, and
its headings and paragraphs stay at any entropy, since pages may be copies of each other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.rows import stored


# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("head script style noscript template iframe object svg math canvas audio video map select datalist textarea button form fieldset dialog".split())
ASIDE = set("nav header footer aside menu menuitem".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "legend", "option", "optgroup", "summary", "figcaption", "body", "html"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class names and ids that say what an element is.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toc sidebar sidebars aside rail widget widgets "
    "header masthead footer foot copyright legal cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments respond "
    "disqus replies reply tags tagcloud skip search".split()
)
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "label", "parent", "tag", "worth")

    def __init__(self, tag: str, label: str, parent: Node | None, worth: int):
        self.tag, self.label, self.parent, self.worth = tag, label, parent, worth
        self.children: list[Node | str] = []


class _Tree(HTMLParser):
    """A page as nodes; forgiving about what is not closed."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None, 1)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "li", "div", "article", "section", "table", "button", "body"})
        if tag == "li":
            self._close({"li"}, {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            self._close({"dd", "dt"}, {"dl"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"table", "tr"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        elif tag == "option":
            self._close({"option"}, {"select"})
        elif tag == "body":
            self._close({"head"}, set())
        given = dict(attrs)
        own = {w.lower() for k in ("class", "id") for w in _WORD.findall(given.get(k) or "")}
        role = (given.get("role") or "").lower()
        hidden = "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        worth = 0
        if tag in SILENT or hidden:
            worth = -2
        elif tag in ASIDE or role in ROLES or (own & NAMES and tag not in ("html", "body", "article", "main")):
            worth = -1
        elif tag in ("article", "main") or role in ("main", "article"):
            worth = 1
        label = tag + "".join(f".{w}" for w in sorted(own)) + (f"[{role}]" if role else "")
        node = Node(tag, label, self.at, worth)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            # An inline end tag does not close blocks.
            if tag not in BLOCK and tag not in SILENT and node.tag in BLOCK:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def blocks(root: Node, removed: set[int]) -> list[str]:
    """The text of the nodes that stay, one entry for each block, in page order."""
    out, open_ = [], []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(open_)).strip()
        open_.clear()
        if text:
            out.append(text)

    # (node or text, whether it has been entered)
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        x, entered = todo.pop()
        if isinstance(x, str):
            open_.append(x)
        elif entered:
            end()
        elif id(x) not in removed:
            if x.tag in BLOCK:
                end()
                todo.append((x, True))
            elif x.tag == "br":
                open_.append(" ")
            todo.extend((c, False) for c in reversed(x.children))
    end()
    return out


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


#: Stay inside of what says that it is the article.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "article", "main", "section"}
#: Hold parts of a page; without a name they are told apart by their places.
CONTAINERS = {"div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "table", "form", "center", "dl"}


def branches(root: Node) -> list[tuple[Node, int, int]]:
    """(node, its path, the path of the branch around it) in page order; the path of what
    is no block is that of the branch around it."""
    out: list[tuple[Node, int, int]] = []
    todo = [(root, 0, 0)]
    while todo:
        node, path, around = todo.pop()
        out.append((node, path, around))
        below = [c for c in node.children if isinstance(c, Node)]
        alike = Counter(c.label for c in below)
        place: Counter[str] = Counter()
        named = []
        for c in below:
            if c.tag not in BLOCK or c.tag in ("html", "body"):
                named.append((c, path, around))
                continue
            place[c.label] += 1
            own = f"{c.label}#{place[c.label]}/{alike[c.label]}" if c.label == c.tag and c.tag in CONTAINERS else c.label
            named.append((c, _hash(f"{path}/{own}"), path))
        todo.extend(reversed(named))
    return out


def _facts(root: Node) -> Iterator[tuple[int, int, bool, int, int, int, int]]:
    """(path, path around, whether it is a container, presentation, content, characters,
    characters in links) of each path of a page. Nodes of one path are taken together."""
    nodes = branches(root)
    # From the leaves up: (hash of the text below, its characters, those in links).
    sums: dict[int, tuple[int, int, int]] = {}
    for node, _, _ in reversed(nodes):
        if node.worth == -2:
            sums[id(node)] = (0, 0, 0)
            continue
        parts, n, linked = [], 0, 0
        for c in node.children:
            if isinstance(c, str):
                plain = _SPACE.sub(" ", c).strip()
                parts.append(plain)
                n += len(plain)
            else:
                content, own, own_linked = sums[id(c)]
                parts.append(str(content))
                n += own
                linked += own_linked
        sums[id(node)] = (_hash("\0".join(parts)) if n else 0, n, n if node.tag == "a" else linked)
    found: dict[int, list] = {}
    for node, path, around in nodes:
        if node.tag in BLOCK and node.tag not in ("html", "body") and node.worth > -2:
            at = found.setdefault(path, [around, node.tag in CONTAINERS, [], [], 0, 0])
            content, n, linked = sums[id(node)]
            at[2].append(" ".join(c.label for c in node.children if isinstance(c, Node) and c.tag in BLOCK))
            at[3].append(str(content))
            at[4] += n
            at[5] += linked
    for path, (around, container, shapes, contents, n, linked) in found.items():
        yield path, around, container, _hash("|".join(shapes)), _hash("|".join(contents)), n, linked


def tree_removes(root: Node, low: set[int], slots: set[int]) -> list[Node]:
    """The nodes that go by the tree alone. Inside of what says that it is the article,
    prose stays, and so does what is only less important than its neighbours."""
    inside: dict[int, bool] = {}
    out = []
    for node, path, _ in branches(root):
        article = node.worth > 0 or (node.parent is not None and inside[id(node.parent)])
        inside[id(node)] = article and node is not root
        block = node.tag in BLOCK and node.tag not in ("html", "body")
        declared = inside[id(node)]
        if block and (path in low and not (declared and (node.tag in PROSE or node.worth > 0)) or path in slots and not declared):
            out.append(node)
    return out


def _kept(root: Node, low: set[int], slots: set[int]) -> list[str]:
    """Blocks of a page without the branches of low importance."""
    some = {id(node) for node in tree_removes(root, low, slots)} if low or slots else set()
    removed, todo, articles = set(), [root], []
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, Node):
                if c.worth < 0:
                    removed.add(id(c))
                else:
                    if c.worth > 0:
                        articles.append(c)
                    todo.append(c)
    if articles:
        # What says that it is the article; one inside another counts once.
        inside = {id(x) for x in articles}
        out: list[str] = []
        for a in sorted(articles, key=lambda a: _place(a)):
            up = a.parent
            while up is not None and id(up) not in inside:
                up = up.parent
            if up is None:
                out += blocks(a, removed | some) or blocks(a, removed)
        if out:
            return out
    return blocks(root, removed | some) or blocks(root, removed)


def _place(node: Node) -> tuple[int, ...]:
    at = []
    while node.parent is not None:
        at.append(next(i for i, c in enumerate(node.parent.children) if c is node))
        node = node.parent
    return tuple(reversed(at))


#: Nats of variety (four presentations, equally often) from which on presentations count in full.
FULL_VARIETY = 1.3863


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, around, container, pages, chars, linked, repeated, importance) of each
    node of the style trees of ``pages`` (host, html).

    ``repeated`` is one less the greater entropy, contents' or presentations'. Entropies are
    divided by their greatest possible values; that of presentations counts in full from
    ``FULL_VARIETY`` on. ``importance`` is half the node's own and half the mean of its
    children's own, weighted by their characters; without children it is the node's own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.int64()), ("around", pa.int64()), ("container", pa.bool_()), ("shape", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("linked", pa.int64())]))
        names = [f.name for f in kind.value_type]
        for batch in batches:
            htmls = batch.column("html").to_pylist()
            facts = [[dict(zip(names, x, strict=True)) for x in _facts(tree(h))] for h in htmls]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([_hash(h) for h in htmls], pa.int64()), pa.array(facts, kind)], names=["host", "page", "facts"])

    fact = "struct<path: long, around: long, container: boolean, shape: long, content: long, n: long, linked: long>"
    found = pages.select("host", "html").mapInArrow(work, f"host string, page long, facts array<{fact}>")
    # Copies of a page say nothing about its host.
    once = found.groupBy("host", "page").agg(F.first("facts").alias("facts"))
    facts = stored(once.select("host", F.inline("facts")), "branches")

    def spread(what: str) -> DataFrame:
        """Entropy H = log N - (sum n log n) / N over the pages of a path."""
        each = facts.groupBy("host", "path", "around", "container", what).agg(F.count("*").alias("k"), F.sum("n").alias("chars"), F.sum("linked").alias("linked"))
        return each.groupBy("host", "path").agg(
            F.first("around").alias("around"), F.bool_or("container").alias("container"),
            F.sum("k").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
            (F.log(F.sum("k")) - F.sum(F.col("k") * F.log("k")) / F.sum("k")).alias(what),
        )

    most = F.log(F.greatest("pages", F.lit(2)))
    both = spread("content").join(spread("shape").select("host", "path", "shape"), ["host", "path"])
    own = both.select(
        "host", "path", "around", "container", "pages", "chars", "linked",
        (F.col("content") / most).alias("content"), (F.col("shape") / most).alias("even_shape"),
        F.least(F.lit(1.0), F.col("shape") / F.least(most, F.lit(FULL_VARIETY))).alias("shape"),
    ).withColumn("own", (F.col("content") + F.col("shape")) / 2 * (1 - F.coalesce(F.try_divide("linked", "chars"), F.lit(0.0))))
    own = stored(own, "importances")
    children = own.filter("path <> around").groupBy("host", F.col("around").alias("path")).agg(
        F.try_divide(F.sum(F.col("own") * F.col("chars")), F.sum("chars")).alias("below")
    )
    return own.join(children, ["host", "path"], "left").select(
        "host", "path", "around", "container", "pages", "chars", "linked", (1 - F.greatest("content", "even_shape")).alias("repeated"),
        F.when(F.col("below").isNull(), F.col("own")).otherwise((F.col("own") + F.col("below")) / 2).alias("importance"),
    )


def low_branches(pages: DataFrame, least_pages: int = 3, least_importance: float = 0.3, most_linked: float = 0.6, least_share: float = 0.7) -> DataFrame:
    """(host, path, slot): branches of a host's style tree that are not important.

    These have entropies below ``least_importance``, or are links for the most part, or
    (``slot``) are containers of less than ``least_share`` of the importance of the
    most important container beside them, which also has more text. A branch on fewer
    than ``least_pages`` pages is not judged.
    """
    found = importances(pages).filter(F.col("pages") >= least_pages)
    top = found.filter("container").groupBy("host", "around").agg(F.max(F.struct("importance", "chars")).alias("top"))
    judged = found.join(top, ["host", "around"], "left")
    low = (F.col("repeated") > 1 - least_importance) | (F.col("linked") > most_linked * F.col("chars"))
    slot = F.col("container") & (F.col("importance") < least_share * F.col("top.importance")) & (F.col("chars") < F.col("top.chars"))
    return judged.filter(low | slot).select("host", "path", (~low).alias("slot"))


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` in ``row``, with ``text``: the main text's blocks joined by
    a line feed (empty if there is none).

    Null html is empty. A page whose url has no host (or null) is of host "". Repeated
    pages count once in the tree. Text outside of any block is a block.
    """
    given = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
        F.coalesce(F.regexp_extract(F.lower(F.col(f"`{url_col}`").cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")).alias("host"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    # One row for each host, with the hashes of branches that templates repeat.
    paths = low_branches(given).groupBy("host").agg(
        F.collect_set(F.when(~F.col("slot"), F.col("path"))).alias("low"), F.collect_set(F.when(F.col("slot"), F.col("path"))).alias("slots")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, low, slots = (batch.column(c).to_pylist() for c in ("html", "low", "slots"))
            text = ["\n".join(_kept(tree(h), set(x or ()), set(y or ()))) for h, x, y in zip(html, low, slots, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], names=["row", "text"])

    schema = T.StructType([given.schema["row"], T.StructField("text", T.StringType())])
    return given.join(paths, "host", "left").select("row", "html", "low", "slots").mapInArrow(work, schema)
