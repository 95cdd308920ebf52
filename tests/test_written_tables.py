"""Pruned span tables, bundles that appear whole, and searches that spare distances."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanloom.operators import profile as pf
from spanloom.operators.chains import chain_entries, with_payload
from spanloom.sources import bundles, logs, tables


def scanned_rows(df):
    """Rows that the file scans of a query that has run put out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        while leaf.nodeName().endswith("QueryStage"):
            below = leaf.plan().collectLeaves()
            leaf = below.apply(0)
        total += leaf.metrics().apply("numOutputRows").value()
    return total


@pytest.fixture(scope="module")
def spans(spark):
    n = 40_000
    return spark.range(n).select(
        F.col("id").alias("seq"), F.concat(F.lit("s"), "id").alias("span_id"),
        F.md5(F.expr("id DIV 5").cast("string")).alias("trace_id"), F.md5(F.concat(F.lit("r"), F.expr("id DIV 3"))).alias("request_id"),
        F.when(F.col("id") % 2 == 0, F.md5(F.concat(F.lit("a"), "id"))).alias("agent_session_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 10).alias("start_at"),
        F.when(F.col("id") % 1000 > 0, F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 10)).alias("logged_at"),
    )


@pytest.fixture(scope="module")
def written(spark, spans, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spans") / "t")
    tables.write_span_table(spans, path, group_bytes=1 << 15, distinct=2000)
    return path


def test_ids_skip_row_groups(spark, spans, written):
    one = spans.filter("seq = 777").first()
    got = tables.find_spans(spark, written, [one["trace_id"]], [one["request_id"]], [])
    ids = [r["seq"] for r in got.collect()]
    assert ids == [r["seq"] for r in logs.spans_by_id(spans, [one["trace_id"]], [one["request_id"]], []).collect()] and 777 in ids
    assert scanned_rows(got) < spans.count() / 2
    many = [r["trace_id"] for r in spans.filter("seq < 200").select("trace_id").distinct().collect()]
    assert [r["seq"] for r in tables.find_spans(spark, written, many).collect()] == list(range(200))
    assert tables.find_spans(spark, written, []).collect() == [] and tables.find_spans(spark, written).count() == spans.count()


def test_windows_read_their_days(spark, spans, written):
    start, end = datetime(2024, 1, 2, 12), datetime(2024, 1, 3, 6)
    got = tables.read_span_table(spark, written, start, end)
    want = spans.filter(F.col("logged_at").between(F.lit(start), F.lit(end)))
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in want.collect()) and "day" not in got.columns
    assert scanned_rows(got) <= 2 * 8640
    assert tables.read_span_table(spark, written).count() == spans.count()


def test_chains_come_with_their_lines_and_facts(spark, tmp_path):
    asked = [1, 2, 1, 3, 2, 1]
    rows = [(i, f'{{"message": "session_id=sess-{r}-long mail a@b.org", "timestamp": "2024-01-01T00:00:0{i}Z", "appname": "app{i % 2}"}}') for i, r in enumerate(asked)]
    lines = spark.createDataFrame(rows, "seq long, line string")
    entries = pf.log_entries(logs.scan_log_lines(lines).select("seq", "json"))
    path = str(tmp_path / "chains")
    bundles.write_chains(with_payload(chain_entries(entries), entries), lines, path)
    facts = bundles.manifest(spark, path)["facts"]
    assert (facts["entries"], facts["chains"]) == (5, 2)
    raw = bundles.read_bundle(spark, path, "lines").collect()
    assert sorted((r["chain_id"], r["seq"]) for r in raw) == [("chain-0", 0), ("chain-0", 2), ("chain-0", 5), ("chain-1", 1), ("chain-1", 4)]
    assert all("[EMAIL_REDACTED]" in r["line"] and "sess-" in r["line"] for r in raw)
    found = bundles.read_bundle(spark, path, "spans").collect()
    assert sorted(r["span_id"] for r in found) == ["chain-0-0", "chain-0-1", "chain-0-2", "chain-1-0", "chain-1-1"]
    assert {r["chain_id"]: r["entries"] for r in bundles.read_bundle(spark, path, "chains").collect()} == {"chain-0": 3, "chain-1": 2}


def test_a_bundle_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        bundles.manifest(spark, path)
    small = spark.range(6).select("id", (F.col("id") % 2).alias("part"))
    first = bundles.write_bundle(spark, path, {"a": small, "b": small.limit(1)}, "part", {"n": 6})
    found = bundles.manifest(spark, path)
    assert found["version"] == first and found["facts"] == {"n": 6}
    assert (found["outputs"]["a"]["rows"], found["outputs"]["a"]["files"]) == (6, len(list((tmp_path / "out" / first / "a").glob("part=*/*.json"))))
    bad = small.select("id", F.when(F.col("id") > 3, F.raise_error(F.lit("broken"))).otherwise(F.col("part")).alias("part"))
    with pytest.raises(Exception, match="broken"):
        bundles.write_bundle(spark, path, {"a": small.limit(2), "b": bad}, "part")
    # What was there is still there, whole.
    assert bundles.manifest(spark, path)["version"] == first
    assert sorted((r["id"], r["part"]) for r in bundles.read_bundle(spark, path, "a").collect()) == [(i, i % 2) for i in range(6)]
    second = bundles.write_bundle(spark, path, {"a": small.limit(2)}, "part")
    assert bundles.read_bundle(spark, path, "a").count() == 2
    left = {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert left == {first, second, "_current"}


def test_fuzzy_search_is_that_of_all_distances(spark):
    import random

    rnd = random.Random(4)
    names = ["".join(rnd.choice("renda") for _ in range(rnd.randint(0, 9))) for _ in range(400)] + ["render", "Rander", "renderer", "xrendery", ""]
    df = spark.createDataFrame([(n, None, None) for n in names], "operation string, component string, span_id string")
    for text, k in [("Render", 2), ("render", 1), ("ab", 2), ("", 1), ("renderrender", 3)]:
        low = text.lower()
        near = F.contains(F.lower("operation"), F.lit(low)) | (F.levenshtein(F.lower("operation"), F.lit(low)) <= k)
        want = sorted(r[0] for r in df.filter(near).collect())
        assert sorted(r[0] for r in logs.search_spans(df, text, fuzzy=k).collect()) == want, (text, k)
