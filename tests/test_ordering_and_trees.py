import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import tree as tr
from spanloom.operators.compare import path_signatures, path_texts
from spanloom.operators import ordering
from spanloom.operators.ordering import nulls_last, parted, rank_within, running_total
from spanloom.operators.sequence import trace_order


def stamp(ms):
    return f"2024-01-01T{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}Z"


def test_positions_across_many_buckets(spark):
    rnd = random.Random(1)
    rows = [("hot", i, rnd.randrange(0, 10**6)) for i in range(400)] + [("cold", 1000 + i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, seq long, t long").withColumn("at", F.timestamp_seconds("t"))
    ranked = rank_within(
        df, ["g"], [F.col("at"), F.col("seq")], previous=["seq"]
    ).collect()
    for g in ("hot", "cold"):
        want = sorted((t, s) for gg, s, t in rows if gg == g)
        got = sorted((r["pos"], r["t"], r["seq"], r["prev"]["seq"] if r["prev"] else None) for r in ranked if r["g"] == g)
        assert [(t, s) for _, t, s, _ in got] == want
        assert [p for p, *_ in got] == list(range(1, len(want) + 1))
        assert [p for *_, p in got] == [None] + [s for _, s in want[:-1]]


@pytest.mark.parametrize("sent", [ordering.SENT_RANGES, 0])
def test_a_busy_minute_is_shared_by_all_tasks(spark, monkeypatch, sent):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 10_000)
    monkeypatch.setattr(ordering, "SENT_RANGES", sent)
    n = 200_000
    df = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("x"), F.col("id") % 700)).otherwise("hot").alias("g"),
        F.col("id").alias("seq"),
        # One moment holds a third of all rows, some have none.
        F.when(F.col("id") % 97 > 0, F.timestamp_micros(F.when(F.col("id") % 3 > 0, F.col("id") * 7919 % 60_000_000).otherwise(5))).alias("at"),
    )
    order = [*nulls_last("at"), F.col("seq")]
    sizes = [r["count"] for r in parted(df, ["g"], order).filter("g = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 2 * 10_000
    ranked = rank_within(df, ["g"], order, previous=["seq"])
    w = Window.partitionBy("g").orderBy(F.col("at").asc_nulls_last(), "seq")
    plain = df.select("seq", F.row_number().over(w).alias("want"), F.lag("seq").over(w).alias("want_prev"))
    bad = ranked.join(plain, "seq").filter("pos <> want OR NOT (prev.seq <=> want_prev)")
    assert bad.isEmpty() and ranked.count() == n


def test_running_total(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(1000), i, rnd.randrange(10)) for i in range(500)]
    got = running_total(spark.createDataFrame(rows, "a int, b int, n long"), ["a", "b"], "n").collect()
    total, want = 0, {}
    for a, b, n in sorted(rows):
        want[a, b] = total
        total += n
    assert {(r["a"], r["b"]): r["before"] for r in got} == want
    assert running_total(spark.createDataFrame([], "a int, n long"), ["a"], "n").collect() == []


def test_trace_order_puts_spans_without_start_last(make_spans):
    s = make_spans({"ts_start": None}, {"ts_start": stamp(5)}, {"ts_start": stamp(1)}, {"ts_start": None})
    got = {r["span_id"]: r["pos"] for r in trace_order(s).collect()}
    assert got == {"s2": 1, "s1": 2, "s0": 3, "s3": 4}


def test_tree_depth_and_detached_branches(make_spans):
    chain = [{"parent_span_id": f"s{i - 1}" if i else None} for i in range(9)]
    lost = [{"span_id": "l0", "parent_span_id": "nowhere"}, {"span_id": "l1", "parent_span_id": "l0"}]
    tree = tr.resolve(make_spans(*chain, *lost))
    got = {r["span_id"]: r for r in tr.tree_nodes(tree).collect()}
    assert [got[f"s{i}"]["depth"] for i in range(9)] == list(range(9))
    assert all(got[f"s{i}"]["root"] == "s0" and got[f"s{i}"]["attached"] for i in range(9))
    assert got["l1"]["root"] == "l0" and not got["l1"]["attached"] and got["l1"]["depth"] == 1
    assert len(tree.jumps) == 4  # jumps of 1, 2, 4 and 8


def test_ancestors_and_descendants(spark, make_spans):
    chain = [{"parent_span_id": f"s{i - 1}" if i else "outside"} for i in range(7)]
    tree = tr.resolve(make_spans(*chain, {"span_id": "b", "parent_span_id": "s2"}))
    seeds = spark.createDataFrame([("t", "s3")], "exec_id string, seed string")
    up = {(r["span_id"], r["distance"]) for r in tr.ancestors(tree, seeds).collect()}
    assert up == {("s2", 1), ("s1", 2), ("s0", 3)} or up == {("s2", 1), ("s1", 2), ("s0", 3), ("outside", 4)}
    down = [(r["span_id"], r["distance"]) for r in tr.descendants(tree, seeds).collect()]
    assert sorted(down) == [("s4", 1), ("s5", 2), ("s6", 3)]


def test_cycles_end(make_spans):
    s = make_spans(
        {"parent_span_id": None}, {"parent_span_id": "s2"}, {"parent_span_id": "s1"}, {"parent_span_id": "s0"}
    )
    got = {r["span_id"]: r for r in tr.tree_nodes(tr.resolve(s)).collect()}
    assert got["s3"]["depth"] == 1 and got["s1"]["depth"] is None and not got["s2"]["attached"]


def _brute_critical(rows, strict=True):
    kids, dur = {}, {}
    for r in sorted(rows, key=lambda r: (r["start"], r["i"])):
        kids.setdefault(r["parent"], []).append(r["id"])
    for r in rows:
        dur[r["id"]] = r["ms"]

    def best(node):
        value, way = 0, []
        for child in kids.get(node, []):
            v, w = best(child)
            if v > value:
                value, way = v, w
        if node not in kids:
            return dur[node], [node]
        return dur[node] + value, [node] + way if way else []

    top, path = 0, []
    for root in kids.get(None, []):
        v, w = best(root)
        if v > top:
            top, path = v, w
    return set(path)


def test_critical_path_matches_a_walk_over_random_trees(make_spans):
    rnd = random.Random(7)
    everything, want = [], {}
    for t in range(25):
        rows = []
        for i in range(rnd.randrange(1, 14)):
            parent = None if i == 0 or rnd.random() < 0.1 else f"{t}-{rnd.randrange(i)}"
            rows.append({"id": f"{t}-{i}", "parent": parent, "start": rnd.randrange(5), "i": i, "ms": rnd.choice([0, 0, 1, 2, 3, 3])})
        want[f"x{t}"] = _brute_critical(rows)
        for r in rows:
            everything.append(
                {"span_id": r["id"], "parent_span_id": r["parent"], "exec_id": f"x{t}",
                 "ts_start": stamp(r["start"]), "ts_end": stamp(r["start"] + r["ms"])}
            )
    tree = tr.resolve(make_spans(*everything))
    got = {k: set() for k in want}
    for r in tr.critical_path(tree).collect():
        got[r["exec_id"]].add(r["span_id"])
    assert got == want


def test_signature_ignores_retry_count_but_not_order(make_spans):
    a = [{"component": "a", "ts_start": stamp(1)}, {"component": "b", "ts_start": stamp(2)}]
    b = [{"component": "a", "ts_start": stamp(1)}, {"component": "b", "ts_start": stamp(2), "attempt": 3}]
    c = [{"component": "b", "ts_start": stamp(1)}, {"component": "a", "ts_start": stamp(2)}]
    rows = [dict(r, exec_id=e, span_id=f"{e}{i}") for e, part in (("1", a), ("2", b), ("3", c)) for i, r in enumerate(part)]
    got = {r["exec_id"]: r for r in path_signatures(make_spans(*rows)).collect()}
    assert got["1"]["path_key"] == got["2"]["path_key"] != got["3"]["path_key"]
    assert got["2"]["retries"] == 2


def test_signature_without_times_goes_by_id(make_spans):
    s = make_spans({"span_id": "z", "component": "c"}, {"span_id": "a", "component": "d"})
    got = path_texts(s, path_signatures(s)).collect()
    assert [r["step"] for r in sorted(got, key=lambda r: r["pos"])] == ["d:op", "c:op"]


def test_plans_of_deep_trees_grow_with_the_logarithm(spark, make_spans):
    chain = [{"parent_span_id": f"s{i - 1}" if i else None, "ts_start": stamp(i), "ts_end": stamp(i + 1)} for i in range(150)]
    tree = tr.resolve(make_spans(*chain))
    seeds = spark.createDataFrame([("t", "s149")], "exec_id string, seed string")
    for df in (tr.critical_path(tree), tr.ancestors(tree, seeds), tr.descendants(tree, seeds)):
        assert df._jdf.queryExecution().analyzed().toString().count("Join ") < 12
    assert tr.critical_path(tree).count() == 150 and tr.ancestors(tree, seeds).count() == 149
