"""Recall against brute force, and vectors that take no part."""

import numpy as np

from spanloom.llm import neighbours
from spanloom.llm.queries import QUERIES


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        scores = x @ x[ids.index(q)]
        order = sorted((-s, i) for i, s in zip(ids, scores) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def test_recall_on_the_test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in QUERIES["op8_cross_polytope"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert set(got) == set(want)
    hit = 0
    for q, list_ in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(s - x[ids.index(q)] @ x[ids.index(v)]) < 1e-12 for _, v, s in mine)
        hit += len({i for i, _ in list_} & {v for _, v, _ in mine})
    print("recall", hit / (20 * len(want)))
    assert hit / (20 * len(want)) >= 0.93


def test_lengths_differ(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24)) * rng.choice([0.1, 1.0, 3.0], 600)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=5).collect()
    want = brute(list(range(600)), x, range(0, 600, 20), 5)
    hit = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in got)
    assert hit / 150 >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [2.0, 0.0]), (20, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [None, 1.0]), (None, [1.0, 1.0]), (11, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=2).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0)]
    none = df.limit(0)
    assert neighbours.nearest(none, none).collect() == []


def full_lists(spark, x, k=20):
    """Ranks and ids found for each query, all ids being queries."""
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {i: [] for i in range(len(x))}
    for r in sorted(neighbours.nearest(df, df, k=k).collect()):
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    return got


def test_few_vectors_are_all_found(spark):
    x = np.random.default_rng(3).normal(size=(15, 64))
    got = full_lists(spark, x)
    print("rows of each query", sorted(len(v) for v in got.values()))
    want = brute(list(range(15)), x, range(15), 20)
    assert got == {q: [(n + 1, i) for n, (i, _) in enumerate(list_)] for q, list_ in want.items()}


def test_lone_queries_beside_a_large_group(spark):
    rng = np.random.default_rng(4)
    lone, centre = rng.normal(size=(10, 64)), rng.normal(size=64)
    x = np.concatenate([lone, centre + 1e-3 * rng.normal(size=(5000, 64))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {i: [] for i in range(10)}
    for r in sorted(neighbours.nearest(df, df.filter("vec_id < 10"), k=20).collect()):
        got[r["query_id"]].append(r["rank"])
    print("rows of each query", sorted(map(len, got.values())))
    assert all(ranks == list(range(1, 21)) for ranks in got.values())


def test_groups_are_bounded_on_both_sides(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(400, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = lambda: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, df, k=10).collect())
    want = rows()
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    grouped = type(df).groupBy
    sizes = []

    def counted(df, *cols):
        if any(isinstance(c, str) and c == "part" for c in cols):
            sizes.append(max([r["count"] for r in grouped(df, *cols).count().collect()], default=0))
        return grouped(df, *cols)

    monkeypatch.setattr(type(df), "groupBy", counted)
    got = rows()
    print("largest groups", sizes)
    assert got == want
    assert len(sizes) >= 2 and max(sizes) <= 48


def test_equal_vectors_come_in_the_order_of_their_ids():
    rng = np.random.default_rng(6)
    wrong = 0
    for n in (21, 203, 333, 1000):
        for dim in (7, 64, 100):
            v, q = rng.normal(size=dim), rng.normal(size=dim)
            x = np.repeat(v[None], n, axis=0)
            ids, longest = np.arange(n), np.sqrt((x * x).sum(axis=1).max())
            best, score = neighbours._best(ids, x, longest, q, (q[None] @ x.T)[0], 20, -1)
            wrong += best.tolist() != list(range(20)) or len(set(score)) > 1
            # The same scores out of any block.
            alone = [neighbours._best(ids[i : i + 3], x[i : i + 3], longest, q, (q[None] @ x[i : i + 3].T)[0], 20, -1)[1] for i in (0, 5)]
            wrong += set(np.concatenate(alone)) != set(score)
    assert wrong == 0
