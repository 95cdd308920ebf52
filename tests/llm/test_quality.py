"""Held-out accuracy, the exchange of pseudo-labels, and odd rows."""

import numpy as np

from spanloom.llm import quality
from spanloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = QUERIES["op9_co_training"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    print("kept", (good.predicted == 1).mean(), "dropped", (bad.predicted == 0).mean())
    assert (good.predicted == 1).mean() > 0.95 and (bad.predicted == 0).mean() > 0.8


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 60).astype(np.float32)
    hidden = rng.integers(0, 2, 2000).astype(np.float32)
    view = lambda y: np.column_stack([y * 2 - 1 + rng.normal(size=len(y)) * 0.7, np.ones(len(y))]).astype(np.float32)
    kept = np.arange(60) % 4 == 0
    model = quality.co_train(view(label), view(label), label, np.ones(60, np.float32), kept, (view(hidden), view(hidden)))
    assert sum(model.exchanged) > 200
    test = rng.integers(0, 2, 3000).astype(np.float32)
    assert (((model.logit(view(test), view(test))) > 0) == test).mean() > 0.95


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "co_train", lambda *given: seen.append((len(given[0]), len(given[5][0]))))
    known = [(i, f"text {i}", "en", "s") for i in range(200)]
    empty = spark.range(100_000).selectExpr("CAST(null AS BIGINT) AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same' END AS text", "CAST(null AS STRING) AS lang", "'s' AS source")
    again = spark.range(30_000).selectExpr("7L AS doc_id", "concat('again ', id) AS text", "'en' AS lang", "'s' AS source")
    docs = spark.createDataFrame(known, "doc_id long, text string, lang string, source string").unionByName(empty).unionByName(again)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    quality.train(docs, labels, sample=500, pool=400)
    assert seen and sum(seen[0]) <= 4 * 500 + 2 * 400 and seen[0][0] > 0


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad bad bad", "en", "s") for i in range(80)] + [(None, None, None, None), (1, "", None, "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs.selectExpr("*", "1 as score2"), model).collect()
    assert len(got) == 82 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.train(docs, labels.filter("quality = 1")) is None
    assert quality.train(docs.limit(0), labels) is None
    assert quality.score(docs.limit(0), model).collect() == []
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
