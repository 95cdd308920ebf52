"""Held-out accuracy, tables against plain convolution, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import toxicity
from spanloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    got = QUERIES["op3_toxic_conv"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.predicted == 1).sum() > 0.85 and hit / (got.toxic == 1).sum() > 0.7
    assert got.score.between(0, 1).all()


def test_tables_give_the_maxima_of_plain_filters():
    rng = np.random.default_rng(4)
    n = np.array([0, 1, 2, 3, 10, 0, 4])
    parts = rng.normal(size=(n.sum(), toxicity._COLUMNS)).astype(np.float32)
    bias = rng.normal(size=toxicity.FILTERS * 3).astype(np.float32)
    got = toxicity.maxima(parts, n, bias)
    first = 0
    for t, k in enumerate(n):
        own = parts[first : first + k]
        for i, w in enumerate(toxicity.WIDTHS):
            want = np.zeros(toxicity.FILTERS)
            if k >= w:
                z = sum(own[j : k - w + 1 + j, toxicity._column(w, j)] for j in range(w))
                want = np.maximum(z.max(axis=0) + bias[i * 8 : i * 8 + 8], 0)
            assert np.allclose(got[t, i * 8 : i * 8 + 8], want, atol=1e-5)
        first += k


def test_nulls_and_empty_tables(spark):
    rows = [(i, f"fine words number {i}" if i % 3 else f"awful words number {i}", "en" if i % 2 else None, int(i % 3 == 0)) for i in range(60)]
    rows += [(None, None, None, None), (1, "fine words", None, None), (2, "", "en", 0)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, toxic int")
    model = toxicity.train(docs, docs)
    got = toxicity.score(docs.selectExpr("id", "text", "lang as score1"), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.train(docs, docs.filter("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs.select("id", "text"), None).collect()} == {0.0}
    assert toxicity.score(docs.select("id", "text").limit(0), model).collect() == []


def test_thresholds_count_all_labelled_rows(spark):
    rows = [(i, f"{'awful' if i % 5 == 0 else 'fine'} words {'bad' * (i % 7 == 0)} number {i}", "en", int(i % 5 == 0 or i % 7 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, toxic int").repartition(5)
    model = toxicity.train(docs, docs, sample=20)
    model.shift = np.zeros(1)
    texts = [r[1].encode() for r in rows]
    ids, n = toxicity.word_ids(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    raw = np.rint(toxicity.logits(model, ids, n) * toxicity.BINS) / toxicity.BINS
    toxic = np.array([r[3] for r in rows])
    toxicity.set_thresholds(model, docs, docs.select("id", "toxic"), F.lit(False))
    limit = np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD)) - model.shift[0]
    f1 = lambda cut: 2 * (toxic * (raw > cut)).sum() / ((raw > cut).sum() + toxic.sum())
    assert np.isclose(f1(limit), max(f1(c) for c in np.append(raw - 1e-6, raw.min() - 1)))
