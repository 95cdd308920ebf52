"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of three hashed embeddings: of the word and of its first four and five
bytes. Filters of widths one to three slide over the words, each keeps its maximum in
the text, and a logistic unit weighs the maxima. The model is trained on the driver
from a bounded sample of labelled rows. Since a filter is linear in each word's
embedding, tasks look filters up in tables, whose size is fixed.

Thresholds are calibrated by language on all labelled rows that were not trained on,
whose scores tasks count in bins: each language's scores are shifted so that its best
threshold is ``THRESHOLD``. The language is told from the same hashed words by naive Bayes, from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.hashing import WORD_BYTES, Substrings, words
from spanloom.llm.rows import as_bytes, steps

BUCKET_BITS = 16
PREFIXES = (4, 5)
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 16
#: Labelled rows learned from, of each label at most about so many.
SAMPLE = 3000
EPOCHS = 6
THRESHOLD = 0.3
#: A language gets a threshold of its own with so many labelled toxic texts to calibrate on.
LEAST_TOXIC = 8
#: Scores are counted in so many bins for each unit of the logit, up to this logit.
BINS, MOST_LOGIT = 256, 40

_COLUMNS = FILTERS * sum(WIDTHS)


@dataclass
class Model:
    table: np.ndarray  # bucket x (filter, word of the filter), of all widths
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: np.ndarray  # bucket x language: log-probabilities
    shift: np.ndarray


def word_ids(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets of each word (words x 3), and the number of words of each text."""
    first, end, text, whole = words(data, at)
    sub = Substrings(WORD_BYTES[data])
    ids = [whole] + [sub.of(first, np.minimum(first + n, end)) + np.uint64(n) for n in PREFIXES]
    shift = np.uint64(64 - BUCKET_BITS)
    ids = np.stack([(x * np.uint64(0x9E3779B97F4A7C15)) >> shift for x in ids], 1).astype(np.uint16)
    return ids, np.bincount(text, minlength=len(at) - 1)


def _column(width: int, j: int) -> slice:
    begin = FILTERS * (sum(w for w in WIDTHS if w < width) + j)
    return slice(begin, begin + FILTERS)


def maxima(parts: np.ndarray, n: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Pooled filters (texts x filters) of words' filter parts; 0 for texts too short."""
    end = np.cumsum(n)
    first = end - n
    out = np.zeros((len(n), FILTERS * len(WIDTHS)), np.float32)
    for i, width in enumerate(WIDTHS):
        z = parts[: max(0, len(parts) - width + 1), _column(width, 0)].copy()
        for j in range(1, width):
            z += parts[j : j + len(z), _column(width, j)]
        some = np.flatnonzero(n >= width)
        if len(some):
            edges = np.stack([first[some], end[some] - width + 1], 1).ravel()
            if edges[-1] == len(z):
                edges = edges[:-1]
            top = np.maximum.reduceat(z, edges, axis=0)[::2]
            out[some, i * FILTERS : (i + 1) * FILTERS] = np.maximum(top + bias[i * FILTERS : (i + 1) * FILTERS], 0)
    return out


def logits(model: Model, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each text's logit, shifted for its language."""
    parts = model.table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        parts += model.table[ids[:, k]]
    raw = maxima(parts, n, model.bias) @ model.out + model.out_bias
    return raw + model.shift[languages_of(model, ids, n)]


def languages_of(model: Model, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(n)), n)
    odds = [np.bincount(text, model.languages[:, j][ids[:, 0]], len(n)) for j in range(model.languages.shape[1])]
    return np.argmax(odds, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(ids: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, seed: int = 0) -> Model:
    """Train on texts given as word buckets; ``weight`` undoes the sampling of labels."""
    rng = np.random.default_rng(seed)
    buckets = 1 << BUCKET_BITS
    # Embeddings begin with how much more often a bucket is met in toxic texts.
    met = np.zeros((2, buckets))
    for x, y in zip(ids, toxic, strict=True):
        met[int(y), np.unique(x)] += 1
    total = np.maximum(np.bincount(toxic.astype(int), minlength=2), 1)
    prior = 2.0
    odds = np.log((met[1] + prior * 0.1) / (total[1] + prior)) - np.log((met[0] + prior * 0.1) / (total[0] + prior))
    sure = (met.sum(axis=0)) / (met.sum(axis=0) + 3.0)
    embed = (rng.normal(size=(buckets, SIZE)) * 0.02).astype(np.float32)
    embed[:, 0] = np.clip(odds * sure, -1, 4)
    kernel = {w: (rng.normal(size=(w, SIZE, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        kernel[w][:, 0, :2] = 1.0 / w
    bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
    out = np.full(FILTERS * len(WIDTHS), 0.05, np.float32)
    out_bias = np.float32(-2.0)
    state = {k: np.zeros_like(v) for k, v in [("embed", embed), ("bias", bias), ("out", out)] + [(w, kernel[w]) for w in WIDTHS]}
    out_state = 0.0

    def step(name, value, grad, rate):
        state[name] += grad * grad
        value -= rate * grad / np.sqrt(state[name] + 1e-6)

    y_all = toxic.astype(np.float32)
    for epoch in range(EPOCHS):
        rate = 0.05 / (1 + epoch)
        for batch in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // 32)):
            n = np.array([len(ids[i]) for i in batch])
            flat = np.concatenate([ids[i] for i in batch]) if len(batch) else np.zeros((0, 3), np.uint16)
            e = embed[flat[:, 0]] + embed[flat[:, 1]] + embed[flat[:, 2]]
            first = np.cumsum(n) - n
            pooled = np.zeros((len(batch), len(bias)), np.float32)
            place = np.full((len(batch), len(bias)), -1, np.int64)
            for i, w in enumerate(WIDTHS):
                if len(e) < w:
                    continue
                z = sum(e[j : len(e) - w + 1 + j] @ kernel[w][j] for j in range(w))
                for t in np.flatnonzero(n >= w):
                    own = z[first[t] : first[t] + n[t] - w + 1]
                    at = own.argmax(axis=0)
                    pooled[t, i * FILTERS : (i + 1) * FILTERS] = own[at, np.arange(FILTERS)]
                    place[t, i * FILTERS : (i + 1) * FILTERS] = first[t] + at
            active = np.maximum(pooled + bias, 0) * (place >= 0)
            error = (_sigmoid(active @ out + out_bias) - y_all[batch]) * weight[batch] / max(1, len(batch))
            back = error[:, None] * out * ((active > 0) & (place >= 0))
            g_embed = np.zeros_like(e)
            g_kernel = {}
            for i, w in enumerate(WIDTHS):
                g_kernel[w] = np.zeros_like(kernel[w])
                for f in range(FILTERS):
                    b, p = back[:, i * FILTERS + f], place[:, i * FILTERS + f]
                    on = np.flatnonzero(b)
                    for j in range(w):
                        g_kernel[w][j, :, f] += b[on] @ e[p[on] + j]
                        np.add.at(g_embed, p[on] + j, b[on, None] * kernel[w][j, :, f])
            hot = np.flatnonzero(np.abs(g_embed).sum(axis=1))
            rows, where = np.unique(flat[hot], return_inverse=True)
            grad = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(grad, where.reshape(-1), np.repeat(g_embed[hot], 3, axis=0))
            state["embed"][rows] += grad * grad
            embed[rows] -= 0.3 * rate * grad / np.sqrt(state["embed"][rows] + 1e-4)
            for w in WIDTHS:
                step(w, kernel[w], g_kernel[w], rate)
            step("bias", bias, back.sum(axis=0), rate)
            step("out", out, active.T @ error + 1e-4 * out, rate)
            out_state += float(error.sum()) ** 2
            out_bias -= np.float32(rate * error.sum() / np.sqrt(out_state + 1e-6))
    table = np.zeros((buckets, _COLUMNS), np.float32)
    for w in WIDTHS:
        for j in range(w):
            table[:, _column(w, j)] = embed @ kernel[w][j]
    return Model(table, bias, out, float(out_bias), np.zeros((buckets, 1), np.float32), np.zeros(1))


def _best_threshold(value: np.ndarray, hit: np.ndarray, every: np.ndarray) -> float:
    """Between the two distinct values where F1 is greatest; halfway in a gap. ``hit`` and
    ``every`` weigh the toxic texts and all texts of a value."""
    value, place = np.unique(value, return_inverse=True)
    hit, every = (np.bincount(place, w)[::-1] for w in (hit, every))
    value = value[::-1]
    found = np.cumsum(hit)
    best = int(np.argmax(2 * found / np.maximum(np.cumsum(every) + hit.sum(), 1e-9)))
    below = value[best + 1] if best + 1 < len(value) else value[best] - 1
    return float((value[best] + below) / 2)


def calibrate(model: Model, ids: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, langs: list[str]) -> Model:
    """Learn languages' words, and set each language's threshold; those with few toxic
    texts share one."""
    names = sorted(set(langs)) or [""]
    counts = np.full((1 << BUCKET_BITS, len(names)), 0.1)
    for x, lang in zip(ids, langs, strict=True):
        np.add.at(counts[:, names.index(lang)], x[:, 0], 1)
    model.languages = (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)
    model.shift = np.zeros(len(names))
    return model


def set_thresholds(model: Model, texts: DataFrame, given: DataFrame, learned: Column) -> Model:
    """Thresholds out of all labelled rows that were not ``learned`` from. Their scores are
    counted in bins on the executors: ``texts`` (id, text) meet their labels (id, toxic)
    without the text, and the driver gets at most two numbers for each language and bin."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            for row, end, part, starts in steps(data, at):
                ids, n = word_ids(part, starts)
                bin_ = np.rint(np.clip(logits(m, ids, n), -MOST_LOGIT, MOST_LOGIT) * BINS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, end - row), pa.array(languages_of(m, ids, n).astype(np.int32)), pa.array(bin_.astype(np.int32))],
                    names=["id", "lang", "bin"],
                )

    id_type = given.schema["id"].dataType.simpleString()
    scored = texts.select("id", "text").mapInArrow(bins, f"id {id_type}, lang int, bin int")
    counts = scored.join(given, "id").filter(~learned).groupBy("lang", "bin").agg(
        F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("every")
    ).toArrow()
    lang, bin_, toxic, every = (counts.column(c).to_numpy().astype(float) for c in ("lang", "bin", "toxic", "every"))
    # What was learned from is missing, more of one label than of the other.
    n = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    if not toxic.sum():
        return model
    clean = every - toxic
    hit = toxic * n[1] / toxic.sum()
    every = hit + clean * n[0] / max(clean.sum(), 1)
    target = np.log(THRESHOLD / (1 - THRESHOLD))
    shift = np.full(len(model.shift), target - _best_threshold(bin_ / BINS, hit, every))
    for j in range(len(shift)):
        own = lang == j
        if toxic[own].sum() >= LEAST_TOXIC:
            shift[j] = target - _best_threshold(bin_[own] / BINS, hit[own], every[own])
    model.shift = shift
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from ``docs`` (id, text, lang) and ``labels`` (id, toxic); of each label all
    rows, or about ``sample`` picked by a hash of the id. None without rows of both labels.
    Of several labels of an id the toxic one counts."""
    given = labels.select("id", F.col("toxic").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    given = given.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    part = F.when(F.col("toxic") == 1, min(1.0, sample / n[1])).otherwise(min(1.0, sample / n[0]))
    order = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    # About 2 * sample labels at most, so texts need not move.
    few = F.broadcast(given.filter(order < part * 1_000_000))
    texts = docs.select("id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL")
    fold_of = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)).cast("int")
    picked = texts.join(few, "id").withColumn("fold", fold_of)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            for row, end, part_, starts in steps(data, at):
                x, n_ = word_ids(part_, starts)
                cut = np.append(0, np.cumsum(n_))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())]
                    + [batch.column(c).slice(row, end - row) for c in ("id", "lang", "toxic", "fold")],
                    names=["words", "id", "lang", "toxic", "fold"],
                )

    id_type = given.schema["id"].dataType.simpleString()
    rows = picked.select("text", "id", "lang", "toxic", "fold").mapInArrow(ids, f"words binary, id {id_type}, lang string, toxic int, fold int")
    # About 2 * sample rows, in an order that does not depend on partitions.
    got = rows.toArrow()
    words_ = [np.frombuffer(x, np.uint16).reshape(-1, 1 + len(PREFIXES)) for x in got.column("words").to_pylist()]
    toxic, fold = got.column("toxic").to_numpy().astype(float), got.column("fold").to_numpy()
    if len(set(toxic.tolist())) < 2:
        return None
    langs = [x or "" for x in got.column("lang").to_pylist()]
    order_ = sorted(range(len(words_)), key=lambda i: (str(got.column("id")[i]), len(words_[i]), toxic[i]))
    weight = np.where(toxic == 1, max(1.0, n[1] / sample), max(1.0, n[0] / sample))
    weight /= max(weight.mean(), 1e-9)
    pick = lambda on: [i for i in order_ if on(fold[i])]
    learn = pick(lambda f: f > 0)
    model = fit([words_[i] for i in learn], toxic[learn], weight[learn].astype(np.float32))
    model = calibrate(model, [words_[i] for i in order_], toxic, weight, [langs[i] for i in order_])
    learned = (order < part * 1_000_000) & (fold_of > 0)
    return set_thresholds(model, texts, given, learned)


def score(given: DataFrame, model: Model | None) -> DataFrame:
    """``score`` (0 to 1) beside the other columns of ``given``, instead of ``text``.

    Null and empty texts have no words and get the model's score of nothing; without a
    model all scores are 0. Repeated rows stay.
    """
    held = given.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in given.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            scores = np.zeros(len(at) - 1)
            if m is not None:
                for row, end, part, starts in steps(data, at):
                    x, n = word_ids(part, starts)
                    scores[row:end] = _sigmoid(logits(m, x, n))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(scores)], names=[*kept, "score"])

    schema = T.StructType([given.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    return given.mapInArrow(work, schema)
