"""Document quality by co-training.

Two classifiers see different things. The content view has hashed words (how often each
bucket is met) and how words repeat. The page view has metadata only: source, language,
length, lines, and the shares of kinds of characters. Both are logistic units trained
in numpy on the driver from a bounded sample of labelled rows. In each round each view
labels those of a bounded pool of unlabelled rows that it is surest of, and these join
the rows that the other view learns from. Then each view is calibrated on labelled rows
that were kept back (a logistic fit of its logit), and the calibrated logits are added
up. Tasks score all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.hashing import words
from spanloom.llm.rows import as_bytes, steps

WORD_BITS = 10
#: Rows learned from: of each label, and of the unlabelled pool, at most about so many.
SAMPLE = 2500
POOL = 4000
ROUNDS = 4
#: Of the pool, the part that a view labels in a round.
SHARE = 0.1
#: A pseudo-label is given with so much confidence at least.
CONFIDENT = 0.9

_SOURCES, _LANGS, _SIZES, _LINES = 64, 32, 32, 24
_KIND = np.full(256, 3)
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_KIND[0x30:0x3A] = 1
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 0
_KIND[0x80:] = 4


def content_view(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts x features of what the words are."""
    first, end, text, hash_ = words(data, at)
    m = len(at) - 1
    n = np.maximum(np.bincount(text, minlength=m), 1)
    bucket = (hash_ >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    out = np.zeros((m, (1 << WORD_BITS) + 6), np.float32)
    out[:, : 1 << WORD_BITS] = np.sqrt(np.bincount((text << WORD_BITS) + bucket, minlength=m << WORD_BITS).reshape(m, -1) / n[:, None])
    for i, lag in enumerate((1, 2, 3)):
        same = (hash_[lag:] == hash_[:-lag]) & (text[lag:] == text[:-lag]) if len(hash_) > lag else np.zeros(0, bool)
        out[:, (1 << WORD_BITS) + i] = np.bincount(text[lag:][same], minlength=m)[:m] / n
    size = end - first
    out[:, -3] = np.bincount(text, size, m) / n / 10
    out[:, -2] = np.bincount(text[size > 20], minlength=m) / n
    out[:, -1] = 1
    return out


def page_view(data: np.ndarray, at: np.ndarray, source: list, lang: list) -> np.ndarray:
    """Texts x features of what is known without reading the words."""
    m, size = len(at) - 1, np.diff(at)
    text = np.repeat(np.arange(m), size)
    kind = np.bincount(text * 5 + _KIND[data], minlength=5 * m).reshape(m, 5) / np.maximum(size, 1)[:, None]
    lines = np.bincount(text[data == 10], minlength=m) + 1
    out = np.zeros((m, _SOURCES + _LANGS + _SIZES + _LINES + 6), np.float32)
    row = np.arange(m)
    code = lambda x, k: zlib.crc32(b"" if x is None else str(x).encode()) % k
    out[row, [code(x, _SOURCES) for x in source]] = 0.5
    out[row, [_SOURCES + code(x, _LANGS) for x in lang]] = 0.5
    out[row, _SOURCES + _LANGS + np.minimum(np.log2(size + 1).astype(int), _SIZES - 1)] = 0.5
    out[row, _SOURCES + _LANGS + _SIZES + np.minimum(np.log2(lines).astype(int), _LINES - 1)] = 0.5
    out[:, -6:-1] = kind * 3
    out[:, -1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, steps_: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic unit, by Adam on all rows."""
    w = np.zeros(x.shape[1], np.float32) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = (weight / max(weight.sum(), 1e-9)).astype(np.float32)
    for t in range(1, steps_ + 1):
        grad = x.T @ ((_sigmoid(x @ w) - y) * weight).astype(np.float32) + decay * w
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


@dataclass
class Model:
    content: np.ndarray
    page: np.ndarray
    scale: list[tuple[float, float]]
    prior: float
    exchanged: list[int] = field(default_factory=list)

    def logit(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Both views have seen how common labels are, so that counts once."""
        (a, b), (c, d) = self.scale
        return a * (content @ self.content) + b + c * (page @ self.page) + d - self.prior


def co_train(content: np.ndarray, page: np.ndarray, label: np.ndarray, weight: np.ndarray, kept: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> Model:
    """``label`` of rows, of which those ``kept`` are for calibration; views of the pool."""
    views, pools = (content, page), pool
    learn = ~kept
    given = [(np.zeros(0, np.int64), np.zeros(0, np.float32)) for _ in views]
    model: list[np.ndarray | None] = [None, None]
    exchanged = []

    def fit(i: int) -> np.ndarray:
        rows, pseudo = given[i]
        x = np.concatenate([views[i][learn], pools[i][rows]])
        y = np.concatenate([label[learn], pseudo])
        w = np.concatenate([weight[learn], np.full(len(rows), 0.5 * weight[learn].mean() if learn.any() else 1.0)])
        return _logistic(x, y, w, model[i], 150 if model[i] is None else 60)

    for round_ in range(ROUNDS + 1):
        model = [fit(0), fit(1)]
        if round_ == ROUNDS or not len(pools[0]):
            break
        fresh = []
        for i in (0, 1):
            p = _sigmoid(pools[i] @ model[i])
            known = np.zeros(len(p), bool)
            known[given[1 - i][0]] = True
            sure = np.maximum(p, 1 - p)
            open_ = np.flatnonzero(~known & (sure >= CONFIDENT))
            best = open_[np.argsort(-sure[open_], kind="stable")][: max(1, int(SHARE * len(p)))]
            fresh.append((best, (p[best] >= 0.5).astype(np.float32)))
        for i in (0, 1):  # what one view is sure of, the other learns
            given[1 - i] = tuple(np.concatenate([a, b]) for a, b in zip(given[1 - i], fresh[i], strict=True))
        exchanged.append(len(fresh[0][0]) + len(fresh[1][0]))
    rest = kept if kept.any() and 0 < label[kept].mean() < 1 else learn
    share = np.average(label, weights=weight) if len(label) else 0.5
    prior = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    scale = []
    for i in (0, 1):
        z = views[i][rest] @ model[i]
        x = np.column_stack([z, np.ones(len(z))]).astype(np.float32)
        a, b = _logistic(x, label[rest], weight[rest], np.array([1, 0], np.float32), 200, 1e-3)
        scale.append((float(max(a, 0)), float(b)))
    return Model(model[0], model[1], scale, prior, exchanged)


def _features(rows: DataFrame) -> DataFrame:
    """(id, label, weight, kept, content, page): both views as 32-bit floats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
            for row, end, part, starts in steps(data, at):
                views = content_view(part, starts), page_view(part, starts, source[row:end], lang[row:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(row, end - row) for c in ("order", "label")] + [pa.array([x.tobytes() for x in v], pa.binary()) for v in views],
                    names=["order", "label", "content", "page"],
                )

    return rows.mapInArrow(work, "order long, label int, content binary, page binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL) -> Model | None:
    """A model from ``docs`` (doc_id, text, lang, source) and ``labels`` (doc_id, quality).

    Of each label and of the unlabelled rows all are taken, or about ``sample`` and
    ``pool`` picked by a hash of the id, of the whole row where the id is null; never
    more than twice as many in all, whatever ids and rows repeat (labelled rows first).
    None without rows of both labels. Rows with a null id cannot have a label.
    """
    order = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(F.lit(9), "text", "lang", "source"))
    known = labels.filter("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    total = docs.count()
    view = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    part = F.when(F.col("label") == 1, min(1.0, sample / n[1])).when(F.col("label") == 0, min(1.0, sample / n[0])).otherwise(min(1.0, pool / max(1, total)))
    chance = F.pmod(order, F.lit(1_000_000)) / 1_000_000
    # Rows that no label could pick are gone before the join.
    most = max(min(1.0, sample / n[0]), min(1.0, sample / n[1]), min(1.0, pool / max(1, total)))
    rows = view.filter(chance < most).join(known, "doc_id", "left").filter(chance < part)
    # Equal rows have equal hashes, so the shares above are no bound by themselves.
    rows = rows.withColumn("_order", order).orderBy(F.col("label").isNull(), "_order").limit(4 * sample + 2 * pool)
    got = _features(rows.select("text", "lang", "source", order.alias("order"), "label")).toArrow().sort_by("order")
    if not got.num_rows:
        return None
    content, page = (np.frombuffer(b"".join(got.column(c).to_pylist()), np.float32).reshape(got.num_rows, -1) for c in ("content", "page"))
    label = np.array([-1 if x is None else x for x in got.column("label").to_pylist()])
    has = label >= 0
    if len(set(label[has].tolist())) < 2:
        return None
    weight = np.where(label[has] == 1, max(1.0, n[1] / sample), max(1.0, n[0] / sample)).astype(np.float32)
    kept = np.abs(got.column("order").to_numpy()[has]) // 1_000_000 % 4 == 0
    return co_train(content[has], page[has], label[has].astype(np.float32), weight, kept, (content[~has], page[~has]))


def score(given: DataFrame, model: Model | None) -> DataFrame:
    """``score`` (0 to 1, higher: better) beside the other columns of ``given``, instead of
    ``text``, ``lang`` and ``source``. Null texts are empty; null metadata is a value of
    its own; without a model all scores are 0.5."""
    held = given.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in given.columns if c not in ("text", "lang", "source")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            scores = np.full(len(at) - 1, 0.5)
            if m is not None:
                source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
                for row, end, part, starts in steps(data, at):
                    scores[row:end] = _sigmoid(m.logit(content_view(part, starts), page_view(part, starts, source[row:end], lang[row:end])))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(scores)], names=[*kept, "score"])

    schema = T.StructType([given.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    return given.mapInArrow(work, schema)
