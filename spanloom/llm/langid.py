"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from Spark tasks over a bounded sample of labelled rows and make a matrix
of log-probabilities (buckets x languages) that is broadcast; its size depends on the
number of languages alone. Tasks score whole texts in batches: n-grams of a batch are
hashed at once, and the rows of the matrix are summed up by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
#: Labelled rows learned from, for each language at most about so many.
SAMPLE = 5000
SMOOTHING = 0.5
STEP_CHARS = 1 << 18
UNKNOWN = "und"

_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, each run of anything else as one space, and a
    space at both ends of each text; where each text begins (one more at the end)."""
    coded = [(" " + x.lower() + " ").encode("utf-32-le", "surrogatepass") for x in texts]
    code = np.frombuffer(b"".join(coded), np.uint32).copy()
    at = np.cumsum([0] + [len(x) // 4 for x in coded])
    letter = _LETTER[np.minimum(code, 0xFFFF)] | (code > 0xFFFF)
    code[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1]] = True
    return code[keep], np.append(0, np.cumsum(keep))[at]


def _grams(code: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram from each symbol on."""
    n = max(0, len(code) - order + 1)
    with np.errstate(over="ignore"):
        key = np.full(n, order, np.uint32)
        for i in range(order):
            key = (key ^ code[i : i + n]) * np.uint32(0x01000193) + np.uint32(order)
            key ^= key >> np.uint32(15)
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > STEP_CHARS:
            yield first, i
            first, size = i, 0
        size += len(x)
    if first < len(texts):
        yield first, len(texts)


def log_odds(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Summed log-probabilities (texts x languages) of texts that have letters."""
    out = np.zeros((len(texts), matrix.shape[1]))
    for a, b in _chunks(texts):
        code, at = _symbols(texts[a:b])
        for order in ORDERS:
            bucket = _grams(code, order)
            first, end = at[:-1], np.maximum(at[1:] - order + 1, at[:-1])
            for j in range(matrix.shape[1]):
                sums = np.append(0.0, np.cumsum(matrix[:, j][bucket], dtype=np.float64))
                out[a:b, j] += sums[np.minimum(end, len(bucket))] - sums[np.minimum(first, len(bucket))]
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from rows that have a label: for each language all of them, or about
    ``sample`` picked by a hash of the id. Rows without text are no use and left out."""
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    given = given.filter("lang IS NOT NULL")
    # One row for each language.
    n = {r["lang"]: r["count"] for r in given.groupBy("lang").count().collect()}
    if not n:
        return Model([], np.zeros(0), np.zeros((1 << BUCKET_BITS, 0)))
    part = F.coalesce(F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, sample / k))])[F.col("lang")], F.lit(0.0))
    picked = given.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part * 1_000_000).select("text", "lang").filter(F.col("text").rlike(r"\p{L}"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for a, b in _chunks(own):
                    code, at = _symbols(own[a:b])
                    for order in ORDERS:
                        bucket = _grams(code, order)
                        inside = np.zeros(len(bucket) + 1, np.int32)
                        first, end = np.minimum(at[:-1], len(bucket)), np.minimum(np.maximum(at[1:] - order + 1, at[:-1]), len(bucket))
                        np.add.at(inside, first, 1)
                        np.add.at(inside, end, -1)
                        total += np.bincount(bucket[np.cumsum(inside[:-1]) > 0], minlength=len(total))
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    got = picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(n)
    counts = np.zeros((1 << BUCKET_BITS, len(languages)))
    column = np.searchsorted(languages, got.column("lang").to_pylist()) if got.num_rows else np.zeros(0, np.int64)
    counts[got.column("bucket").to_numpy(), column] = got.column("n").to_numpy()
    matrix = np.log(counts + SMOOTHING) - np.log((counts + SMOOTHING).sum(axis=0))
    prior = np.array([n[x] for x in languages], float)
    return Model(languages, np.log(prior / prior.sum()), matrix.astype(np.float32))


def identify(given: DataFrame, model: Model) -> DataFrame:
    """``lang_pred`` and ``score`` (the probability of that language, 0 to 1) beside the
    other columns of ``given``, instead of its column ``text``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text
    if the model has learned nothing. Of equally likely languages the first by name is
    taken. N-grams of several orders overlap, so a text's evidence is divided by their
    number.
    """
    held = given.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in given.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            some = [i for i, x in enumerate(texts) if m.languages and x and any(map(str.isalpha, x))]
            label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if some:
                odds = log_odds([texts[i] for i in some], m.matrix) / len(ORDERS) + m.prior
                odds -= odds.max(axis=1, keepdims=True)
                best = odds.argmax(axis=1)
                score[some] = 1 / np.exp(odds).sum(axis=1)
                for i, j in zip(some, best.tolist(), strict=True):
                    label[i] = m.languages[j]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(label, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    schema = T.StructType([given.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(work, schema)
