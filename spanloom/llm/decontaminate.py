"""Benchmark decontamination by winnowing.

Of the hashes of all k-grams in each window of t words the smallest is kept as a
fingerprint, in documents and in test items alike. Two texts that share t words in a
row so share a fingerprint. With k = 5 and t = 10 about two in seven words carry one.
Fingerprints of documents are joined with those of the items, and each hit is extended
to the windows around it, which are compared as words with the items' windows: what
counts as a hit is exact.

Items of fewer words are one window of their own length. For each length among the
items documents are winnowed with that t.

Before the join, documents' fingerprints are tested against a bit table of fixed size
that is made from the items' fingerprints. It only saves work: with many items it fills
up and lets more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.hashing import WORD_BYTES, Substrings, sliding_min, words
from spanloom.llm.rows import KEY, SMALL_STEP, as_bytes, packed, steps, stored

GRAM = 5
#: log2 of the size of the bit table.
TABLE_BITS = 20


def winnow(hashes: np.ndarray, text: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (word numbers) and hashes of the fingerprints of windows of ``t`` words."""
    k = min(GRAM, t)
    if len(hashes) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = Substrings(hashes).each(k)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), t - k + 1)
    least = least[text[: len(least)] == text[t - 1 :]] & low
    place = np.unique(least).astype(np.int64)
    return place, grams[place]


def _slots(fingerprints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (fingerprints & mask).astype(np.int64), (fingerprints >> np.uint64(bits) & mask).astype(np.int64)


def _words(data: np.ndarray, at: np.ndarray):
    first, end, text, hashes = words(data, at)
    lower = WORD_BYTES[data]
    n = np.bincount(text, minlength=len(at) - 1)
    return (lambda a, b: [lower[first[i] : end[i]].tobytes() for i in range(a, b)]), text, hashes, n


def _item_windows(items: DataFrame, span: int) -> DataFrame:
    """(item_id, t, window, fps): each window of each item, and its fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            ids = batch.column("item_id")
            for row, _, part, starts in steps(data, at, SMALL_STEP):
                spell, text, hashes, n = _words(part, starts)
                begin = np.cumsum(n) - n
                of, length, window, prints = [], [], [], []
                for i in np.flatnonzero(n):
                    t = min(span, int(n[i]))
                    own = hashes[begin[i] : begin[i] + n[i]]
                    place, value = winnow(own, np.zeros(len(own), np.int64), t)
                    for p in range(int(n[i]) - t + 1):
                        of.append(row + i)
                        length.append(t)
                        window.append(b" ".join(spell(begin[i] + p, begin[i] + p + t)))
                        inside = (place >= p) & (place <= p + t - min(GRAM, t))
                        prints.append(value[inside].view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(of, pa.int64())), pa.array(length, pa.int32()), pa.array(window, pa.binary()), pa.array(prints, pa.list_(pa.int64()))],
                    names=["item_id", "t", "window", "fps"],
                )

    id_type = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(work, f"item_id {id_type}, t int, window binary, fps array<long>")


def _scanned(docs: DataFrame, lengths: list[int], tables: dict[int, np.ndarray], bits: int) -> DataFrame:
    """(doc_id, k1, k2, n_words, hits): per document its fingerprints that the bit tables
    let through, each with the words around it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit_type = pa.struct([("t", pa.int32()), ("fp", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.binary()))])
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            for row, end, part, starts in steps(data, at, SMALL_STEP):
                spell, text, hashes, n = _words(part, starts)
                begin = np.cumsum(n) - n
                hits: list[list[dict]] = [[] for _ in range(end - row)]
                for t in lengths:
                    place, value = winnow(hashes, text, t)
                    a, b = _slots(value, bits)
                    ok = tables[t][a] & tables[t][b]
                    reach = t - min(GRAM, t)
                    for q, fp in zip(place[ok].tolist(), value[ok].view(np.int64).tolist(), strict=True):
                        i = int(text[q])
                        a, b = max(int(begin[i]), q - reach), min(int(begin[i] + n[i]), q + t)
                        hits[i].append({"t": t, "fp": fp, "first": a - int(begin[i]), "words": spell(a, b)})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(row, end - row) for k in ("doc_id", *KEY)] + [pa.array(n.astype(np.int64)), pa.array(hits, pa.list_(hit_type))],
                    names=["doc_id", *KEY, "n_words", "hits"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *KEY).mapInArrow(
        work, f"doc_id {id_type}, k1 long, k2 long, n_words long, hits array<struct<t:int,fp:long,first:long,words:array<binary>>>"
    )


def contamination(
    docs: DataFrame, items: DataFrame, span: int = 10, bits: int = TABLE_BITS, text_col: str = "text", id_col: str = "doc_id",
    item_text_col: str = "text", item_id_col: str = "item_id",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, its key ``k1, k2``, ``n_words``, ``n_hit``
    (words inside any occurrence of an item's window of ``span`` words) and ``items``
    (sorted texts of the distinct ids of those items).

    Words are runs of digits, letters (A-Z lower-cased) and all beyond ASCII. An item of
    fewer words is one window; items and documents without words, or null, have none.
    Items with null id count in ``n_hit`` but have no id to list. Repeated rows give
    repeated rows; repeated items count once by id.
    """
    items = items.select(F.col(f"`{item_id_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    windows = stored(_item_windows(items, span), "windows")
    prints = windows.select("t", F.explode("fps").alias("fp")).distinct()
    mask = (1 << bits) - 1
    # At most 2 ** bits numbers for each of at most ``span`` lengths.
    slots = prints.select("t", F.explode(F.array(F.col("fp").bitwiseAND(mask), F.shiftright("fp", bits).bitwiseAND(mask))).alias("slot"))
    tables: dict[int, np.ndarray] = {}
    got = slots.distinct().toArrow()
    for t in sorted(set(got.column("t").to_pylist())):
        tables[t] = np.zeros(1 << bits, bool)
        tables[t][got.column("slot").to_numpy()[got.column("t").to_numpy() == t]] = True
    lengths = list(tables)

    scanned = stored(_scanned(packed(docs, text_col, id_col, keep=False), lengths, tables, bits), "scanned")
    met = scanned.select(*KEY, F.explode("hits").alias("h")).select(*KEY, "h.*").join(prints, ["t", "fp"])
    # Extended: all windows of t words around the fingerprint.
    here = met.select(*KEY, "t", "first", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("t"))).alias("i")).select(
        *KEY, "t", (F.col("first") + F.col("i")).alias("p"),
        F.array_join(F.transform(F.slice("words", F.col("i") + 1, F.col("t")), lambda w: w.cast("string")), " ").cast("binary").alias("window"),
    )
    hits = stored(here.distinct().join(windows.select("t", "window").distinct(), ["t", "window"]), "hits")
    in_text = Window.partitionBy(*KEY).orderBy("p", "t")
    end = F.col("p") + F.col("t")
    before = F.max(end).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    words_hit = (
        hits.withColumn("new", F.greatest(F.lit(0), end - F.greatest("p", F.coalesce(before, "p"))))
        .groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    )
    of_item = windows.filter("item_id IS NOT NULL").select("t", "window", F.col("item_id").cast("string").alias("item")).distinct()
    listed = hits.select(*KEY, "t", "window").distinct().join(of_item, ["t", "window"]).groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return (
        scanned.select("doc_id", *KEY, "n_words")
        .join(words_hit, KEY, "left")
        .join(listed, KEY, "left")
        .select("doc_id", *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
