"""Removal of byte strings that occur again anywhere in the corpus, by distributed
prefix doubling over positions.

A suffix array of every byte would move some sixteen bytes a round for each byte of
text. Two things keep the rounds small and the result exact:

* **Positions by content.** Each string of ``length`` bytes belongs to the leftmost
  smallest hash of its grams (of ``GRAM`` bytes): its anchor. Equal strings have
  equal anchors at equal offsets, so only anchors, one in about eighty bytes, are
  ranked; an anchor stands for the run of strings that belong to it.
* **Rank pairs at growing offsets.** The first rank of an anchor is its gram. It is
  then paired with the rank of what lies around it: first all bytes of its run of
  strings at once (equal: all strings of the run repeat), then, for runs that differ
  somewhere, blocks of sixteen, four and one string. A block's pair is (rank so far,
  rank of the bytes by which the common part of its strings grows); the compared
  length so grows from ``GRAM`` to ``length``. Spark groups the pairs; a pair that
  occurs once is unique and leaves, a block whose strings are all found again is
  settled. Of the runs settled as a whole one for each rank goes on, so that blocks of
  others can still find it.

Copies collapse at the first pair and no group is ever gathered: groups are counted
with partial aggregation and ranks come back to positions by joins that can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.hashing import Substrings, sliding_min
from spanloom.llm.rows import KEY, SMALL_STEP, as_bytes, drop, noted, packed, steps, stored

GRAM = 41
BLOCKS = (16, 4, 1)
_PLACE_BITS = 23
SEGMENT = 1 << 21


def anchors_of(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first and last string start, gram hash, run hash), places
    counted from the start of ``data``; the runs of all anchors are all strings of
    ``length`` bytes within each text."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sub = Substrings(data)
    grams = sub.each(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = sliding_min((grams & ~low) | place, length - gram + 1)
    starts = np.arange(len(least))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    fits = starts + length <= at[1:][text]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(least)) - 1
    ok = fits[first]
    first, last = first[ok], last[ok]
    anchor = (least[first] & low).astype(np.int64)
    return text[first], anchor, first, last, grams[anchor], sub.of(first, last + length)


def _segments(data: np.ndarray, at: np.ndarray, length: int):
    """Like ``steps``, with long texts in overlapping parts: row, byte offset within the row."""
    for first, end, part, starts in steps(data, at, SMALL_STEP):
        if len(part) <= 2 * SEGMENT:
            yield first, 0, part, starts
        else:
            for begin in range(0, max(1, len(part) - length + 1), SEGMENT):
                piece = part[begin : begin + SEGMENT + length - 1]
                yield first, begin, piece, np.array([0, len(piece)])


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, f, k1, k2, place, lo, hi): an anchor, its gram and run, and the offsets before
    it at which strings of its run start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in KEY)
            for row, begin, part, starts in _segments(*as_bytes(batch.column("text")), length):
                text, anchor, first, last, g, f = anchors_of(part, starts, length, gram)
                place = anchor - starts[text] + begin
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g.view(np.int64)),
                        pa.array(f.view(np.int64)),
                        pa.array(k1[row + text]),
                        pa.array(k2[row + text]),
                        # place, and the offsets of the last and the first string start before it
                        pa.array((place << 16) | ((anchor - last) << 8) | (anchor - first)),
                    ],
                    names=["g", "f", "k1", "k2", "run"],
                )

    return docs.select("text", *KEY).mapInArrow(work, "g long, f long, k1 long, k2 long, run long")


def _contexts(touched: DataFrame, length: int) -> DataFrame:
    """Of each run that is not settled: its bytes. ``open`` has (g, run, solid)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            column = batch.column("open")
            n = np.diff(column.offsets.to_numpy())
            rows = np.repeat(np.arange(len(n)), n)
            flat = column.flatten()
            g, run, solid = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False)[rows] for k in KEY)
            place, lo, hi = at[rows] + (run >> 16), (run >> 8) & 255, run & 255
            bytes_ = [data[a:b].tobytes() for a, b in zip(place - hi, place - lo + length, strict=True)]
            for i in range(0, len(g), 20_000):
                j = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[j]) for x in (k1, k2, run, g, solid.astype(bool), lo.astype(np.int32), hi.astype(np.int32))]
                    + [pa.array(bytes_[j], pa.binary())],
                    names=["k1", "k2", "run", "g", "solid", "lo", "hi", "bytes"],
                )

    return touched.select("text", *KEY, "open").mapInArrow(
        work, "k1 long, k2 long, run long, g long, solid boolean, lo int, hi int, bytes binary"
    )


def _refined(contexts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, first, last): runs of string starts that repeat, found block by block."""
    who = [*KEY, "run"]
    found = []
    block = lambda c: F.floor(F.col(c) / BLOCKS[0]).cast("int")
    live = contexts.select(*who, "solid", F.lit(0).cast("long").alias("rank"), F.explode(F.sequence(block("lo"), block("hi"))).alias("b"))
    for i, size in enumerate(BLOCKS):
        from_, to = F.greatest(F.col("lo"), F.col("b") * size), F.least(F.col("hi"), F.col("b") * size + size - 1)
        # The part all strings of the block have in common grows as blocks shrink.
        common = F.substring("bytes", F.lit(1) + F.col("hi") - F.col("b") * size, F.lit(length - size + 1))
        rows = live.join(contexts.drop("solid"), who).select(
            *who, "solid", "b", from_.alias("from"), to.alias("to"),
            F.xxhash64("rank", "g", "b", common).alias("r1"),
            F.xxhash64(common, "rank", F.lit(size)).alias("r2"),
            F.xxhash64(from_, to, F.substring("bytes", F.lit(1) + F.col("hi") - to, to - from_ + length)).alias("f"),
        )
        rows = stored(rows, f"blocks-{size}")
        weight = F.when(F.col("solid"), 2).otherwise(1)
        runs = rows.groupBy("r1", "r2", "f").agg(F.sum(weight).alias("n"), F.min(F.struct(*who, "b")).alias("first"))
        pairs = runs.groupBy("r1", "r2").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        ranked = rows.join(runs, ["r1", "r2", "f"]).join(pairs.filter("all > 1"), ["r1", "r2"])
        ranked = ranked.withColumn("settled", F.col("n") > 1)
        found.append(
            ranked.filter("settled AND NOT solid").select(
                *KEY, (F.shiftright("run", 16) - F.col("to")).alias("first"), (F.shiftright("run", 16) - F.col("from")).alias("last")
            )
        )
        if size > 1:
            goes_on = (F.col("kinds") > 1) & (~F.col("settled") | (F.col("first") == F.struct(*who, "b")))
            split = size // BLOCKS[i + 1]
            live = ranked.filter(goes_on).select(
                *who, F.col("settled").alias("solid"), F.col("r1").alias("rank"), "from", "to",
                F.explode(F.sequence(F.col("b") * split, F.col("b") * split + split - 1)).alias("b"),
            ).filter((F.col("b") * BLOCKS[i + 1] <= F.col("to")) & (F.col("b") * BLOCKS[i + 1] + BLOCKS[i + 1] - 1 >= F.col("from"))).drop("from", "to")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_starts(docs: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """(k1, k2, first, last): runs of starts of strings that start elsewhere too."""
    if not gram < length <= gram + 255:
        raise ValueError("strings must be longer than grams, by 255 bytes at most")
    anchors = _anchors(docs, length, gram)
    runs = anchors.groupBy("g", "f").agg(F.count("*").alias("n"))
    grams = runs.groupBy("g").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).filter("all > 1")
    ranks = stored(runs.join(grams, "g").select("g", "f", "n", "kinds"), "ranks")
    members = stored(anchors.join(ranks, ["g", "f"]), "members")
    first = members.filter("kinds > 1 AND n > 1").groupBy("g", "f").agg(F.min(F.struct(*KEY, "run")).alias("x"))
    opened = members.filter("kinds > 1 AND n = 1").select(*KEY, "g", "run", F.lit(False).alias("solid")).unionByName(
        first.select("x.k1", "x.k2", "g", "x.run", F.lit(True).alias("solid"))
    )
    place = F.shiftright("run", 16)
    whole = members.filter("n > 1").select(
        *KEY, (place - F.col("run").bitwiseAND(255)).alias("first"), (place - F.shiftright("run", 8).bitwiseAND(255)).alias("last")
    )
    per_doc = opened.groupBy(*KEY).agg(F.collect_list(F.struct("g", "run", "solid")).alias("open"))
    touched = docs.select(*KEY, "text").join(per_doc, KEY)
    contexts = stored(_contexts(touched, length), "contexts")
    # Repeated rows have the same settled runs; one of each goes on.
    once = contexts.filter("solid").dropDuplicates([*KEY, "run"])
    return whole.unionByName(_refined(contexts.filter("NOT solid").unionByName(once), length))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All other columns of ``docs`` in ``row``, with ``n_bytes``, ``n_removed``, ``spans``
    (array of (first, end) bytes removed) and ``kept`` (binary).

    Removes each byte covered by a string of ``length`` bytes that also starts anywhere
    else, in the same text or another; overlaps count. A null text is empty, texts
    shorter than ``length`` stay whole, repeated rows repeat each other. Any column may
    be null and have any name.
    """
    given = packed(docs, text_col, id_col)
    with noted() as paths:
        starts = repeated_starts(packed(docs, text_col, id_col, keep=False), length, gram)
    # Neighbouring runs of starts become one span; a text's own runs are sorted within it.
    spans = stored(starts.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs")), "spans")
    # Before the texts are moved, what led to the spans goes.
    drop(docs.sparkSession, paths)
    return _cut(given.join(spans, KEY, "left"), length)


def _cut(joined: DataFrame, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            column = batch.column("runs")
            runs = [column[i].values for i in range(len(column))] if column.null_count < len(column) else [None] * len(column)
            kept, removed, spans, counts = [], [], [], [0]
            for i, of_text in enumerate(runs):
                text = data[at[i] : at[i + 1]]
                if of_text is None or not len(of_text):
                    kept.append(text.tobytes())
                    removed.append(0)
                    counts.append(counts[-1])
                    continue
                first = of_text.field(0).to_numpy()
                end = np.maximum.accumulate(of_text.field(1).to_numpy() + length)
                new = np.append(True, first[1:] > end[:-1])
                a, b = first[new], end[np.append(new[1:], True)]
                edges = np.zeros(len(text) + 1, np.int8)
                edges[a] += 1
                edges[b] -= 1
                kept.append(text[np.cumsum(edges[:-1]) == 0].tobytes())
                removed.append(int((b - a).sum()))
                spans.append(np.stack([a, b], 1))
                counts.append(counts[-1] + len(a))
            flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["first", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(np.diff(at)),
                    pa.array(removed, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pairs),
                    pa.array(kept, pa.binary()),
                ],
                names=["row", "n_bytes", "n_removed", "spans", "kept"],
            )

    schema = T.StructType([
        joined.schema["row"],
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ])
    return joined.select("row", "text", "runs").mapInArrow(work, schema)
