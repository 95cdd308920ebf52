"""Removal of word passages that an earlier document has too, found by anchors at the
positions of a difference cover.

A cover of a period holds two positions at every distance modulo the period. If two
documents share ``span`` words, wherever they lie, then some place in the shared words
is at a covered position in both: its ``span - period + 1`` words, the anchor, lie within
the span. So only anchors at covered positions (three of seven) are hashed, and an
anchor that one document alone has leaves at once.

From the shared anchors the work extends to whole windows, in two steps:

* **Around the anchor.** All windows around it at once: those whose surrounding words
  are equal form a class. The least document of a class keeps its words, the windows
  of all later ones are found.
* **Window by window**, only for the least document of each class whose anchor occurs
  with other surroundings too: there a window may be shared though the surroundings
  differ.

Classes are cut out of sorted rows, read as a stream, so no group is ever held. Rows of
one batch are resolved among themselves first, and each batch sends a class's least
document only, so a passage that a third of all documents share does not meet in one
task row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.hashing import Substrings, mixed
from spanloom.llm.rows import as_bytes, drop, noted, others, steps, stored

# Perfect difference covers, period and positions.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}

#: Least words of an anchor.
LEAST_GRAM = 5

#: Bits of the table of shared anchors that is sent to all tasks (32 MB, whatever the
#: input), and the parts it is built in. It only spares rows: where it is full, more
#: anchors go on, with the same result.
TABLE_BITS = 28
SLICES = 64

#: A null id counts as this one, the largest.
NO_ID = (1 << 63) - 1

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True


def cover_for(span: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of ``LEAST_GRAM`` words."""
    fits = [p for p in COVERS if span - p + 1 >= LEAST_GRAM]
    if not fits:
        raise ValueError(f"a span needs {LEAST_GRAM + min(COVERS) - 1} words at least")
    return max(fits), COVERS[max(fits)]


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and where the words of each text begin."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SEPARATES[data]
    first = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    some = np.diff(at) > 0
    first[at[:-1][some]] = inside[1:-1][at[:-1][some]]
    end[at[1:][some] - 1] = inside[1:-1][at[1:][some] - 1]
    first, end = np.flatnonzero(first), np.flatnonzero(end) + 1
    return first, end, np.searchsorted(first, at, "left")


class _Hashed:
    """Words of the texts of one step, their places in the text, and hashes of runs."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        first, end, self.begin = words_of(data, at)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(self.begin))
        self.place = np.arange(len(first)) - self.begin[self.text]
        self.size = np.diff(self.begin)[self.text]
        self.runs = Substrings(Substrings(data).of(first, end))

    def anchors(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Covered places (counted over all texts) with a whole anchor, and its hash."""
        period, cover = cover_for(span)
        gram = span - period + 1
        covered = np.zeros(period, bool)
        covered[list(cover)] = True
        at = np.flatnonzero(covered[self.place % period] & (self.place + gram <= self.size) & (self.size >= span))
        return at, self.runs.of(at, at + gram)


def _shared(docs: DataFrame, span: int) -> DataFrame:
    """(g): anchors of two documents at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part, starts in steps(*as_bytes(batch.column("text"))):
                hashed = _Hashed(part, starts)
                at, g = hashed.anchors(span)
                text = hashed.text[at]
                order = np.argsort(g, kind="stable")
                g, text = g[order], text[order]
                new = np.append(True, g[1:] != g[:-1])[: len(g)]
                begins = np.flatnonzero(new)
                # How many of these texts have the anchor: two say as much as more.
                apart = new | np.append(True, text[1:] != text[:-1])[: len(g)]
                n = np.add.reduceat(apart, begins, dtype=np.int64) if len(begins) else begins
                yield pa.RecordBatch.from_arrays([pa.array(g[begins].view(np.int64)), pa.array(np.minimum(n, 2))], names=["g", "n"])

    found = docs.select("text").mapInArrow(work, "g long, n long")
    return found.groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select("g")


def _bit_table(shared: DataFrame) -> np.ndarray:
    """One bit for the first ``TABLE_BITS`` bits of each anchor; built in slices, whose
    size does not depend on the input."""
    of_slice = TABLE_BITS - (SLICES - 1).bit_length()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column("g").to_numpy().view(np.uint64) >> np.uint64(64 - TABLE_BITS)
            number = place >> np.uint64(of_slice)
            for s in np.unique(number):
                bits = slices.setdefault(int(s), np.zeros(1 << of_slice, bool))
                bits[(place[number == s] & np.uint64((1 << of_slice) - 1)).astype(np.int64)] = True
        for s, bits in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["slice", "bits"])

    dealt = shared.repartition(SLICES, F.shiftrightunsigned("g", 64 - (SLICES - 1).bit_length()))
    table = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    width = (1 << of_slice) // 8
    # SLICES rows of the same size: bounded.
    for row in dealt.mapInArrow(work, "slice long, bits binary").collect():
        table[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return table


_ROWS = "late boolean, h1 long, h2 long, doc long, k long, win long"


def _rows(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, k: np.ndarray, win: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch; those of a class that are not its least document are late
    already, and travel under hashes of their own."""
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, k, win = h1[order], h2[order], doc[order], k[order], win[order]
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(h1)]
    late = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else np.zeros(0, bool)
    h1 = np.where(late, mixed(k.view(np.uint64) ^ mixed(win.view(np.uint64))), h1)
    return pa.RecordBatch.from_arrays(
        [pa.array(late), *(pa.array(x.view(np.int64)) for x in (h1, np.where(late, np.uint64(0), h2), doc, k, win))],
        names=["late", "h1", "h2", "doc", "k", "win"],
    )


def _later(rows: DataFrame) -> DataFrame:
    """Mark as late all rows of a class (h1, h2) but those of its least document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            late, h1, h2, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("late", "h1", "h2", "doc"))
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            new[0] = last != (h1[0], h2[0])
            begins = np.flatnonzero(new)
            leasts = np.append(least, doc[begins])
            number = np.cumsum(new)
            now = late | (doc > leasts[number])
            last, least = (h1[-1], h2[-1]), leasts[number[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(now), *batch.columns[1:]], names=batch.schema.names)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "h1", "h2").sortWithinPartitions("h1", "h2", "doc").mapInArrow(work, _ROWS)


def _surroundings(docs: DataFrame, span: int, shared: DataFrame) -> DataFrame:
    """A row for each anchor in the bit table: h1 its hash, h2 the hash of all windows
    around it, win the first of these windows and how many follow."""
    table = shared.sparkSession.sparkContext.broadcast(_bit_table(shared))
    period, _ = cover_for(span)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "k"))
            for row, _, part, starts in steps(*as_bytes(batch.column("text"))):
                hashed = _Hashed(part, starts)
                at, g = hashed.anchors(span)
                place = (g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                ok = (table.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                at, g = at[ok], g[ok]
                place, size, text = hashed.place[at], hashed.size[at], hashed.text[at]
                lo = np.maximum(0, place - period + 1)
                hi = np.minimum(place, size - span)
                before = place - lo
                around = hashed.runs.of(at - before, at + (hi - place) + span)
                shape = (before * period + (hi - lo)).astype(np.uint64)
                yield _rows(g, mixed(around + shape), ids[row + text], keys[row + text], lo * period + (hi - lo))

    return docs.mapInArrow(work, _ROWS)


def _windows(touched: DataFrame, span: int) -> DataFrame:
    """A row for each window that the column ``open`` asks for."""
    period, _ = cover_for(span)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "k"))
            asked = batch.column("open")
            ends = asked.offsets.to_numpy()
            asked = asked.values.to_numpy(zero_copy_only=False)
            for row, end, part, starts in _steps(batch):
                hashed = _Hashed(part, starts)
                wins = asked[ends[row] : ends[end]]
                text = np.repeat(np.arange(end - row), np.diff(ends[row : end + 1]))
                first = hashed.begin[text] + wins // period
                edges = np.zeros(len(hashed.place) + 1, np.int64)
                np.add.at(edges, first, 1)
                np.add.at(edges, first + wins % period + 1, -1)
                at = np.flatnonzero(np.cumsum(edges[:-1]))
                text = hashed.text[at]
                half = span // 2
                h1 = hashed.runs.of(at, at + span)
                with np.errstate(over="ignore"):
                    h2 = mixed(hashed.runs.of(at, at + half) * np.uint64(3) + hashed.runs.of(at + half, at + span))
                yield _rows(h1, h2, ids[row + text], keys[row + text], hashed.place[at] * period)

    return touched.mapInArrow(work, _ROWS)


def _steps(batch: pa.RecordBatch):
    return steps(*as_bytes(batch.column("text")))


def late_windows(docs: DataFrame, span: int = 13) -> DataFrame:
    """(doc, k, wins): windows of ``span`` words that a document of a smaller id has too.
    Each of ``wins`` is the first window's place times the period, plus how many follow.
    ``docs`` has doc (long), k (long) and text."""
    spark = docs.sparkSession
    with noted() as paths:
        shared = stored(_shared(docs, span), "anchors")
        around = stored(_later(_surroundings(docs, span, shared)), "around")
    drop(spark, paths[:1])
    least = around.filter("NOT late")
    differ = least.groupBy("h1").agg(F.min("h2").alias("a"), F.max("h2").alias("b")).filter("a < b").select("h1")
    per_doc = least.join(differ, "h1", "left_semi").groupBy("doc", "k").agg(F.collect_list("win").alias("open"))
    single = _later(_windows(docs.join(per_doc, ["doc", "k"]), span))
    found = around.filter("late").unionByName(single.filter("late")).select("doc", "k", "win")
    found = stored(found.groupBy("doc", "k").agg(F.collect_set("win").alias("wins")), "late")
    drop(spark, paths[1:])
    return found


def remove_later(docs: DataFrame, span: int = 13, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All other columns of ``docs`` in ``row``, with ``n_words``, ``n_removed``, ``spans``
    (array of (first, end) words removed) and ``kept`` (the other words, joined by one
    space).

    Words are runs of anything but blanks, tabs and line ends. Removes each word covered
    by ``span`` words in a row that also stand in a document with a smaller id; passages
    repeated within one document, or in rows of the same id, stay. Ids are integers; a
    null id counts as the largest, 2**63 - 1. A null text has no words, and texts of fewer than
    ``span`` words stay whole. Any column may have any name; texts are of any length.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    # Rows of one id are told apart by a hash of the text.
    given = docs.select(others(docs, text_col), text.alias("text"), id_.alias("doc"), F.xxhash64(F.lit(13), text).alias("k"))
    return _cut(given.join(late_windows(given.drop("row").select("doc", "k", "text"), span), ["doc", "k"], "left"), span)


def _cut(joined: DataFrame, span: int) -> DataFrame:
    period, _ = cover_for(span)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wins, rows = batch.column("wins"), batch.column("row")
            for row, end, part, starts in _steps(batch):
                first, stop, begin = words_of(part, starts)
                asked = wins.slice(row, end - row)
                n = np.array([0 if x is None else x for x in asked.value_lengths().to_pylist()], np.int64)
                asked = asked.flatten().to_numpy(zero_copy_only=False)
                from_ = begin[np.repeat(np.arange(end - row), n)] + asked // period
                edges = np.zeros(len(first) + 1, np.int64)
                np.add.at(edges, from_, 1)
                np.add.at(edges, from_ + asked % period + span, -1)
                gone = np.cumsum(edges[:-1]) > 0
                yield _result(rows.slice(row, end - row), part, starts, first, stop, begin, gone)

    schema = T.StructType([
        joined.schema["row"],
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.StringType()),
    ])
    return joined.select("row", "text", "wins").mapInArrow(work, schema)


def _result(rows, data, at, first, stop, begin, gone) -> pa.RecordBatch:
    text = np.repeat(np.arange(len(at) - 1), np.diff(begin))
    sums = np.append(0, np.cumsum(gone))
    # Runs of removed words, within texts.
    bound = np.zeros(len(gone) + 1, bool)
    bound[begin] = True
    before, after = np.append(False, gone)[: len(gone)], np.append(gone[1:], False)[: len(gone)]
    opens, ends = np.flatnonzero(gone & (~before | bound[:-1])), np.flatnonzero(gone & (~after | bound[1:])) + 1
    base = begin[text[opens]]
    pairs = pa.StructArray.from_arrays([pa.array(opens - base), pa.array(ends - base)], names=["first", "end"])
    # Bytes of kept words, and the byte behind each but a text's last, as a blank.
    stays = np.flatnonzero(~gone)
    edges = np.zeros(len(data) + 1, np.int8)
    edges[first[stays]] += 1
    edges[stop[stays]] -= 1
    keep = np.cumsum(edges[:-1], dtype=np.int8) > 0
    behind = stop[stays][np.append(text[stays][1:] == text[stays][:-1], False)[: len(stays)]]
    keep[behind] = True
    data = data.copy()
    data[behind] = 0x20
    lengths = np.append(0, np.cumsum(keep))[at]
    kept = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(data[keep].tobytes()))
    return pa.RecordBatch.from_arrays(
        [
            rows,
            pa.array(np.diff(begin)),
            pa.array(np.diff(sums[begin])),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(opens, begin, "left"), pa.int32()), pairs),
            kept.cast(pa.string()),
        ],
        names=["row", "n_words", "n_removed", "spans", "kept"],
    )
