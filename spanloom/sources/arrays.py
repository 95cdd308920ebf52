"""Elements of JSON array files of any size, read by many tasks each.

Spark reads such a file in pieces that end at a comma, so its blocks are shared by many
tasks. A comma parts two elements if it stands outside of strings and directly in the
outer array; that depends on all the text before it. So the blocks are first summed up:
for both cases, that a block begins inside a string or not, how it changes the quote
state and the depth, and how many commas stand at each depth. A scan over the sums of
a file, one small row for each block, tells where each block begins. Then every block
cuts its own elements; only what crosses a border is put together by a grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.ordering import running_total
from spanloom.session import shipped, stored
from spanloom.sources.positions import SENT_BLOCKS

_QUOTE, _ESCAPE, _COMMA = b'"\\,'
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("["), ord("{")]] = 1
_DEPTH[[ord("]"), ord("}")]] = -1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


def _quoted(data: np.ndarray) -> np.ndarray:
    """For each byte, whether an odd number of quotes that open or close a string has
    been seen up to it (the byte itself included)."""
    place = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != _ESCAPE, place, -1))
    before = np.append(-1, plain[:-1])
    escaped = (place - 1 - before) % 2 == 1
    return np.cumsum((data == _QUOTE) & ~escaped) % 2 == 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch in parts of one (file, block)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block").to_numpy()
        same = (block[1:] == block[:-1]) & (file.slice(1).to_numpy(zero_copy_only=False) == file.slice(0, len(file) - 1).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield (file[a].as_py(), int(block[a])), batch.slice(a, b - a)


def _text(part: pa.RecordBatch) -> bytes:
    """The pieces with their commas; the one behind a file's end parts nothing."""
    return b"".join(v + b"," for v in part.column("value").cast(pa.binary()).to_pylist())


class _Sums:
    """What a block does to the text before it, for both quote states at its start."""

    def __init__(self) -> None:
        self.flips, self.depth, self.commas, self.filled = False, [0, 0], [{}, {}], 0

    def feed(self, text: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        quoted = _quoted(data) ^ self.flips
        for state in (0, 1):
            outside = quoted == bool(state)
            depth = self.depth[state] + np.cumsum(np.where(outside, _DEPTH[data], 0))
            at, n = np.unique(depth[outside & (data == _COMMA)], return_counts=True)
            for d, m in zip(at.tolist(), n.tolist(), strict=True):
                self.commas[state][d] = self.commas[state].get(d, 0) + m
            self.depth[state] = int(depth[-1])
        self.flips = bool(quoted[-1])
        self.filled += int((~_BLANK[data] & (data != _COMMA)).sum())


_SUMS = "file string, block long, flips boolean, depth array<long>, commas array<map<long,long>>, filled long"
_STARTS = "file string, block long, quoted boolean, depth long, element long, elements long"


def _sums(raw: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, _Sums()

        def row() -> pa.RecordBatch:
            kinds = pa.map_(pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([last[0]]), pa.array([last[1]]), pa.array([sums.flips]), pa.array([sums.depth], pa.list_(pa.int64())),
                    pa.array([[list(c.items()) for c in sums.commas]], pa.list_(kinds)), pa.array([sums.filled]),
                ],
                names=["file", "block", "flips", "depth", "commas", "filled"],
            )

        for name, part in _runs(batches):
            if name != last and last is not None:
                yield row()
                sums = _Sums()
            last = name
            sums.feed(_text(part))
        if last is not None:
            yield row()

    return raw.select("file", "block", "value").mapInArrow(work, _SUMS)


def _starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """Quote state, depth and element at the start of each block of one file."""
    quoted, depth, element, filled, out = False, 0, 0, 0, []
    for row in blocks.sort_values("block").itertuples(index=False):
        out.append((row.file, row.block, quoted, depth, element))
        state = int(quoted)
        element += dict(row.commas[state]).get(1 - depth, 0)
        depth += int(row.depth[state])
        quoted, filled = quoted ^ row.flips, filled + row.filled
    found = pd.DataFrame(out, columns=["file", "block", "quoted", "depth", "element"])
    # Nothing between the brackets is no element.
    return found.assign(elements=element + 1 if filled > 2 else 0)


class _Cutter:
    """Elements of one block, from its start on."""

    def __init__(self, quoted: bool, depth: int, element: int):
        self.quoted, self.depth, self.element = quoted, depth, element
        # Text before the outer bracket is no part of an element.
        self.held, self.within, self.whole = [], depth > 0, False

    def feed(self, text: bytes) -> Iterator[tuple[int, bool, bytes]]:
        data = np.frombuffer(text, np.uint8)
        inside = _quoted(data) ^ self.quoted
        change = np.where(inside, 0, _DEPTH[data])
        depth = self.depth + np.cumsum(change)
        opens = (change == 1) & (depth == 1)
        closes = (change == -1) & (depth == 0)
        parts = ~inside & (data == _COMMA) & (depth == 1)
        begin = 0
        for at in np.flatnonzero(opens | closes | parts).tolist():
            if self.within:
                yield self.element, self.whole, b"".join([*self.held, text[begin:at]])
            self.held, begin = [], at + 1
            if parts[at]:
                self.element += 1
            self.within, self.whole = not closes[at], True
        if self.within:
            self.held.append(text[begin:])
        self.quoted, self.depth = bool(inside[-1]), int(depth[-1])

    def rest(self) -> Iterator[tuple[int, bool, bytes]]:
        if self.within:
            yield self.element, False, b"".join(self.held)


_CUT = "file string, block long, element long, whole boolean, text string"


def _cut(raw: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cutter = None, None

        def rows(found) -> pa.RecordBatch:
            n, whole, texts = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]] * len(n)), pa.array([last[1]] * len(n)), pa.array(n), pa.array(whole), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["file", "block", "element", "whole", "text"],
            )

        for name, part in _runs(batches):
            if name != last:
                if cutter and (found := list(cutter.rest())):
                    yield rows(found)
                last = name
                cutter = _Cutter(*(part.column(c)[0].as_py() for c in ("quoted", "depth", "element")))
            if found := list(cutter.feed(_text(part))):
                yield rows(found)
        if cutter and (found := list(cutter.rest())):
            yield rows(found)

    return raw.select("file", "block", "value", "quoted", "depth", "element").mapInArrow(work, _CUT)


def array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq, file, number, json): elements of files that hold one JSON array each.

    `number` counts from 0 in the file, `seq` on from file to file in the order of their
    paths. Text is that of the file. Of a broken file what can be cut is kept; an
    element crossing blocks is put together in one task, so it must fit there.
    """
    shipped(spark)
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    # One small row for each block; those of one file meet.
    starts = stored(_sums(raw).groupBy("file").applyInPandas(_starts, _STARTS), "blocks")
    files = running_total(starts.select("file", "elements").distinct(), ["file"], "elements")
    if starts.count() <= SENT_BLOCKS:
        begun = raw.join(F.broadcast(starts), ["file", "block"])
    else:
        begun = raw.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "id")
    pieces = _cut(begun)
    crossing = pieces.filter("NOT whole").groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"))
    crossing = crossing.select("file", "element", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    found = pieces.filter("whole").select("file", "element", "text").unionByName(crossing)
    found = found.withColumn("json", F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", "")).filter("json <> ''")
    # One row for each file; how it is joined is left to Spark.
    return found.join(files.select("file", "before"), "file").select(
        (F.col("before") + F.col("element")).alias("seq"), "file", F.col("element").alias("number"), "json"
    )
