"""Keyed state with event-time timers: sessions and windows that show what is still
open and what came late, and ids seen before.

A stream of spans is first summed up within each batch of rows of a task, so that a
busy key sends few rows to its state. The state of a key holds its open parts; each
change writes them out as they are now (`open`, newest version counts), a timer writes
a part when the watermark has passed its end (`closed`), and what comes for a time that
has ended by then is written apart (`late`). Nothing is dropped: closed, late and newest
open parts together are all rows, whatever files the stream came in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: Parts: microseconds of the first and last moment, sums, and two more bounds.
PART = "key string, start long, last long, sums array<long>, low long, high long"
PARTS = f"kind string, version long, {PART}"

#: Ids that share a hash share a state: many ids cost few calls, and a state stays small
#: (some thousand ids where a billion are remembered).
BUCKETS = 1 << 18

# Set by Spark for each micro-batch.
_BATCH = "streaming.sql.batchId"


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _most(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def merged(parts: list[list], part: list, gap: int) -> list[list]:
    """`parts` and one more, put together with all that it touches."""
    start, last, sums, low, high = part
    rest = []
    for p in parts:
        if p[0] < last + gap and start < p[1] + gap:
            start, last = min(start, p[0]), max(last, p[1])
            sums = [a + b for a, b in zip(sums, p[2], strict=True)]
            low, high = _least(low, p[3]), _most(high, p[4])
        else:
            rest.append(p)
    return sorted([*rest, [start, last, sums, low, high]])


class OpenParts(StatefulProcessor):
    """Parts of one key that are open: the watermark has not passed last + gap."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("parts", "packed string")

    def _parts(self) -> list[list]:
        kept = self.state.get()
        return json.loads(kept[0]) if kept else []

    def _keep(self, parts: list[list]) -> None:
        if parts:
            self.state.update((json.dumps(parts),))
        else:
            self.state.clear()

    @staticmethod
    def _rows(kind: str, version: int | None, key: str | None, parts: list[list]) -> Iterator[Row]:
        for start, last, sums, low, high in parts:
            yield Row(kind=kind, version=version, key=key, start=start, last=last, sums=sums, low=low, high=high)

    def _shown(self, later: int, key: str | None, parts: list[list]) -> Iterator[Row]:
        version = 2 * int(TaskContext.get().getLocalProperty(_BATCH)) + later
        # A row without a start says that nothing is open any more.
        return self._rows("open", version, key, parts or [[None, None, None, None, None]])

    def _ended(self, part: list, timers) -> bool:
        # Without a watermark yet, nothing has ended.
        passed = timers.getCurrentWatermarkInMs()
        return passed > 0 and part[1] + self.gap <= passed * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        parts, late = self._parts(), []
        before = {p[1] for p in parts}
        for r in rows:
            part = [r["start"], r["last"], list(r["sums"]), r["low"], r["high"]]
            if self._ended(part, timerValues):
                late.append(part)
            else:
                parts = merged(parts, part, self.gap)
        for p in parts:
            if p[1] not in before:
                self.handle.registerTimer(-(-(p[1] + self.gap) // 1000))
        yield from self._rows("late", None, key[0], late)
        if parts:
            self._keep(parts)
            yield from self._shown(0, key[0], parts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        parts = self._parts()
        ended = [p for p in parts if self._ended(p, timerValues)]
        if ended:
            left = [p for p in parts if p not in ended]
            self._keep(left)
            yield from self._rows("closed", None, key[0], ended)
            yield from self._shown(1, key[0], left)

    def close(self) -> None:
        pass


def parts_of(rows: DataFrame, gap: int) -> DataFrame:
    """`rows` (key, start, last, sums, low, high) of a stream, put together by key where
    less than `gap` microseconds part them."""

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            b = batch.sort_values(["key", "start"], kind="stable", na_position="first").reset_index(drop=True)
            number = b.groupby("key", dropna=False, sort=False).ngroup().to_numpy()
            reach = b["last"].groupby(number).cummax().to_numpy()
            new = np.append(True, (number[1:] != number[:-1]) | (b["start"].to_numpy()[1:] >= reach[:-1] + gap))
            island = np.cumsum(new)
            out = b.groupby(island).agg(key=("key", "first"), start=("start", "first"), last=("last", "max"), low=("low", "min"), high=("high", "max"))
            sums = np.add.reduceat(np.array(b["sums"].tolist(), np.int64), np.flatnonzero(new), axis=0)
            yield out.assign(sums=list(sums)).astype({"low": "Int64", "high": "Int64"})[["key", "start", "last", "sums", "low", "high"]]

    return rows.mapInPandas(shrink, PART).groupBy("key").transformWithState(OpenParts(gap), PARTS, "append", "eventTime")


def whole(parts: DataFrame, gap: int) -> DataFrame:
    """A table written by `parts_of`, put together: (key, start, last, sums, low, high,
    open). `open` tells that more may still come in time."""
    shown = parts.filter("kind = 'open'")
    newest = shown.groupBy("key").agg(F.max("version").alias("version"))
    same = F.col("n.key").eqNullSafe(F.col("o.key")) & (F.col("n.version") == F.col("o.version"))
    still = shown.alias("o").join(newest.alias("n"), same, "left_semi").filter("start IS NOT NULL")
    every = parts.filter("kind <> 'open'").unionByName(still)
    inner = Window.partitionBy("key").orderBy("start", "last")
    reach = F.max("last").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") >= reach + gap).cast("int"), F.lit(1))
    numbered = every.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(inner))
    n = F.col("sums")
    return numbered.groupBy("key", "_island").agg(
        F.min("start").alias("start"), F.max("last").alias("last"),
        F.array(*[F.sum(n[i]) for i in range(3)]).alias("sums"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.bool_or(F.col("kind") == "open").alias("open"),
    ).drop("_island")


class SeenIds(StatefulProcessor):
    """Whether an id was seen before, for as long as rows may come late. The ids of a bucket
    are one state, read and written once for all its rows of a micro-batch, with one timer
    for those that end first."""

    def __init__(self, keep_ms: int, names: list[str]):
        self.keep_ms, self.names = keep_ms, names

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "packed string")
        self.row = Row(*self.names, "kind")

    def _seen(self) -> dict[str | None, int]:
        kept = self.state.get()
        return dict(json.loads(kept[0])) if kept else {}

    def _keep(self, seen: dict[str | None, int]) -> None:
        self.state.update((json.dumps(list(seen.items()), ensure_ascii=False),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        seen, least, fresh = None, None, None
        for r in rows:
            at = r["_at"]
            if passed > 0 and at is not None and at < passed * 1000:
                kind = "late"
            elif r["_again"]:
                kind = "repeat"
            else:
                if seen is None:
                    seen = self._seen()
                    least = min(seen.values(), default=None)
                if r["_id"] in seen:
                    kind = "repeat"
                else:
                    kind = "first"
                    seen[r["_id"]] = at // 1000 if at is not None else passed
                    fresh = _least(fresh, seen[r["_id"]])
            yield self.row(*r[: len(self.names)], kind)
        if fresh is not None:
            self._keep(seen)
            if least is None or fresh < least:
                self.handle.registerTimer(fresh + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ended = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1) - self.keep_ms
        seen = self._seen()
        left = {i: at for i, at in seen.items() if at > ended}
        if left and len(left) < len(seen):
            self._keep(left)
            self.handle.registerTimer(min(left.values()) + self.keep_ms)
        elif not left:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def sorted_out(rows: DataFrame, id_col: str, at: str, keep_ms: int) -> DataFrame:
    """Rows of a stream with `kind`: `first` of an id, `repeat`, or `late` (behind the
    watermark). Each row comes out once. A null id is an id."""
    names = rows.columns
    given = rows.select(*names, F.unix_micros(at).alias("_at"), F.col(id_col).cast("string").alias("_id"))
    # The time is no event time from here on: else Spark would drop late rows before they
    # are seen.
    plain = [T.StructField(f.name, f.dataType) for f in given.schema.fields]
    marked = T.StructType([*plain, T.StructField("_again", T.BooleanType())])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(_again=batch["_id"].duplicated())

    # What a batch of rows has twice is known to be a repeat and needs no state, so it
    # need not meet the others of its id.
    key = F.when(F.col("_again"), (F.rand() * BUCKETS).cast("long")).otherwise(F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)))
    keyed = given.mapInPandas(mark, marked).withColumn("_key", key)
    out = T.StructType([*plain[: len(names)], T.StructField("kind", T.StringType())])
    return keyed.groupBy("_key").transformWithState(SeenIds(keep_ms, names), out, "append", "eventTime")
