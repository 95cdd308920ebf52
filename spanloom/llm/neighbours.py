"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to the unit sphere and given three fast pseudo-rotations (random
signs, then a Hadamard transform); its hash is the signed axis nearest to the result.
Each of ``TABLES`` tables has signs of its own. A query probes, in each table, the
``PROBES`` axes nearest to itself (a fixed share of all), and all vectors of the probed
buckets are ranked by their inner product with it, in double precision.

For inner products of vectors of different length: vectors are scaled within bands of
nearly equal length, and what is missing to one becomes an additional component that
queries have not.

The vectors of a bucket are dealt into parts of about ``BLOCK``, and so are the queries
that probe it. Each part of vectors with each part of queries is a group that a task
ranks, so groups are bounded however large a bucket is or however often it is probed. Best
lists are merged by query, where each group sends at most as many as are asked for.

Queries that are left with fewer than were asked for, although there are more candidates
of their dimension, are compared with every vector: they probe all axes of one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.rows import stored


TABLES = 4
#: Of the signed axes of the rotated space, the part that a query probes.
PROBES = 0.25
BLOCK = 4096
ROUNDS = 3
#: Vectors within this factor in length share a scale.
BAND = 1.1


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Unit rows, padded to a power of two, pseudo-rotated for a table."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    for signs in np.random.default_rng([table, n]).choice([-1.0, 1.0], (ROUNDS, n)):
        out *= signs
        h = 1
        while h < n:
            pair = out.reshape(len(out), n // (2 * h), 2, h)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(out), n)
            h *= 2
        out /= np.sqrt(n)
    return out


def axes(x: np.ndarray, probes: float | None, table: int) -> np.ndarray:
    """The nearest signed axis of each row, or the nearest share of them, nearest first."""
    r = rotated(x, table)
    both = np.concatenate([r, -r], axis=1)
    if probes is None:
        return both.argmax(axis=1)[:, None]
    k = max(1, int(np.ceil(probes * both.shape[1])))
    return np.argpartition(-both, k - 1, axis=1)[:, :k] if k < both.shape[1] else np.broadcast_to(np.arange(k), both.shape)


def on_sphere(x: np.ndarray, query: bool) -> np.ndarray:
    """Rows as unit vectors of one more component."""
    length = np.sqrt((x * x).sum(axis=1))
    if query:
        return np.column_stack([x / length[:, None], np.zeros(len(x))])
    scale = BAND ** (np.round(np.log(length) / np.log(BAND)) + 0.5)
    y = x / scale[:, None]
    return np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))])


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return given.filter("id IS NOT NULL AND v IS NOT NULL").filter(~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _hashed(given: DataFrame, probes: float | None, tables: int) -> DataFrame:
    """(id, dim, places): the buckets of each vector, as table * 2**32 + axis."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dim = batch.column("id").to_numpy(), batch.column("dim").to_numpy()
            vectors = batch.column("v")
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
                x = on_sphere(x, probes is not None)
                found = np.concatenate([axes(x, probes, t) + (t << 32) for t in range(tables)], axis=1)
                ends = np.arange(0, found.size + 1, found.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(dim[at]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ravel().astype(np.int64)))],
                    names=["id", "dim", "places"],
                )

    return given.select("id", "dim", "v").mapInArrow(work, "id long, dim int, places array<long>")


def _best(ids: np.ndarray, x: np.ndarray, longest: float, query: np.ndarray, scores: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ids and their scores. ``scores`` of a block are exact but for their last
    bits, which depend on the block; what is chosen by them is summed up again row by row."""
    some = np.flatnonzero(ids != own)
    if len(some) > k:
        # All that could tie with the last one, so that the smaller ids win.
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        lengths = np.sqrt((query * query).sum()) * longest
        margin = 4 * x.shape[1] * np.finfo(np.float64).eps * lengths
        some = some[~(scores[some] < least - margin)]
    exact = (x[some] * query).sum(axis=1)
    order = np.lexsort((ids[some], -exact))[:k]
    return ids[some][order], exact[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, probes: float = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors found nearest to each query, by
    inner product in double precision, ties to the smaller id.

    A query's own id is no candidate of it. Vectors that are null, empty, zero or have
    null or non-finite components take no part, nor have rows without id; vectors of
    different dimensions are never neighbours. Of repeated ids one row counts (that with
    the greatest vector). A query has fewer than ``k`` rows only if it has fewer
    candidates, and then it has them all.
    """
    one = lambda df: _usable(df, id_col, vector_col).groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))
    data, asked = stored(one(vectors), "vectors"), stored(one(queries), "queries")
    placed = _hashed(data, None, tables).select("id", "dim", F.explode("places").alias("place"))
    # Large buckets fall apart into parts.
    parts = placed.groupBy("dim", "place").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    placed = stored(placed.join(parts, ["dim", "place"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"), "placed")
    probed = _hashed(asked, probes, tables).select("id", "dim", F.explode("places").alias("place"))
    probed = probed.join(parts, ["dim", "place"])
    group = ["dim", "place", "part", "ask"]

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids, x = left["id"].to_numpy(), np.stack(left["v"].to_numpy())
        longest = np.sqrt((x * x).sum(axis=1).max())
        out = []
        for a in range(0, len(right), 256):
            some = right.iloc[a : a + 256]
            queries_ = np.stack(some["v"].to_numpy())
            scores = queries_ @ x.T
            for own, query, row in zip(some["id"].to_numpy(), queries_, scores, strict=True):
                best, score = _best(ids, x, longest, query, row, k, own)
                out.append((np.full(len(best), own), best, score))
        q, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    def ranked(placed: DataFrame, probed: DataFrame) -> DataFrame:
        """The ``k`` best of the buckets that each query probes."""
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asks = probed.groupBy("dim", "place").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("asks"))
        blocks = placed.join(asks, ["dim", "place"]).join(data.select("id", "v"), "id").withColumn("ask", each("asks")).drop("asks").groupBy(*group)
        dealt = probed.join(asks, ["dim", "place"]).withColumn("ask", F.pmod(F.xxhash64("id"), F.col("asks")).cast("int"))
        asking = dealt.join(asked.select("id", "v"), "id").withColumn("part", each("parts")).drop("parts", "asks").groupBy(*group)
        found = blocks.cogroup(asking).applyInPandas(rank, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        # At most k for each table, probe and part.
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    found = stored(ranked(placed, probed), "found")
    # One row for each dimension, and one for each of its axes.
    sizes = F.broadcast(data.groupBy("dim").agg(F.count("*").alias("size")))
    own = data.select("id", "dim", F.lit(1).alias("own"))
    had = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("had"))
    counted = asked.select("id", "dim").join(sizes, "dim").join(own, ["id", "dim"], "left").join(had, "id", "left")
    short = counted.filter(F.coalesce("had", F.lit(0)) < F.least(F.lit(k), F.col("size") - F.coalesce("own", F.lit(0))))
    short = stored(short.select("id", "dim"), "short")
    if short.isEmpty():
        return found
    # Each vector is in one bucket of the first table.
    first = F.col("place") < F.lit(1 << 32)
    whole = ranked(placed.filter(first), short.join(F.broadcast(parts.filter(first)), "dim"))
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
