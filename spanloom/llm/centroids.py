"""Lloyd's centroid clustering in integers, with a filter in PCA-rotated coordinates.

Vectors are turned into integers, so that assignments, sums and centroids are exact and
the same however the rows are dealt. What is costly, the distance to every centroid, is
avoided by a bound: the principal axes of all vectors are found once, and each vector
keeps its leading rotated coordinates and the norm of the rest. For a centroid rotated
the same way, the squared distance of the leading coordinates plus the squared
difference of the two residual norms is never more than the squared distance. Centroids
whose bound exceeds the distance to the most promising one leave; the others are
verified in integers.

What reaches the driver is bounded by the number of centroids and dimensions: sums for
each of both. The rows stay where they are; no round shuffles them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.rows import lists, others, stored

#: Leading coordinates kept of each vector.
LEAD = 8

#: Integers of a component are smaller than this in size, so that distances fit 64 bits.
MOST = 1 << 26

#: Rows that one numpy step works on.
STEP_ROWS = 1 << 14


def _whole(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is complete and finite, and their components as integers."""
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(np.nan_to_num(length.astype(float), nan=-1) == dims)
    # A null component arrives as NaN.
    flat = column.take(pa.array(rows, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(-1, dims)
    ok = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[ok])
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"a component times {scale} is {MOST} or more: distances would not fit 64 bits")
    return rows[ok], x.astype(np.int64)


def _sums(partials: DataFrame) -> dict[int, dict[int, int]]:
    """Sums of the lists ``sums`` by ``cluster`` and place in the list; exact."""
    spread = partials.select("cluster", F.posexplode("sums").alias("pos", "x"))
    total = spread.groupBy("cluster", "pos").agg(F.sum(F.col("x").cast(T.DecimalType(38, 0))).alias("x"))
    out: dict[int, dict[int, int]] = {}
    # One row for each centroid and dimension: bounded.
    for row in total.collect():
        out.setdefault(row["cluster"], {})[row["pos"]] = int(row["x"])
    return out


def principal_axes(vectors: DataFrame, dims: int, scale: float, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``lead`` axes of greatest spread (columns), over all vectors of ``v``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = _whole(batch.column("v"), dims, scale)[1].astype(np.float64)
            n, sums, squares = n + len(x), sums + x.sum(0), squares + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[float(n)], sums, squares.ravel()])], pa.list_(pa.float64()))], names=["sums"])

    spread = vectors.select("v").mapInArrow(work, "sums array<double>").select(F.posexplode("sums").alias("pos", "x"))
    # One row for each pair of dimensions: bounded.
    total = {r["pos"]: r["x"] for r in spread.groupBy("pos").agg(F.sum("x").alias("x")).collect()}
    if not total:
        return np.zeros(dims), np.eye(dims)[:, :lead]
    flat = np.array([total[i] for i in range(1 + dims + dims * dims)])
    mean = flat[1 : 1 + dims] / flat[0]
    spread = flat[1 + dims :].reshape(dims, dims) / flat[0] - np.outer(mean, mean)
    axes = np.linalg.eigh((spread + spread.T) / 2)[1]
    return mean, axes[:, ::-1][:, :lead]


class Rotated:
    """Leading coordinates and residual norm about a mean."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        about = x - self.mean
        lead = about @ self.axes
        return lead, np.sqrt(np.maximum(0.0, (about * about).sum(1) - (lead * lead).sum(1)))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turned) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number), the squared distance in integers,
    and how many distances were computed."""
    c_lead, c_rest = turned
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(2) + (rest[:, None] - c_rest[None]) ** 2
    # More than rounding can have added to the bound.
    size = (lead * lead).sum(1) + rest * rest
    slack = 1e-9 * (size[:, None] + ((c_lead * c_lead).sum(1) + c_rest * c_rest)[None] + 1.0)
    bound = bound - slack
    first = bound.argmin(1)
    exact = lambda rows, c: ((x[rows] - c) ** 2).sum(1)
    best = np.empty(len(x), np.int64)
    for j in range(len(centroids)):
        rows = np.flatnonzero(first == j)
        best[rows] = exact(rows, centroids[j])
    cluster, tried, least = first.copy(), len(x), best.copy()
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= best) & (first != j))
        tried += len(rows)
        d = exact(rows, centroids[j])
        better = (d < least[rows]) | ((d == least[rows]) & (j < cluster[rows]))
        rows = rows[better]
        cluster[rows], least[rows] = j, d[better]
    return cluster, least, tried


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, turned) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    dims = centroids.shape[1]
    x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, dims)
    lead = batch.column("lead").flatten().to_numpy()
    lead = lead.reshape(len(x), -1)
    rest = batch.column("rest").to_numpy()
    for i in range(0, len(x), STEP_ROWS):
        j = slice(i, i + STEP_ROWS)
        cluster, distance, _ = nearest(x[j], lead[j], rest[j], centroids, turned)
        yield i, x[j], cluster, distance


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0,
    lead: int = LEAD, vector_col: str = "embedding", id_col: str = "vec_id",
) -> DataFrame:
    """All other columns of ``vectors`` in ``row``, with ``cluster``, ``distance``
    (squared), ``cluster_inertia``, ``inertia`` and ``centroid`` (list of integers).

    Keeps vectors of exactly ``dims`` components, none null or non-finite; each
    component x becomes floor(scale * x). Starts with the ``k`` kept vectors whose
    sha256 of ``1:<id>`` is smallest (a null id: empty text; ties, as in repeated rows:
    the lexicographically smaller vector), fewer if there are fewer. Each round assigns
    every vector to the nearest centroid (ties: the smaller number) and moves every
    centroid that has vectors to the floor of their mean; one more assignment follows.
    No vectors give no rows. Components of 2**26 and more after scaling fail the job,
    since distances would not fit 64 bits. Any column may have any name.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    tag = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    given = vectors.select(others(vectors, vector_col), v, tag.alias("tag"))
    turn = Rotated(*principal_axes(given, dims, scale, lead))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _whole(batch.column("v"), dims, scale)
            at = pa.array(rows, pa.int64())
            leads, rest = turn.of(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(at),
                    batch.column("tag").take(at),
                    lists(x.astype(np.int32).ravel(), np.arange(len(x) + 1) * dims, pa.int32()),
                    lists(leads.ravel(), np.arange(len(x) + 1) * leads.shape[1], pa.float64()),
                    pa.array(rest),
                ],
                names=["row", "tag", "x", "lead", "rest"],
            )

    kept_type = T.StructType([
        given.schema["row"],
        T.StructField("tag", T.StringType()),
        T.StructField("x", T.ArrayType(T.IntegerType())),
        T.StructField("lead", T.ArrayType(T.DoubleType())),
        T.StructField("rest", T.DoubleType()),
    ])
    kept = stored(given.mapInArrow(keep, kept_type), "rotated")
    start = kept.select("tag", "x").orderBy("tag", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in start], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(kept, centroids, turn)
    return _result(kept, centroids, turn)


def _moved(kept: DataFrame, centroids: np.ndarray, turn: Rotated) -> np.ndarray:
    turned, (k, dims) = turn.of(centroids.astype(np.float64)), centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for _, x, cluster_, _ in _assigned(batch, centroids, turned):
                np.add.at(sums[:, 0], cluster_, 1)
                for j in np.unique(cluster_):
                    sums[j, 1:] += x[cluster_ == j].sum(0)
        some = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), lists(sums[some].ravel(), np.arange(len(some) + 1) * (dims + 1), pa.int64())], names=["cluster", "sums"]
        )

    totals = _sums(kept.select("x", "lead", "rest").mapInArrow(work, "cluster long, sums array<long>"))
    moved = centroids.copy()
    for j, sums in totals.items():
        moved[j] = [sums[1 + i] // sums[0] for i in range(dims)]
    return moved


def _result(kept: DataFrame, centroids: np.ndarray, turn: Rotated) -> DataFrame:
    turned = turn.of(centroids.astype(np.float64)) if len(centroids) else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, cluster_, distance in _assigned(batch, centroids, turned):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, len(x)), pa.array(cluster_.astype(np.int32)), pa.array(distance)], names=["row", "cluster", "distance"]
                )

    found = T.StructType([kept.schema["row"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = stored(kept.select("row", "x", "lead", "rest").mapInArrow(work, found), "assigned")
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(T.DecimalType(38, 0))).alias("total")).collect()
    inertia = {r["cluster"]: int(r["total"] or Decimal(0)) for r in totals}
    # One entry for each centroid: bounded.
    of_each = F.array(*[
        F.struct(
            F.lit(inertia.get(j, 0)).cast("long").alias("cluster_inertia"),
            F.array(*[F.lit(int(x)).cast("long") for x in c]).alias("centroid"),
        )
        for j, c in enumerate(centroids)
    ] or [F.lit(None).cast("struct<cluster_inertia: bigint, centroid: array<bigint>>")])
    mine = F.get(of_each, F.col("cluster"))
    return assigned.select(
        "row", "cluster", "distance", mine["cluster_inertia"].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), mine["centroid"].alias("centroid"),
    )
