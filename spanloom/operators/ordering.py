"""Positions and running totals along an order, without any task seeing a whole group.

A plain ``row_number() over (partition by trace order by time)`` sorts every row of a
trace in one task. That is right for most traces. Groups of more than `BUCKET_ROWS` rows
are first cut into ranges of their order, at bounds taken from a sample of the group, so
that ranges are of about the same size however many rows one moment has. Rows are then
numbered within (group, range), and the rows of a group's earlier ranges are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import stored

#: What one task sorts of one group; larger groups are cut.
BUCKET_ROWS = 100_000
#: Sampled rows for each range that is cut.
SAMPLES = 20
#: Ranges up to which their table is sent to all tasks; with more, how it is joined is
#: left to Spark.
SENT_RANGES = 100_000


def nulls_last(c: str) -> list[Column]:
    """Keys that sort nulls last."""
    return [F.col(c).isNull(), F.col(c)]


def _key(order: list[Column]) -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT_RANGES else df


def _bounds(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame | None:
    """(by, _bounds): where large groups are cut, written once so that every use cuts
    alike; none if no group is large."""
    large = stored(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BUCKET_ROWS).select(*by), "large-groups")
    if large.isEmpty():
        return None
    keys = df.join(large, by, "left_semi").select(*by, _key(order).alias("_key")).filter(F.rand(7) < SAMPLES / BUCKET_ROWS)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_key"))
    cuts = keys.withColumn("_place", place).filter(F.col("_place") % SAMPLES == 0)
    return stored(cuts.groupBy(*by).agg(F.array_sort(F.collect_list("_key")).alias("_bounds")), "bounds")


def parted(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame | None:
    """Rows with `_part`, their range within their group (null: the group is not cut);
    none if no group is cut."""
    bounds = _bounds(df, by, order)
    if bounds is None:
        return None
    part = F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))
    keyed = df.withColumn("_key", _key(order)).join(_small(bounds), by, "left")
    return keyed.withColumn("_part", F.when(F.col("_bounds").isNotNull(), part)).drop("_key", "_bounds")


def rank_within(df: DataFrame, by: list[str], order: list[Column], pos: str = "pos", previous: list[str] | None = None) -> DataFrame:
    """Add `pos`, the 1-based position of each row in its group; `order` are ascending
    keys, nulls first (see `nulls_last`).

    `by` must not be null. With `previous`, also adds a struct `prev` of those columns
    of the row before. Group sizes are counted when this is called.
    """
    columns = df.columns
    cut = parted(df, by, order)
    rows, group = (df, by) if cut is None else (cut, [*by, "_part"])
    inner = Window.partitionBy(*group).orderBy(*[k.asc() for k in order])
    out = rows.withColumn(pos, F.row_number().over(inner))
    if previous:
        out = out.withColumn("prev", F.lag(F.struct(*previous)).over(inner))
    if cut is not None:
        # A row for each range of the large groups.
        last = [F.max_by(F.struct(*previous), _key(order)).alias("_last")] if previous else []
        sizes = cut.filter("_part IS NOT NULL").groupBy(*group).agg(F.count(F.lit(1)).alias("_size"), *last)
        outer = Window.partitionBy(*by).orderBy("_part")
        offsets = sizes.withColumn("_before", F.sum("_size").over(outer.rowsBetween(Window.unboundedPreceding, -1)))
        if previous:
            offsets = offsets.withColumn("_carried", F.lag("_last").over(outer)).drop("_last")
        out = out.join(_small(offsets.drop("_size")), group, "left").withColumn(pos, F.col(pos) + F.coalesce("_before", F.lit(0)))
        if previous:
            out = out.withColumn("prev", F.coalesce("prev", "_carried"))
    return out.select(*columns, pos, *(["prev"] if previous else []))


def running_total(df: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """Add `name`, the sum of `value` over all rows earlier in `order`.

    Rows are dealt into ranges of the order and written once, since bounds are sampled
    anew each time a plan runs; totals of the ranges, one row each, are added up.
    """
    columns = df.columns
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(totals, "_part").select(*columns, (F.col("_before") + F.col("_local")).alias(name))
