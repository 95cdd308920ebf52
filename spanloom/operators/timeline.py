"""Timeline bars: where each span lies inside its execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import component_type, truthy, with_times
from spanloom.operators.ordering import nulls_last, rank_within

MIN_RANGE_MS = 100.0
MIN_BAR_MS = 1.0
OPEN_END_MS = 10.0
GRID_MS = 100.0


def _ms_after(at: str, origin: str) -> Column:
    return (F.unix_micros(at) - F.unix_micros(origin)) / F.lit(1000.0)


def timeline_positions(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """Add row, start, end and duration in ms from the first time of the execution.

    Bounds come from one aggregation that is joined back; the bounds side has one
    row per execution.
    """
    spans = with_times(spans).select(
        by, "seq", "span_id", "component", "start_at", "end_at", truthy("error").alias("has_error")
    )
    bounds = spans.groupBy(by).agg(
        F.min(F.least("start_at", "end_at")).alias("_min"),
        F.max(F.greatest("start_at", "end_at")).alias("_max"),
        F.count(F.lit(1)).alias("_spans"),
    )
    placed = spans.join(bounds, by).withColumn("_at", F.coalesce("start_at", "_min"))
    ranked = rank_within(
        placed,
        [by],
        [*nulls_last("_at"), F.col("start_at").isNull(), F.col("seq")],
    )
    row = F.col("pos") - 1
    timed = F.col("_min").isNotNull()
    start = F.when(timed, F.coalesce(_ms_after("start_at", "_min"), F.lit(0.0))).otherwise(row * GRID_MS)
    end = F.when(
        timed, F.coalesce(_ms_after("end_at", "_min"), F.col("start_ms") + OPEN_END_MS)
    ).otherwise((row + 1) * GRID_MS)
    duration = F.when(timed, F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(MIN_BAR_MS))).otherwise(GRID_MS)
    width = F.when(timed, F.greatest(_ms_after("_max", "_min"), F.lit(MIN_RANGE_MS))).otherwise(F.col("_spans") * GRID_MS)
    return (
        ranked.withColumn("start_ms", start)
        .withColumn("end_ms", end)
        .select(
            by,
            "span_id",
            "seq",
            row.cast("long").alias("row"),
            "start_ms",
            "end_ms",
            duration.alias("duration_ms"),
            width.alias("range_ms"),
            component_type().alias("component_type"),
            "has_error",
        )
    )


def with_critical(positions: DataFrame, critical: DataFrame, by: str = "exec_id") -> DataFrame:
    """Add `is_critical`: whether a bar lies on the critical path."""
    path = critical.select(by, "span_id").distinct().withColumn("_on", F.lit(True))
    return positions.join(path, [by, "span_id"], "left").withColumn("is_critical", F.coalesce("_on", F.lit(False))).drop("_on")


def timeline_statistics(positions: DataFrame, critical: DataFrame, by: str = "exec_id") -> DataFrame:
    """Summed duration, spans on the critical path and failed spans per execution."""
    path = critical.groupBy(by).agg(F.count(F.lit(1)).alias("critical_spans"))
    return (
        positions.groupBy(by)
        .agg(
            F.sum("duration_ms").alias("total_duration_ms"),
            F.count_if("has_error").alias("error_spans"),
        )
        .join(path, by, "left")
        .fillna(0, ["critical_spans"])
    )
