"""Path signatures, and comparing two sets of executions by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import ratio, truthy, unreadable_time, with_times
from spanloom.operators.ordering import nulls_last, rank_within


def path_steps(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """Every span with `pos`, its place on the path: by start time, else by id."""
    spans = with_times(spans)
    untimed = F.when(F.col("start_at").isNull(), F.col("span_id"))
    return rank_within(
        spans,
        [by],
        [*nulls_last("start_at"), untimed, F.col("seq")],
    )


def _digest(text: Column, first: int) -> Column:
    return F.conv(F.substring(F.md5(text), first, 15), 16, 10).cast("decimal(20,0)")


def path_signatures(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """One row per execution: `path_key`, error flag, retries, latency.

    The key is built from sums of per-step digests that include the position. Sums
    can be pre-aggregated on the map side, so the steps of a long execution never
    have to meet in one task, and two paths get the same key only if all their
    steps agree. The steps themselves are rows, see `path_texts`.
    """
    needed = with_times(spans).select(
        by, "seq", "span_id", "component", "operation", "attempt", "start_at", "end_at",
        truthy("error").alias("failed"),
        unreadable_time().alias("unreadable"),
    )
    steps = path_steps(needed, by)
    # Parts carry their length, so that no separator inside a name can shift them.
    sized = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("-"))
    stamped = F.concat_ws("|", F.col("pos").cast("string"), sized("component"), sized("operation"))
    facts = steps.groupBy(by).agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum(_digest(stamped, 1)).alias("_h1"),
        F.sum(_digest(stamped, 17)).alias("_h2"),
        F.bool_or("failed").alias("has_error"),
        F.greatest(F.coalesce(F.max("attempt"), F.lit(0)) - 1, F.lit(0)).alias("retries"),
        F.min("start_at").alias("_start"),
        F.max("end_at").alias("_end"),
        F.bool_or("unreadable").alias("_unreadable"),
    )
    latency = F.when(~F.col("_unreadable"), F.unix_micros("_end") - F.unix_micros("_start"))
    return facts.select(
        by,
        F.md5(F.concat_ws("-", "steps", "_h1", "_h2", "has_error")).alias("path_key"),
        "steps",
        "has_error",
        "retries",
        F.col("_start").alias("started_at"),
        F.coalesce(latency, F.lit(0)).cast("long").alias("latency_us"),
    )


def _example(by: str) -> Column:
    # A path is shown by its earliest execution.
    return F.min_by(by, F.struct(F.coalesce(F.unix_micros("started_at"), F.lit(1 << 62)), F.col(by)))


def path_texts(spans: DataFrame, signatures: DataFrame, by: str = "exec_id") -> DataFrame:
    """(path_key, pos, step): every step of each path, read off its earliest execution."""
    shown = signatures.groupBy("path_key").agg(_example(by).alias(by))
    step = F.concat_ws(":", "component", "operation")
    return path_steps(spans, by).join(shown, by).select("path_key", "pos", step.alias("step"))


def path_stats(signatures: DataFrame, by: str = "exec_id") -> DataFrame:
    """Count, latency and errors per path; sums are whole microseconds, hence exact."""
    return signatures.groupBy("path_key").agg(
        _example(by).alias("example"),
        F.count(F.lit(1)).alias("executions"),
        (F.sum("latency_us") / F.lit(1000.0)).alias("total_latency_ms"),
        (F.min("latency_us") / F.lit(1000.0)).alias("min_latency_ms"),
        (F.max("latency_us") / F.lit(1000.0)).alias("max_latency_ms"),
        (F.sum("latency_us") / F.lit(1000.0) / F.count(F.lit(1))).alias("avg_latency_ms"),
        F.count_if("has_error").alias("errors"),
    )


def compare_by(signatures: DataFrame, is_baseline: str, by: str = "exec_id") -> DataFrame:
    """Per-path difference between the executions with the flag and those without.

    One conditional aggregation on the path gives the rows of a full outer join of
    both sides without scanning or shuffling either of them twice.
    """
    base = F.col(is_baseline)
    sums = signatures.groupBy("path_key").agg(
        _example(by).alias("example"),
        F.count_if(base).alias("baseline_count"),
        F.count_if(~base).alias("current_count"),
        F.coalesce(F.sum(F.when(base, F.col("latency_us"))), F.lit(0)).alias("_bl"),
        F.coalesce(F.sum(F.when(~base, F.col("latency_us"))), F.lit(0)).alias("_cl"),
        F.count_if(base & F.col("has_error")).alias("baseline_errors"),
        F.count_if(~base & F.col("has_error")).alias("current_errors"),
    )
    deltas = (
        sums.withColumn("baseline_avg_ms", ratio(F.col("_bl") / F.lit(1000.0), F.col("baseline_count")))
        .withColumn("current_avg_ms", ratio(F.col("_cl") / F.lit(1000.0), F.col("current_count")))
        .withColumn("is_new", (F.col("baseline_count") == 0) & (F.col("current_count") > 0))
        .withColumn("is_missing", (F.col("baseline_count") > 0) & (F.col("current_count") == 0))
        .withColumn(
            "latency_delta_ms",
            F.when(
                (F.col("baseline_count") == 0) | (F.col("current_count") == 0), F.lit(0.0)
            ).otherwise(F.col("current_avg_ms") - F.col("baseline_avg_ms")),
        )
        .withColumn("latency_delta_pct", ratio(F.col("latency_delta_ms"), F.col("baseline_avg_ms")) * 100)
        .withColumn("baseline_error_rate", ratio(F.col("baseline_errors"), F.col("baseline_count")))
        .withColumn("current_error_rate", ratio(F.col("current_errors"), F.col("current_count")))
        .withColumn("error_rate_delta", F.col("current_error_rate") - F.col("baseline_error_rate"))
    )
    return deltas.drop("_bl", "_cl")


def compare(baseline: DataFrame, current: DataFrame, by: str = "exec_id") -> DataFrame:
    """Per-path difference between two sets of `path_signatures`."""
    both = baseline.withColumn("_baseline", F.lit(True)).unionByName(
        current.withColumn("_baseline", F.lit(False))
    )
    return compare_by(both, "_baseline", by)


def worst_first(deltas: DataFrame) -> DataFrame:
    regression = F.col("is_missing") | (F.col("error_rate_delta") > 0)
    return deltas.orderBy(regression.desc(), F.abs("latency_delta_pct").desc(), "path_key")


def compare_executions(signatures: DataFrame, baseline: str, current: str, by: str = "exec_id") -> DataFrame:
    """Difference between two single executions."""
    pair = signatures.filter(F.col(by).isin(baseline, current))
    return compare_by(pair.withColumn("_baseline", F.col(by) == baseline), "_baseline", by)


def verdict(deltas: DataFrame) -> DataFrame:
    """One row: how many paths are new, missing, slower or faster, failing more, stable."""
    changed = ~F.col("is_new") & ~F.col("is_missing")
    slower = changed & (F.abs("latency_delta_pct") > 10.0)
    failing = changed & (F.col("error_rate_delta") > 0)
    missing = F.count_if("is_missing")
    regressions = F.count_if(failing)
    return deltas.agg(
        F.count_if("is_new").alias("new_paths"),
        missing.alias("missing_paths"),
        F.count_if(slower).alias("latency_changes"),
        regressions.alias("error_regressions"),
        F.count_if(changed & ~slower & ~failing).alias("stable_paths"),
        ((missing > 0) | (regressions > 0)).alias("has_regressions"),
    )
