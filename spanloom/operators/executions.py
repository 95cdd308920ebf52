"""Executions: which spans belong together by id, and what each execution did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import first_truthy, present, ratio, truthy, unreadable_time, with_times

# Order in which ids name an execution.
VIEW_IDS = ["trace_id", "agent_session_id", "session_id", "request_id", "xray_id"]
DERIVE_IDS = ["trace_id", "request_id", "agent_session_id"]


def assign_executions(spans: DataFrame, ids: list[str] = VIEW_IDS) -> DataFrame:
    """Set `exec_id` to the first id that is present; null marks an orphan."""
    return spans.withColumn("exec_id", first_truthy(*ids))


def orphan_spans(spans: DataFrame) -> DataFrame:
    """Spans of `assign_executions` that carry no id."""
    return spans.filter(F.col("exec_id").isNull())


def execution_status(errors: Column, retries: Column) -> Column:
    return (
        F.when(errors > 0, "error").when(retries > 0, "warning").otherwise("passed")
    )


def execution_summary(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """One row per execution: start, size, duration, status, components.

    A single aggregation with partial sums on the map side; a hot execution costs
    one small partial row per input task.
    """
    spans = with_times(spans).filter(F.col(by).isNotNull())
    facts = spans.groupBy(by).agg(
        F.min("start_at").alias("_start"),
        F.max("end_at").alias("_end"),
        F.bool_or(unreadable_time()).alias("_unreadable"),
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(present("error")).alias("error_count"),
        F.count_if(F.col("attempt") > 1).alias("retry_count"),
        F.collect_set(F.when(F.col("component") != "", F.col("component"))).alias("_components"),
    )
    return facts.select(
        by,
        F.when(~F.col("_unreadable"), F.col("_start")).alias("started_at"),
        "span_count",
        F.coalesce(
            F.when(
                ~F.col("_unreadable"),
                (F.unix_micros("_end") - F.unix_micros("_start")) / F.lit(1000.0),
            ),
            F.lit(0.0),
        ).alias("duration_ms"),
        execution_status(F.col("error_count"), F.col("retry_count")).alias("status"),
        "error_count",
        "retry_count",
        F.sort_array("_components").alias("components"),
    )


def newest_first(executions: DataFrame, by: str = "exec_id") -> DataFrame:
    return executions.orderBy(F.col("started_at").desc_nulls_last(), F.col(by))


def filter_executions(executions: DataFrame, kind: str = "all") -> DataFrame:
    """`errors`, `warnings` (errors included) or `passed`; anything else keeps all."""
    wanted = {
        "errors": ["error"],
        "warnings": ["warning", "error"],
        "passed": ["passed"],
    }.get(kind)
    return executions.filter(F.col("status").isin(wanted)) if wanted else executions


def view_totals(spans: DataFrame) -> DataFrame:
    """One row over all executions and orphans of `assign_executions`."""
    per_execution = execution_summary(spans).select("status", F.lit(0).alias("orphan"))
    orphans = orphan_spans(spans).select(F.lit(None).cast("string").alias("status"), F.lit(1).alias("orphan"))
    both = per_execution.unionByName(orphans)
    total = F.count_if(F.col("status").isNotNull())
    passed = F.count_if(F.col("status") == "passed")
    return both.agg(
        total.alias("executions"),
        passed.alias("passed"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
        F.coalesce(F.sum("orphan"), F.lit(0)).alias("orphan_spans"),
        (ratio(passed, total) * 100).alias("pass_rate"),
    )


def rule_statistics(results: DataFrame) -> DataFrame:
    """One row: rules checked over all executions (`run_invariants`) and rules passed."""
    return results.agg(F.count_if("passed").alias("invariants_passed"), F.count(F.lit(1)).alias("invariants_total"))


def run_statistics(spans: DataFrame) -> DataFrame:
    """Spans, distinct components and operations, error spans of a whole run."""
    pairs = spans.groupBy("component", "operation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(truthy("error")).alias("e")
    )
    return pairs.agg(
        F.sum("n").alias("span_count"),
        F.count_distinct("component").alias("components"),
        F.count_distinct("operation").alias("operations"),
        F.sum("e").alias("error_spans"),
    )
