"""Parent look-ups inside an execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_id(spans: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """(by, parent_span_id, name): one row per span id, the last one written wins."""
    return (
        spans.groupBy(by, F.col("span_id").alias("parent_span_id"))
        .agg(F.max_by(value, "seq").alias(name))
    )


def with_parent(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """Add `parent_component`, null when the parent is absent or not set.

    The right side is unique per (execution, span id), so a parent shared by very
    many children is a skewed probe side only, which the adaptive join splits.
    """
    parents = latest_by_id(spans, by, "component", "parent_component")
    return spans.join(parents, [by, "parent_span_id"], "left")


def with_callers(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """Add `caller`: the parent's component, or the span's own."""
    joined = with_parent(spans, by)
    return joined.withColumn("caller", F.coalesce("parent_component", "component"))


def caller_edges(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """How often each component calls another."""
    return (
        with_callers(spans.select(by, "seq", "span_id", "parent_span_id", "component"), by)
        .groupBy("caller", "component")
        .agg(F.count(F.lit(1)).alias("calls"))
    )


def spans_without_parent(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """Spans whose parent is set but not part of the execution."""
    joined = with_parent(spans, by)
    return joined.filter(
        F.col("parent_span_id").isNotNull() & F.col("parent_component").isNull()
    ).drop("parent_component")
