"""Stitching spans that share correlation ids, directly or through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import truthy
from spanloom.operators.components import connected_components

# Key prefix per id column.
KEY_PREFIXES = {
    "trace_id": "trace",
    "request_id": "lambda",
    "xray_id": "xray",
    "message_id": "sqs",
    "agent_session_id": "bedrock",
    "thread_id": "thread",
    "session_id": "session",
}


def correlation_keys(columns: list[str]) -> Column:
    """Typed keys of a span. A session id written like a chat timestamp also counts
    as a thread."""
    keys = [
        F.when(truthy(name), F.concat(F.lit(prefix + ":"), F.col(name)))
        for name, prefix in KEY_PREFIXES.items()
        if name in columns
    ]
    if "session_id" in columns:
        digits = F.replace(F.col("session_id"), F.lit("."), F.lit(""))
        chat_like = F.contains("session_id", F.lit(".")) & digits.rlike("^[0-9]+$")
        keys.append(F.when(chat_like, F.concat(F.lit("thread:"), F.col("session_id"))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def key_index(spans: DataFrame) -> DataFrame:
    """(key, span_id): one row per key of each span."""
    return spans.select(
        F.explode(correlation_keys(spans.columns)).alias("key"), "span_id"
    ).distinct()


def links_between(keys: Column, rows: DataFrame) -> DataFrame:
    """Links from the least key of a row to its other keys: a star, never all pairs."""
    low = F.array_min("_keys")
    return (
        rows.select(keys.alias("_keys"))
        .filter(F.size("_keys") > 1)
        .select(F.explode("_keys").alias("src"), low.alias("dst"))
        .filter(F.col("src") != F.col("dst"))
        .distinct()
    )


def stitch(spans: DataFrame) -> DataFrame:
    """Spans plus `group_id`, null for spans without any key.

    The graph has the distinct keys as nodes, so repeated use of a key, however
    often, is gone before the first round. A key used by very many spans only shows
    in the last join, as a skewed probe side.
    """
    keyed = spans.withColumn("_key", F.array_min(correlation_keys(spans.columns)))
    groups = connected_components(links_between(correlation_keys(spans.columns), spans))
    labels = groups.select(F.col("node").alias("_key"), F.col("label").alias("_label"))
    return (
        keyed.join(labels, "_key", "left")
        .withColumn("group_id", F.coalesce("_label", "_key"))
        .drop("_key", "_label")
    )


def stitch_groups(stitched: DataFrame) -> DataFrame:
    """(group_id, spans): size of each group."""
    return (
        stitched.filter(F.col("group_id").isNotNull())
        .groupBy("group_id")
        .agg(F.count_distinct("span_id").alias("spans"))
    )


def expand_from(stitched: DataFrame, seeds: DataFrame) -> DataFrame:
    """Spans reachable from the seed spans (column `span_id`): all spans of the
    groups that hold a seed, and seeds without any key themselves."""
    hit = stitched.join(seeds.select("span_id").distinct(), "span_id", "left_semi")
    groups = hit.filter(F.col("group_id").isNotNull()).select("group_id").distinct()
    lone = hit.filter(F.col("group_id").isNull())
    return stitched.join(groups, "group_id", "left_semi").unionByName(lone)
