"""Chains: log entries linked by any shared value, whatever its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.entries import (
    detect_attempt,
    detect_error,
    entry_time,
    infer_operation,
    input_data,
    response_data,
)
from spanloom.operators.ordering import rank_within
from spanloom.operators.components import connected_components
from spanloom.operators.stitch import links_between
from spanloom.session import checkpoint


def _texts():
    return F.array_distinct(F.transform("correlation_values", lambda v: v["value"]))


def chain_entries(entries: DataFrame) -> DataFrame:
    """(idx, component, correlation_values, chain_id, first_index) of the entries of
    chains with two or more members.

    `entries` has idx, component and correlation_values (see
    `spanloom.operators.profile.log_entries`). A chain is called after its first
    entry, so names sort by time and no global numbering is needed. What else an entry
    holds stays out of the loop, see `with_payload`.
    """
    # Links, labels and sizes all read these: parse the lines once, write little.
    entries = checkpoint(entries.select("idx", "component", "correlation_values", _texts().alias("_values")))
    labels = connected_components(links_between(F.col("_values"), entries)).select(
        F.col("node").alias("_key"), F.col("label").alias("_label")
    )
    grouped = (
        entries.withColumn("_key", F.array_min("_values"))
        .filter(F.col("_key").isNotNull())
        .join(labels, "_key", "left")
        .withColumn("_label", F.coalesce("_label", "_key"))
    )
    sizes = (
        grouped.groupBy("_label")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("idx").alias("first_index"))
        .filter("_n > 1")
    )
    return (
        grouped.join(sizes, "_label")
        .withColumn("chain_id", F.concat(F.lit("chain-"), F.col("first_index")))
        .drop("_key", "_label", "_n", "_values")
    )


def with_payload(chained: DataFrame, entries: DataFrame) -> DataFrame:
    """Chained entries with their records again."""
    return chained.join(entries.select("idx", "record", "embedded", "said"), "idx")


def chain_facts(chained: DataFrame) -> DataFrame:
    """Per chain: entries, components in order of appearance, their number, the flow."""
    per_component = chained.groupBy("chain_id", "first_index", "component").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("seen")
    )
    return (
        per_component.groupBy("chain_id", "first_index")
        .agg(
            F.sum("n").alias("entries"),
            F.count(F.lit(1)).alias("component_count"),
            F.transform(
                F.sort_array(F.collect_list(F.struct("seen", "component"))), lambda s: s["component"]
            ).alias("components"),
        )
        .withColumn("flow", F.array_join("components", " → "))
    )


def with_min_components(facts: DataFrame, at_least: int = 2) -> DataFrame:
    return facts.filter(F.col("component_count") >= at_least)


def bridge_values(chained: DataFrame) -> DataFrame:
    """(chain_id, value, components): values that two or more components share."""
    pairs = chained.select("chain_id", "component", F.explode(_texts()).alias("value")).distinct()
    return (
        pairs.groupBy("chain_id", "value")
        .agg(F.sort_array(F.collect_list("component")).alias("components"))
        .filter(F.size("components") > 1)
    )


def primary_bridges(bridges: DataFrame) -> DataFrame:
    """(chain_id, bridge): the value seen in most components, ties by its text."""
    ranked = bridges.groupBy("chain_id").agg(
        F.min(F.struct((-F.size("components")).alias("k"), F.col("value").alias("bridge"))).alias("b")
    )
    return ranked.select("chain_id", "b.bridge")


def chain_summary(chained: DataFrame, bridges_shown: int | None = None) -> DataFrame:
    """Facts plus the bridge values in text order, all or the first few.

    The rank filter is applied per input task before the shuffle, so a chain with
    very many bridges sends only its first few rows.
    """
    order = Window.partitionBy("chain_id").orderBy("value")
    top = (
        bridge_values(chained)
        .select("chain_id", "value", F.row_number().over(order).alias("n"))
        .filter(F.lit(True) if bridges_shown is None else F.col("n") <= bridges_shown)
        .groupBy("chain_id")
        .agg(F.sort_array(F.collect_list("value")).alias("bridges"))
    )
    return chain_facts(chained).join(top, "chain_id", "left")


def value_frequency(entries: DataFrame, top: int | None = None) -> DataFrame:
    """Values found in two or more entries, most frequent first."""
    counts = (
        entries.select(F.explode(_texts()).alias("value"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("entries"))
        .filter("entries > 1")
        .orderBy(F.col("entries").desc(), "value")
    )
    return counts if top is None else counts.limit(top)


def component_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("component").agg(F.count(F.lit(1)).alias("entries"))


def chain_spans(chained: DataFrame) -> DataFrame:
    """Chains as spans: each entry's parent is the entry before it. Needs the payload."""
    bridges = primary_bridges(bridge_values(chained))
    ranked = rank_within(chained, ["chain_id"], [F.col("idx")])
    chat = F.filter("correlation_values", lambda v: v["value_type"] == "slack_ts")
    thread = F.coalesce(F.get(F.transform(chat, lambda v: v["value"]), F.lit(0)), F.col("bridge"))
    at = entry_time("record")
    number = F.col("pos") - 1
    return ranked.join(bridges, "chain_id", "left").select(
        F.col("idx").alias("seq"),
        "chain_id",
        F.concat_ws("-", "chain_id", number.cast("string")).alias("span_id"),
        F.when(number > 0, F.concat_ws("-", "chain_id", (number - 1).cast("string"))).alias("parent_span_id"),
        "component",
        infer_operation("record", "said").alias("operation"),
        at.alias("ts_start"),
        at.alias("ts_end"),
        detect_attempt("record", "said").alias("attempt"),
        F.col("chain_id").alias("trace_id"),
        thread.alias("thread_id"),
        thread.alias("session_id"),
        input_data("record", "embedded").alias("request"),
        response_data("record", "embedded", "said").alias("response"),
        detect_error("record", "embedded", "said").alias("error"),
    )
