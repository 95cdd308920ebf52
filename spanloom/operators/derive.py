"""Deriving test cases from executions and chains; component coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import component_type, first_truthy, ratio

# Entry point by the first component of a chain.
ENTRY_TYPES = {
    "sqs": "sqs_event",
    "lambda": "lambda_invoke",
    "bedrock": "bedrock_invoke_agent",
    "api_gateway": "http",
    "slack": "http",
}
OTHER_ENTRY = "lambda_invoke"
DEFAULT_INPUT = "Derived test input"
INPUT_FIELDS = ["inputText", "prompt_preview", "prompt", "text"]
CHAIN_PAYLOAD_FIELDS = ["request", "body", "payload", "event"]


def entry_type(component: Column) -> Column:
    return F.coalesce(*[F.when(component == c, t) for c, t in ENTRY_TYPES.items()], F.lit(OTHER_ENTRY))


def _named(name: str, params: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        (F.lit(None).cast("string") if params is None else params).alias("params"),
    )


def cases_from_executions(spans: DataFrame, entrypoint_type: str, by: str = "exec_id") -> DataFrame:
    """One case per execution, from its first span."""
    first = spans.groupBy(by).agg(
        F.count(F.lit(1)).alias("span_count"),
        F.min(F.struct("seq", "component", "operation", "request")).alias("f"),
    )
    request = F.col("f.request")
    text = F.coalesce(
        first_truthy(*[F.get_json_object(request, f"$.{n}") for n in INPUT_FIELDS]), F.lit(DEFAULT_INPUT)
    )
    payload = (
        F.to_json(F.struct(text.alias("inputText")))
        if entrypoint_type == "bedrock_invoke_agent"
        else F.coalesce(first_truthy(request), F.lit("{}"))
    )
    return first.select(
        F.concat(F.lit("derived-"), F.col(by)).alias("case_id"),
        F.concat(F.lit("Derived from "), F.concat_ws(":", "f.component", "f.operation")).alias("name"),
        F.lit(entrypoint_type).alias("entrypoint_type"),
        payload.alias("payload"),
        F.array(_named("has_spans"), _named("has_entrypoint")).alias("invariants"),
        F.col(by).alias("derived_from"),
        "span_count",
    )


def cases_from_chains(chained: DataFrame, facts: DataFrame, bridges: DataFrame) -> DataFrame:
    """One case per chain: entry point, first payload, rules by the components seen.

    `chained` from `chain_entries` with its payload, `facts` from `chain_facts`, `bridges` from
    `primary_bridges`.
    """
    rec = F.col("record")
    objects = [F.when(F.startswith(F.trim(rec[n]), F.lit("{")), rec[n]) for n in CHAIN_PAYLOAD_FIELDS]
    first = chained.groupBy("chain_id").agg(
        F.min(F.struct("idx", F.coalesce(*objects, F.lit("{}")).alias("payload"))).alias("f")
    )
    kind = component_type(F.get("components", F.lit(0)))
    rules = F.array_compact(
        F.array(
            _named("has_spans", F.to_json(F.struct(F.col("entries").alias("min_count")))),
            F.when(F.array_contains("components", "bedrock"), _named("bedrock_response_present")),
            F.when(F.array_contains("components", "slack"), _named("slack_message_sent")),
            F.when(
                F.col("component_count") >= 2,
                _named("component_flow", F.to_json(F.struct(F.col("components").alias("expected_components")))),
            ),
        )
    )
    return (
        facts.join(first, "chain_id")
        .join(bridges, "chain_id", "left")
        .select(
            F.col("chain_id").alias("case_id"),
            F.concat(F.lit("Derived: "), "flow").alias("name"),
            entry_type(kind).alias("entrypoint_type"),
            F.col("f.payload").alias("payload"),
            rules.alias("invariants"),
            F.col("bridge").alias("primary_correlation_id"),
            "component_count",
            F.col("entries").alias("log_entry_count"),
        )
    )


def component_coverage(detected: DataFrame, covered: DataFrame) -> DataFrame:
    """(component, state): covered, uncovered, or extra (covered but not detected)."""
    d = detected.select("component").distinct()
    c = covered.select("component").distinct()
    return (
        d.intersect(c).withColumn("state", F.lit("covered"))
        .unionByName(d.subtract(c).withColumn("state", F.lit("uncovered")))
        .unionByName(c.subtract(d).withColumn("state", F.lit("extra")))
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    covered = F.count_if(F.col("state") == "covered")
    uncovered = F.count_if(F.col("state") == "uncovered")
    return coverage.agg(
        covered.alias("covered"),
        uncovered.alias("uncovered"),
        F.count_if(F.col("state") == "extra").alias("extra"),
        (ratio(covered, covered + uncovered) * 100).alias("coverage_pct"),
    )


def skeleton_cases(coverage: DataFrame) -> DataFrame:
    """One case to fill in per component without any."""
    name = F.coalesce(F.nullif(F.split_part("component", F.lit(":"), F.lit(2)), F.lit("")), F.col("component"))
    return coverage.filter(F.col("state") == "uncovered").select(
        F.concat(F.lit("auto-"), name).alias("case_id"),
        F.concat_ws(" ", F.lit("Test"), component_type(), name).alias("name"),
        F.array(_named("has_spans"), _named("no_error_spans")).alias("invariants"),
        F.array("component").alias("required_components"),
    )
