"""Logging gaps: what a span or an execution should have written, but did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import first_truthy
from spanloom.operators.lookups import with_parent

# Component prefixes at which payloads matter.
BOUNDARY_PREFIXES = ["entrypoint:", "agent:", "lambda:", "model:"]

# Advice texts.
ADVICE_START = "Add ISO8601 timestamp at span start"
ADVICE_IDS = (
    "Add at least one correlation ID (lambda_request_id, sqs_message_id, "
    "bedrock_session_id, xray_trace_id, or trace_id)"
)
ADVICE_PARENT = "Ensure parent span is logged or update parent_span_id"
ADVICE_ENTRY = "Add a span with component='entrypoint:*' to mark the request entry"
ADVICE_EXPECTED = "Ensure logs contain a span with component starting with 'entrypoint:'"
ADVICE_EMPTY = "Ensure log sources contain boundary events"

# Ids that count as correlation ids here (thread and session ids do not).
GAP_IDS = ["trace_id", "request_id", "xray_id", "message_id", "agent_session_id"]


def _gap(severity: str, component: Column, span_id: Column, issue: Column, advice: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        component.alias("component"),
        span_id.alias("span_id"),
        issue.alias("issue"),
        advice.alias("recommendation"),
    )


def _at_boundary() -> Column:
    at = F.lit(False)
    for prefix in BOUNDARY_PREFIXES:
        at = at | F.startswith(F.col("component"), F.lit(prefix))
    return at


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def detect_gaps(
    spans: DataFrame,
    entrypoint_type: str = "lambda_invoke",
    by: str = "exec_id",
    executions: DataFrame | None = None,
) -> DataFrame:
    """(execution, severity, component, span_id, issue, recommendation)."""
    component, span_id = F.col("component"), F.col("span_id")
    # Payloads only matter as present or absent; they do not go through the join.
    slim = spans.select(
        by, "seq", "span_id", "parent_span_id", "component",
        F.col("ts_start").isNull().alias("no_start"),
        F.col("request").isNull().alias("no_request"),
        (F.col("response").isNull() & F.col("error").isNull()).alias("no_answer"),
        first_truthy(*GAP_IDS).isNull().alias("no_ids"),
    )
    per_span = F.array_compact(
        F.array(
            F.when(
                F.col("no_start"),
                _gap("warning", component, span_id, _text("Missing ts_start timestamp"),
                     _text(ADVICE_START)),
            ),
            F.when(
                _at_boundary() & F.col("no_request"),
                _gap("critical", component, span_id, _text("Missing request payload"),
                     _text("Log request payload at ", component,
                           " boundary. Use WARN level with JSON format.")),
            ),
            F.when(
                _at_boundary() & F.col("no_answer"),
                _gap("warning", component, span_id, _text("Missing response or error payload"),
                     _text("Log response/error at ", component,
                           " boundary. This enables completion detection.")),
            ),
            F.when(
                F.col("no_ids"),
                _gap("warning", component, span_id, _text("No correlation IDs present"),
                     _text(ADVICE_IDS)),
            ),
            F.when(
                (F.col("parent_span_id") != "") & F.col("parent_component").isNull(),
                _gap("info", component, span_id,
                     _text("Orphaned span: parent ", F.col("parent_span_id"), " not found"),
                     _text(ADVICE_PARENT)),
            ),
        )
    )
    found = (
        with_parent(slim, by)
        .select(by, F.explode(per_span).alias("g"))
        .select(by, "g.*")
    )
    nobody = F.lit(None).cast("string")
    no_entry = _gap("warning", F.lit("trace"), nobody, _text("No entrypoint span found"),
                    _text(ADVICE_ENTRY))
    not_expected = _gap(
        "warning", F.lit("case"), nobody,
        _text(f"Expected entrypoint type '{entrypoint_type}' not found in trace"),
        _text(ADVICE_EXPECTED))
    empty = _gap("critical", F.lit("trace"), nobody, _text("No spans found in trace"),
                 _text(ADVICE_EMPTY))
    entry = spans.groupBy(by).agg(
        F.bool_or(F.startswith(F.col("component"), F.lit("entrypoint:"))).alias("entered")
    )
    structure = F.when(~F.col("entered"), F.array(no_entry, not_expected))
    if executions is not None:
        entry = executions.select(by).distinct().join(entry, by, "left")
        structure = F.when(F.col("entered").isNull(), F.array(empty, not_expected)).otherwise(structure)
    per_execution = entry.select(by, F.explode(structure).alias("g")).select(by, "g.*")
    return found.unionByName(per_execution)


def severity_rank(c: str = "severity") -> Column:
    c = F.col(c)
    return F.when(c == "critical", 0).when(c == "warning", 1).when(c == "info", 2).otherwise(99)


def by_severity(gaps: DataFrame, by: str = "exec_id") -> DataFrame:
    return gaps.orderBy(severity_rank(), "component", by, "span_id", "issue")


def gap_rollup(gaps: DataFrame) -> DataFrame:
    """Gaps per severity and component."""
    return gaps.groupBy("severity", "component").agg(F.count(F.lit(1)).alias("gaps"))
