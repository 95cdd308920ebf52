"""Sequence diagrams as rows: ordered messages, participants, retry groups, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.values import (
    component_type,
    millis_between,
    participant_key,
    present,
    safe_id,
    truthy,
    with_times,
)
from spanloom.operators.lookups import with_callers
from spanloom.operators.ordering import nulls_last, rank_within

RETRY_KEY = ["component", "operation", "parent_span_id"]


def trace_order(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """Add `pos`: by start time, spans without one last, in source order."""
    return rank_within(
        with_times(spans),
        [by],
        [*nulls_last("start_at"), F.col("seq")],
    )


def span_latency(spans: DataFrame) -> DataFrame:
    """Add `latency_ms`; null if either end is missing."""
    return with_times(spans).withColumn("latency_ms", millis_between("start_at", "end_at"))


def participants(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """Components of each execution in order of appearance."""
    first = (
        with_times(spans)
        .groupBy(by, "component")
        .agg(F.min(F.struct(F.col("start_at").isNull().alias("n"), "start_at", "seq")).alias("_first"))
    )
    # One row per (execution, component): the window runs over component names.
    order = Window.partitionBy(by).orderBy("_first")
    return first.select(
        by,
        "component",
        component_type().alias("component_type"),
        safe_id("component").alias("participant_id"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
    )


def retry_groups(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """Spans doing the same under the same parent, flagged when that is a retry."""
    return (
        spans.groupBy(by, *RETRY_KEY)
        .agg(
            F.count(F.lit(1)).alias("spans"),
            F.max("attempt").alias("max_attempt"),
            F.min("seq").alias("first_seq"),
        )
        .withColumn(
            "is_retry",
            F.coalesce((F.col("spans") > 1) | (F.col("max_attempt") > 1), F.lit(False)),
        )
    )


def _has_times(spans: DataFrame, by: str) -> DataFrame:
    return spans.groupBy(by).agg(F.bool_or(F.col("start_at").isNotNull()).alias("timed"))


def sequence_events(spans: DataFrame, by: str = "exec_id", payload_only: bool = False) -> DataFrame:
    """One row per arrow, numbered by `pos` within its execution.

    A span gives a request at its start and a response at its end. With
    `payload_only` (what diagram text shows) the response needs a response or an
    error. Executions in which no span has a start show one arrow per span, in
    source order: pointing from the span to its parent, or with `payload_only` from
    the parent to the span.
    """
    # Payloads only matter as present or absent; they do not go through the joins.
    spans = with_times(spans).select(
        by, "seq", "span_id", "parent_span_id", "component", "operation", "attempt", "start_at", "end_at",
        "trace_id", "request_id", "agent_session_id",
        present("request").alias("has_request"),
        present("response").alias("has_response"),
        present("error").alias("has_error"),
    )
    answered = F.col("end_at").isNotNull()
    if payload_only:
        answered = answered & (F.col("has_response") | F.col("has_error"))

    def arrow(kind: str, at: Column, later: int, source: str, target: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            at.alias("at"),
            F.lit(later).alias("later"),
            F.col(source).alias("source"),
            F.col(target).alias("target"),
        )

    request = arrow("request", F.col("start_at"), 0, "caller", "component")
    response = arrow("response", F.col("end_at"), 1, "component", "caller")
    plain = arrow(
        "span",
        F.lit(None).cast("timestamp"),
        0,
        *(("caller", "component") if payload_only else ("component", "caller")),
    )
    arrows = F.when(
        F.col("timed"),
        F.array_compact(
            F.array(F.when(F.col("start_at").isNotNull(), request), F.when(answered, response))
        ),
    ).otherwise(F.array(plain))
    rows = (
        with_callers(spans, by)
        .join(_has_times(spans, by), by)
        .select("*", F.explode(arrows).alias("_a"))
        .select(
            by, "seq", "span_id", "parent_span_id", "component", "caller", "operation", "attempt",
            "start_at", "end_at", "trace_id", "request_id", "agent_session_id",
            "has_request", "has_response", "has_error",
            "_a.*",
        )
    )
    return rank_within(
        rows,
        [by],
        [
            *nulls_last("at"),
            F.col("later"),
            *nulls_last("start_at"),
            F.col("seq"),
        ],
    )


def messages(spans: DataFrame, by: str = "exec_id") -> DataFrame:
    """Arrows as a viewer shows them: participants, label, attempt, latency, error."""
    answers = F.col("kind") != "request"
    label = F.when(
        F.col("kind") == "response", F.concat("operation", F.lit(" response"))
    ).otherwise(F.col("operation"))
    return sequence_events(spans, by).select(
        by,
        F.col("pos").cast("long").alias("pos"),
        "span_id",
        "kind",
        "source",
        "target",
        label.alias("label"),
        F.coalesce("attempt", F.lit(1)).alias("attempt"),
        F.when(answers, millis_between("start_at", "end_at")).alias("latency_ms"),
        (answers & F.col("has_error")).alias("has_error"),
    )


def _noted(name: str, c: str) -> Column:
    return F.when(truthy(c), F.concat(F.lit(name + ":"), F.col(c)))


def sequence_text(spans: DataFrame, by: str = "exec_id", trace_label: str = "trace") -> DataFrame:
    """Mermaid source, one row per line: order by (section, pos, line).

    Section 0 is the heading, 1 the participants, 2 the arrows. Lines stay rows, so
    a long execution is not gathered into one value; `write_sequence_text` in the
    sinks writes them out in order.
    """
    spans = with_times(spans)
    events = sequence_events(spans, by, payload_only=True)
    groups = retry_groups(spans, by).filter("is_retry").select(
        by, *[F.col(c).alias(f"_{c}") for c in RETRY_KEY], F.col("max_attempt").alias("group_attempt"),
        F.col("first_seq"),
    ).withColumnRenamed(by, "_by")
    same = (F.col(by) == F.col("_by")) & (F.col("component") == F.col("_component"))
    same = same & (F.col("operation") == F.col("_operation"))
    same = same & F.col("parent_span_id").eqNullSafe(F.col("_parent_span_id"))
    flagged = events.join(groups, same, "left").withColumn("retry", F.col("_by").isNotNull())

    source, target = participant_key("source"), participant_key("target")
    req_note = F.when(
        F.col("has_request"), F.concat(F.lit("req=payloads/"), "span_id", F.lit(".request.json"))
    )
    res_note = F.when(
        F.col("has_response"), F.concat(F.lit("res=payloads/"), "span_id", F.lit(".response.json"))
    )
    err_note = F.when(
        F.col("has_error"), F.concat(F.lit("err=payloads/"), "span_id", F.lit(".error.json"))
    )
    ids = [_noted(trace_label, "trace_id"), _noted("λ", "request_id"), _noted("br", "agent_session_id")]

    def line(*parts: str | Column) -> Column:
        return F.concat(F.lit("    "), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def note(left: Column, right: Column, text: Column) -> Column:
        return F.when(text != "", line("Note over ", left, ",", right, ": ", text))

    limit = F.coalesce("attempt", F.lit(1))
    request = F.array(
        F.when(F.col("retry"), line("loop Retries (up to ", limit, " attempts)")),
        line(source, "->>", target, ": ", F.col("operation"),
             F.when(F.col("attempt") > 1, F.concat(F.lit(" [attempt "), "attempt", F.lit("]"))).otherwise("")),
        note(source, target, F.concat_ws(", ", req_note, *ids)),
        F.lit(""),
    )
    opened = F.col("retry") & (F.col("start_at") <= F.col("end_at"))
    response = F.array(
        line(source, "-->>", target, ": ", F.col("operation"), F.lit(" response"),
             F.when(F.col("has_error"), " [ERROR]").otherwise("")),
        note(target, source, F.concat_ws(", ", res_note, err_note)),
        F.when(F.coalesce(opened, F.lit(False)), line("end")),
        F.lit(""),
    )
    plain = F.array(
        line(source, "->>", target, ": ", F.col("operation"),
             F.when(F.col("attempt").isNotNull(), F.concat(F.lit(" [attempt "), "attempt", F.lit("]"))).otherwise("")),
        note(source, target, F.concat_ws(
            ", ", req_note, res_note, F.when(F.col("has_error"), "ERROR"), *ids)),
        F.when(F.col("retry"), F.lit(None)).otherwise(F.lit("")),
    )
    body = flagged.select(
        by,
        # Without times, spans of one retry group stand together at its first span.
        F.when(F.col("kind") == "span", F.coalesce("first_seq", "seq")).otherwise(F.col("pos")).alias("pos"),
        F.when(F.col("kind") == "span", F.col("seq")).otherwise(F.lit(0)).alias("sub"),
        F.posexplode(
            F.array_compact(
                F.when(F.col("kind") == "request", request)
                .when(F.col("kind") == "response", response)
                .otherwise(plain)
            )
        ).alias("line", "text"),
    ).select(by, F.lit(2).alias("section"), F.col("pos").cast("long"), F.col("sub").cast("long"), "line", "text")
    untimed = _has_times(spans, by).filter(~F.col("timed")).select(F.col(by).alias("_u"))
    loops = (
        groups.join(untimed, F.col("_by") == F.col("_u"), "left_semi")
        .select(
            F.col("_by").alias(by),
            F.col("first_seq").alias("pos"),
            F.explode(
                F.array(
                    F.struct(
                        F.lit(-1).cast("long").alias("sub"),
                        line("loop Retries (up to ", F.coalesce("group_attempt", F.lit(1)), " attempts)").alias("text"),
                    ),
                    F.struct(F.lit((1 << 62)).alias("sub"), line("end").alias("text")),
                    F.struct(F.lit((1 << 62) + 1).alias("sub"), F.lit("").alias("text")),
                )
            ).alias("l"),
        )
        .select(by, F.lit(2).alias("section"), "pos", "l.sub", F.lit(0).alias("line"), "l.text")
    )
    people = participants(spans, by).select(
        by,
        F.lit(1).alias("section"),
        F.col("idx").alias("pos"),
        F.lit(0).cast("long").alias("sub"),
        F.lit(0).alias("line"),
        line("participant ", participant_key(), " as ", F.col("component")).alias("text"),
    )
    head = spans.select(by).distinct().select(
        by,
        F.explode(F.array(
            F.struct(F.lit(0).alias("section"), F.lit("sequenceDiagram").alias("text")),
            F.struct(F.lit(1).alias("section"), F.lit("").alias("text")),
        )).alias("h"),
    ).select(
        by,
        "h.section",
        F.when(F.col("h.section") == 0, 0).otherwise(1 << 40).cast("long").alias("pos"),
        F.lit(0).cast("long").alias("sub"),
        F.lit(0).alias("line"),
        "h.text",
    )
    return head.unionByName(people).unionByName(body).unionByName(loops)
