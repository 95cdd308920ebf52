"""Identifiers in free text and in log records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.values import contains_any, first_truthy

# Patterns of single identifiers.
XRAY_ROOT = r"Root=([0-9a-fA-F\-]+)"
UUID_TEXT = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
REQUEST_ID = r"RequestId:\s*([0-9a-fA-F\-]{36})"
THREAD_FIELD = r"""thread_id['"]?\s*[:=]\s*['"]?(\d{10}\.\d{6})['"]?"""
CHAT_TIME = r"\b(\d{10}\.\d{6})\b"
SESSION_FIELD = r"""session[_-]?[iI]d['"]?\s*[:=]\s*['"]?([^'"}\s,]+)['"]?"""
SESSION_HEADER = r"""x-amz-bedrock-agent-session-id['"]?\s*[:=]\s*['"]?([^'"}\s,]+)['"]?"""

ID_FIELDS = [
    "request_id",
    "xray_id",
    "message_id",
    "agent_session_id",
    "trace_id",
    "thread_id",
    "session_id",
]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _uuid_near(text: Column, words: list[str]) -> Column:
    return F.when(contains_any(F.lower(text), words), found(text, UUID_TEXT, 0))


def xray_id(text: Column) -> Column:
    return found(text, XRAY_ROOT)


def request_id(text: Column) -> Column:
    return F.coalesce(found(text, REQUEST_ID), _uuid_near(text, ["lambda", "request"]))


def message_id(text: Column) -> Column:
    return _uuid_near(text, ["messageid", "sqs"])


def agent_session_id(text: Column) -> Column:
    return F.coalesce(found(text, SESSION_HEADER), _uuid_near(text, ["session", "bedrock"]))


def thread_id(text: Column) -> Column:
    bare = F.when(contains_any(F.lower(text), ["thread", "slack", "ts"]), found(text, CHAT_TIME))
    return F.coalesce(found(text, THREAD_FIELD), bare)


def session_id(text: Column) -> Column:
    return found(text, SESSION_FIELD)


def ids_from_text(text: Column) -> Column:
    """All identifiers of a text; a trace id is never guessed from text."""
    return F.struct(
        request_id(text).alias("request_id"),
        xray_id(text).alias("xray_id"),
        message_id(text).alias("message_id"),
        agent_session_id(text).alias("agent_session_id"),
        F.lit(None).cast("string").alias("trace_id"),
        thread_id(text).alias("thread_id"),
        session_id(text).alias("session_id"),
    )


def ids_from_record(record: Column, house_prefix: str | None = None) -> Column:
    """All identifiers of a log record (MAP of field to JSON text): own fields, then
    `context`, then the message text, the trace header, the first queue record."""
    context = F.from_json(record["context"], "map<string,string>")
    message = record["message"]
    text = F.when(~F.coalesce(message.rlike(r"^\s*[\{\[]"), F.lit(False)), message)
    header = first_truthy(record["_X_AMZN_TRACE_ID"], record["x_amzn_trace_id"])
    queued = F.filter(
        F.from_json(record["Records"], "array<map<string,string>>"),
        lambda r: F.map_contains_key(r, "messageId"),
    )
    trace = [record["trace_id"]]
    if house_prefix:
        trace.insert(0, record[f"{house_prefix}_trace_id"])
    return F.struct(
        first_truthy(
            record["lambda_request_id"], context["aws_request_id"], context["lambda_request_id"], request_id(text)
        ).alias("request_id"),
        first_truthy(record["xray_trace_id"], xray_id(text), xray_id(header)).alias("xray_id"),
        first_truthy(record["sqs_message_id"], F.get(queued, F.lit(0))["messageId"]).alias("message_id"),
        first_truthy(record["bedrock_session_id"], agent_session_id(text)).alias("agent_session_id"),
        first_truthy(*trace).alias("trace_id"),
        first_truthy(
            record["thread_id"], record["thread_ts"], context["thread_id"], thread_id(text)
        ).alias("thread_id"),
        first_truthy(
            record["session_id"],
            record["sessionId"],
            record["x-amz-bedrock-agent-session-id"],
            context["session_id"],
            context["sessionId"],
            session_id(text),
        ).alias("session_id"),
    )


def has_any(ids: Column) -> Column:
    return F.coalesce(*[ids[name] for name in ID_FIELDS]).isNotNull()


def all_ids(ids: Column) -> Column:
    """MAP of the identifiers that are present."""
    pairs = F.create_map(*[x for name in ID_FIELDS for x in (F.lit(name), ids[name])])
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
