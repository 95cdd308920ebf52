"""What a single log record says: component, payloads, error, attempt, operation.

`record` is a MAP of field name to text (nested values as JSON text); `embedded`
is the JSON text of a Python dict found in the message, or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.values import bound, contains_any, first_truthy, truthy

# Words that hint at a component, in order of preference on ties.
COMPONENT_WORDS = {
    "sqs": ["sqs", "queue", "messageid", "receipthandle"],
    "lambda": ["lambda", "handler", "invoke", "requestid", "awsrequestid"],
    "bedrock": ["bedrock", "anthropic", "claude", "model", "agent-runtime", "x-amz-bedrock"],
    "slack": ["slack", "thread_id", "channel", "user", "slackmessage", "thread_ts"],
    "dynamodb": ["dynamodb", "ddb", "table", "item", "putitem", "getitem"],
    "s3": ["s3", "bucket", "object", "key", "getobject", "putobject"],
    "api_gateway": ["apigateway", "api-gateway", "httpmethod", "resource", "path"],
    "eventbridge": ["eventbridge", "events", "detail-type", "source"],
    "step_functions": ["stepfunctions", "states", "execution", "statemachine"],
    "sns": ["sns", "topic", "subscription", "publish"],
}
# Levels, words and fields that say what a record is about.
ERROR_LEVELS = ["ERROR", "CRITICAL", "FATAL", "SEVERE"]
ERROR_WORDS = ["exception", "traceback", "failed", "failure", "error:"]
RESPONSE_WORDS = ["response", "replied", "posted", "returned", "result"]
RETRY_WORDS = ["retry", "retrying", "attempt", "retried", "backoff"]
INPUT_FIELDS = ["text", "userMessage", "inputText", "query", "prompt"]


def _record(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message_text(record: str | Column) -> Column:
    """The message if it is plain text, else an empty text."""
    message = _record(record)["message"]
    nested = message.rlike(r"^\s*[\{\[]") & F.try_parse_json(message).isNotNull()
    return F.when(F.coalesce(nested, F.lit(False)), "").otherwise(F.coalesce(message, F.lit("")))


def written_message(json: str | Column, record: str | Column) -> Column:
    """The message of a record's JSON text if it is a string, whatever is written in it;
    a message that is an object, list or number counts as an empty text."""
    message = _record(record)["message"]
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(_record(json)), "$.message", "variant"))
    # Only these could be anything but a string.
    unsure = message.rlike(r"^\s*([\{\[]|-?[0-9.eE+]+\s*$|true\s*$|false\s*$)")
    kept = F.when(~unsure | (kind == "STRING"), message)
    return F.coalesce(kept, F.lit(""))


def words_score(text: Column) -> Column:
    """Component whose words occur most often in a lower-case text, else null."""

    def scored(low: Column) -> Column:
        return F.array_max(
            F.array(
                *[
                    F.struct(
                        sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("score"),
                        F.lit(-rank).alias("rank"),
                        F.lit(name).alias("name"),
                    )
                    for rank, (name, words) in enumerate(COMPONENT_WORDS.items())
                ]
            )
        )

    return bound(bound(text, scored), lambda best: F.when(best["score"] > 0, best["name"]))


def detect_component(record: str | Column, inferred: Column, text: Column) -> Column:
    """Explicit field, logger, app, the inference of the fact sheet, then words."""
    rec = _record(record)
    logger = F.lower(F.coalesce(rec["logger_name"], F.lit("")))
    app = F.lower(F.coalesce(rec["appname"], F.lit("")))
    return F.coalesce(
        F.lower(first_truthy(rec["component"], rec["service"], rec["source"])),
        F.when(F.contains(logger, F.lit("slack")), "slack"),
        F.when(F.contains(logger, F.lit("bedrock")), "bedrock"),
        F.when(F.contains(app, F.lit("orchestrator")), "lambda"),
        inferred,
        words_score(F.lower(text)),
        F.lit("unknown"),
    )


def entry_time(record: str | Column) -> Column:
    """timestamp, time or @timestamp; epoch milliseconds become ISO text in UTC."""
    rec = _record(record)
    value = first_truthy(rec["timestamp"], rec["time"], rec["@timestamp"])
    ms = F.when(value.rlike("^[0-9]{10,}$"), value.try_cast("long"))
    iso = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.coalesce(iso, value)


def input_data(record: str | Column, embedded: str | Column) -> Column:
    rec, embedded = _record(record), _record(embedded)
    summary = F.map_concat(
        F.map_filter(rec, lambda k, _: k.isin(INPUT_FIELDS)),
        F.create_map(
            F.lit("_log_level"), F.coalesce(rec["level"], F.lit("INFO")),
            F.lit("_log_message"), F.coalesce(rec["message"], F.lit("")),
        ),
        F.map_filter(
            F.create_map(F.lit("_logger"), rec["logger_name"], F.lit("_appname"), rec["appname"]),
            lambda _, v: truthy(v),
        ),
    )
    return F.coalesce(
        first_truthy(rec["request"], rec["input"], rec["body"], rec["payload"]),
        first_truthy(embedded),
        F.to_json(summary),
    )


def response_data(record: str | Column, embedded: str | Column, text: str | Column) -> Column:
    rec, embedded, text = _record(record), _record(embedded), _record(text)
    said = F.to_json(F.struct(text.alias("_response_message")))
    return F.coalesce(
        first_truthy(rec["response"], rec["output"], rec["result"]),
        F.when(contains_any(F.lower(text), RESPONSE_WORDS), F.coalesce(first_truthy(embedded), said)),
    )


def detect_error(record: str | Column, embedded: str | Column, text: str | Column) -> Column:
    rec, embedded, text = _record(record), _record(embedded), _record(text)
    level = F.upper(F.coalesce(rec["level"], F.lit("")))
    explicit = first_truthy(rec["error"])
    is_object = F.startswith(F.trim(explicit), F.lit("{"))
    said = text.alias("message")
    return F.coalesce(
        F.when(is_object, explicit),
        F.when(explicit.isNotNull(), F.to_json(F.struct(explicit.alias("message")))),
        F.when(
            level.isin(ERROR_LEVELS),
            F.to_json(F.struct(level.alias("level"), said, first_truthy(embedded).alias("details"))),
        ),
        F.when(
            contains_any(F.lower(text), ERROR_WORDS),
            F.to_json(F.struct(F.coalesce(F.nullif(level, F.lit("")), F.lit("UNKNOWN")).alias("level"), said)),
        ),
    )


def detect_attempt(record: str | Column, text: str | Column) -> Column:
    rec = _record(record)
    text = F.lower(_record(text))
    number = F.nullif(F.regexp_extract(text, r"(?:attempt|retry)[:\s]*(\d+)", 1), F.lit(""))
    return F.coalesce(
        rec["attempt"].try_cast("int"),
        rec["retry"].try_cast("int") + 1,
        F.when(contains_any(text, RETRY_WORDS), F.coalesce(number.try_cast("int"), F.lit(2))),
        F.lit(1),
    )


def infer_operation(record: str | Column, text: str | Column) -> Column:
    rec = _record(record)
    text = F.lower(_record(text))
    named = F.coalesce(
        *[
            F.when(F.map_contains_key(rec, name), F.coalesce(rec[name], F.lit("None")))
            for name in ("operation", "op", "action", "event", "method")
        ]
    )
    parts = F.split(F.coalesce(rec["logger_name"], F.lit("")), r"\.")
    return F.coalesce(
        named,
        F.when(F.size(parts) > 1, F.element_at(parts, -1)),
        F.when(contains_any(text, ["received"]), "receive"),
        F.when(contains_any(text, ["sending", "sent"]), "send"),
        F.when(contains_any(text, ["invoking", "invoked"]), "invoke"),
        F.when(contains_any(text, ["response"]), "response"),
        F.when(contains_any(text, ["error"]), "error"),
        F.lit("log"),
    )
