"""From messy log lines to spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text_udfs import embedded_dict, unpacked_json
from spanloom.functions.values import bound, contains_any, first_truthy, truthy, with_times
from spanloom.functions.entries import message_text
from spanloom.schema import SPAN_COLUMNS

# Names under which each span column may be written, best first.
ALIASES = {
    "span_id": ["span_id", "spanId", "id", "eventId", "event_id"],
    "component": ["component", "span_type", "spanType", "type", "source", "service"],
    "operation": ["operation", "op", "action", "method", "function", "handler"],
    "ts_start": ["ts_start", "tsStart", "timestamp", "time", "startTime", "start_time", "@timestamp"],
    "ts_end": ["ts_end", "tsEnd", "endTime", "end_time"],
    "trace_id": ["trace_id", "traceId", "correlationId", "correlation_id"],
    "request_id": ["lambda_request_id", "lambdaRequestId", "request_id", "requestId", "reqId", "awsRequestId"],
    "xray_id": ["xray_trace_id", "xrayTraceId", "x_ray_trace_id"],
    "message_id": ["sqs_message_id", "sqsMessageId", "messageId", "message_id"],
    "agent_session_id": ["bedrock_session_id", "bedrockSessionId"],
    "thread_id": ["thread_id", "threadId", "thread_ts", "threadTs", "ts"],
    "session_id": ["session_id", "sessionId", "x-amz-bedrock-agent-session-id", "bedrockSessionId"],
    "request": ["request", "req", "input", "payload", "body"],
    "response": ["response", "res", "output", "result"],
    "error": ["error", "err", "exception", "failure"],
    "attempt": ["attempt", "retry_attempt", "retryAttempt", "retry", "retryCount"],
    "parent_span_id": ["parent_span_id", "parentSpanId", "parent_id", "parentId"],
}

# Keys whose object may wrap the actual record.
WRAPPERS = ["data", "log", "record", "event", "span", "context", "detail", "body", "payload", "attributes", "message"]

# How lines of the function runtime start.
RUNTIME_LINE = r"^(START |END |REPORT |INIT_START|EXTENSION)"
RUNTIME_LINE_IN_FILE = r"^(START |END |REPORT |INIT_)"

# Words that give away a component, tried in this order. Log records
# and plain text use slightly different lists.
RECORD_WORDS = [
    ("lambda", ["lambda", "handler"]),
    ("bedrock", ["bedrock", "model", "agent"]),
    ("sqs", ["sqs", "queue"]),
    ("slack", ["slack", "thread_id"]),
    ("lambda", ["event_body"]),
]
TEXT_WORDS = [
    ("lambda", ["lambda", "handler"]),
    ("bedrock", ["bedrock", "agent"]),
    ("sqs", ["sqs", "queue"]),
    ("slack", ["slack", "thread_id", "slackmessage"]),
    ("lambda", ["event_body", "event body"]),
]

# Namespace of name-based UUIDs for host names (RFC 4122).
_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def aliases(house_prefix: str | None = None) -> dict[str, list[str]]:
    """The alias table; a house prefix puts `<prefix>_trace_id` and `<prefix>TraceId`
    in front of the trace names."""
    table = dict(ALIASES)
    if house_prefix:
        table["trace_id"] = [f"{house_prefix}_trace_id", f"{house_prefix}TraceId", *table["trace_id"]]
    return table


def component_from_words(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(contains_any(low, words), name) for name, words in rules])


def json_map(text: Column) -> Column:
    """MAP of field to text of a JSON object, else null; nested values stay JSON."""
    return F.when(text.rlike(r"^\s*\{"), F.from_json(text, "map<string,string>"))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def layers(record: Column) -> Column:
    """The record and the objects below its wrapper keys, in search order."""
    return F.array_compact(F.array(record, *[json_map(record[w]) for w in WRAPPERS]))


def extract_field(layered: Column, names: list[str]) -> Column:
    """STRUCT(found, value) of the first alias in the first layer that has one. A
    field that is present with a null value counts as found."""
    hits = F.transform(
        layered,
        lambda m: F.struct(
            F.get(
                F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.map_contains_key(m, n)), F.lit(0)
            ).alias("name"),
            m.alias("m"),
        ),
    )
    hit = F.get(F.filter(hits, lambda h: h["name"].isNotNull()), F.lit(0))
    return bound(hit, lambda h: F.struct(h.isNotNull().alias("found"), F.element_at(h["m"], h["name"]).alias("value")))


def flatten_wrappers(record: Column) -> Column:
    """Fields below wrapper keys moved to the top, without replacing any; needs the
    LAST_WIN map policy that `prepare` sets."""
    empty = F.create_map().cast("map<string,string>")
    inner = [F.coalesce(json_map(record[w]), empty) for w in reversed(WRAPPERS)]
    return F.map_concat(*inner, record)


def deterministic_span_id(trace: Column, operation: Column, ts: Column) -> Column:
    """`auto-` and 12 hex digits of the name-based UUID of trace, operation, time."""
    name = F.concat_ws(":", trace, operation, ts)
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    return F.concat(F.lit("auto-"), F.substring(digest, 1, 12))


def _as_printed(field: Column) -> Column:
    # An absent field prints as nothing, a field that is null as None.
    return F.when(~field["found"], "").otherwise(F.coalesce(field["value"], F.lit("None")))


def normalise_records(records: DataFrame, house_prefix: str | None = None) -> DataFrame:
    """Spans out of (seq, json): one JSON object text per row, other columns ignored.

    Records with neither a component nor an operation give no span.
    """
    table = aliases(house_prefix)
    opened = records.select("seq", unpacked_json(F.col("json")).alias("json"))
    mapped = opened.select("seq", json_map(F.col("json")).alias("rec"))
    layered = mapped.select("seq", "rec", layers(F.col("rec")).alias("layers"))
    # Rows out of a generator: a filter of the caller, on an id that is put together from
    # several fields, stays above it. Moved below, it would look all fields up again.
    fields = layered.select(
        "seq",
        "rec",
        F.inline(
            F.array(
                F.struct(
                    message_text("rec").alias("message"),
                    *[extract_field(F.col("layers"), names).alias(f"f_{c}") for c, names in table.items()],
                )
            )
        ),
    )
    app = F.lower(F.coalesce(F.col("rec")["appname"], F.lit("")))
    logger = F.lower(F.coalesce(F.col("rec")["logger_name"], F.lit("")))
    component = F.coalesce(
        first_truthy(F.col("f_component.value")),
        F.when(F.contains(app, F.lit("orchestrator")), "lambda"),
        F.when(F.contains(logger, F.lit("slack")), "slack"),
        F.when(F.contains(logger, F.lit("bedrock")), "bedrock"),
        component_from_words(F.col("message"), RECORD_WORDS),
    )
    operation = first_truthy(F.col("f_operation.value"))
    # The dict inside a message is only read for records without a thread id. The
    # filter stays above this step, see text_udfs.
    needs_thread = F.when(~truthy("f_thread_id.value"), F.col("message"))
    spans = (
        fields.withColumns({"component": component, "operation": operation})
        .withColumn("_dict_json", embedded_dict(needs_thread))
        .filter(F.col("component").isNotNull() | F.col("operation").isNotNull())
        .withColumn("_dict", json_map(F.col("_dict_json")))
    )
    message_fallback = F.when(
        F.map_contains_key("rec", "message") & (F.col("message") != ""), F.col("message")
    ).otherwise("unknown")
    value = {c: F.col(f"f_{c}.value") for c in table}
    built = {
        **value,
        "span_id": F.coalesce(
            first_truthy(value["span_id"]),
            deterministic_span_id(
                _as_printed(F.col("f_trace_id")),
                F.when(F.col("f_operation.found"), F.coalesce(value["operation"], F.lit("None"))).otherwise("None"),
                _as_printed(F.col("f_ts_start")),
            ),
        ),
        "component": F.coalesce("component", F.lit("unknown")),
        "operation": F.coalesce(F.col("operation"), message_fallback),
        "attempt": value["attempt"].try_cast("int"),
        "thread_id": F.coalesce(
            first_truthy(value["thread_id"]),
            first_truthy(F.col("_dict")["thread_id"], F.col("_dict")["ts"]),
            value["thread_id"],
        ),
        "seq": F.col("seq"),
        "is_async": F.lit(False),
        "is_one_way": F.lit(False),
    }
    return with_times(spans.select(*[built[c].alias(c) for c in SPAN_COLUMNS]))


def read_events(events: DataFrame) -> DataFrame:
    """Log events (seq, timestamp, message) plus `kind` and `json`.

    kind is `runtime` for lines of the function runtime (no json), else `json`,
    `dict` (a Python dict inside text) or `text`: the last two are wrapped into a
    record with message, timestamp and the component that the words suggest.
    """
    message = F.coalesce("message", F.lit(""))
    runtime = message.rlike(RUNTIME_LINE)
    is_object = message.rlike(r"^\s*\{") & is_json(message)
    base = events.withColumn("_object", F.coalesce(is_object, F.lit(False))).withColumn("_runtime", runtime)
    plain = ~F.col("_object") & ~F.col("_runtime")
    base = base.withColumn("_dict", embedded_dict(F.when(plain, message)))
    words = component_from_words(message, TEXT_WORDS)
    stamp = F.create_map(F.lit("message"), message, F.lit("timestamp"), F.col("timestamp"))
    inner = json_map(F.col("_dict"))
    from_dict = F.map_concat(
        F.when(words.isNotNull() & ~F.map_contains_key(inner, "component"), F.create_map(F.lit("component"), words))
        .otherwise(F.create_map().cast("map<string,string>")),
        inner,
        stamp,
    )
    from_text = F.map_concat(stamp, F.create_map(F.lit("component"), words))
    has_dict = F.coalesce(F.size(inner) > 0, F.lit(False))
    kind = (
        F.when(F.col("_runtime"), "runtime")
        .when(F.col("_object"), "json")
        .when(has_dict, "dict")
        .otherwise("text")
    )
    keep_nulls = {"ignoreNullFields": "false"}
    return base.withColumn("kind", kind).withColumn(
        "json",
        F.when(kind == "json", message)
        .when(kind == "dict", F.to_json(from_dict, keep_nulls))
        .when(kind == "text", F.to_json(from_text, keep_nulls)),
    ).drop("_object", "_runtime", "_dict")


def parse_events(events: DataFrame, house_prefix: str | None = None) -> DataFrame:
    """Spans out of log events; runtime lines and records without a span drop out."""
    return normalise_records(read_events(events).filter(F.col("kind") != "runtime"), house_prefix)


def runtime_lines(events: DataFrame) -> DataFrame:
    return events.filter(F.col("message").rlike(RUNTIME_LINE))


def parse_counters(events: DataFrame, house_prefix: str | None = None) -> DataFrame:
    """One row: lines in total, runtime lines, lines that are not JSON, lines without
    a span, spans."""
    read = read_events(events)
    kinds = read.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("kind") == "runtime").alias("runtime"),
        F.count_if(F.col("kind").isin("dict", "text")).alias("not_json"),
    ).withColumn("_one", F.lit(1))
    spans = parse_events(events, house_prefix).agg(F.count(F.lit(1)).alias("spans")).withColumn("_one", F.lit(1))
    # Two one-row tables.
    return kinds.join(spans, "_one").select(
        "total",
        "runtime",
        "not_json",
        (F.col("total") - F.col("runtime") - F.col("spans")).alias("no_span"),
        "spans",
    )


def deep_unpacked(records: DataFrame) -> DataFrame:
    """(seq, json) with JSON inside strings opened."""
    return records.select("seq", unpacked_json(F.col("json")).alias("json"))
