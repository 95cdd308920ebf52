"""Fact sheets: every identifier and property a log record reveals."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.entries import detect_component, written_message
from spanloom.functions.text_udfs import embedded_dict, flat_record, flat_values, nested_data, searchable_text
from spanloom.functions.values import bound, contains_any, first_truthy, parse_time
from spanloom.operators.normalise import json_map

# What each identifier looks like in text; the first group is its value.
_QUOTED = r"""['"]?([a-zA-Z0-9._-]+)['"]?"""
_UUID = r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
HARVEST = {
    "agent_ids": [r"""(?i)(?:agent[_\s]?(?:id)?|Agent)["':\s]*([A-Z0-9]{10})"""],
    "alias_ids": [r"""(?i)(?:alias[_\s]?id|aliasId)["':\s]*([A-Z0-9]{10})"""],
    "session_ids": [r"""(?i)(?:session[_\s]?(?:id)?|sessionId)["':=\s]*""" + _QUOTED],
    "trace_ids": [r"""(?i)(?:trace[_\s]?id|traceId)["':\s]*""" + _QUOTED],
    "request_ids": [
        r"""(?i)(?:request[_-]?id|RequestId)["':\s]*(""" + _UUID + ")",
        r"""(?i)(?:RequestId|request_id)[:\s"']*([a-f0-9-]{36})""",
    ],
    "correlation_ids": [r"""(?i)(?:correlation[_\s]?id|correlationId|x-correlation-id)["':\s]*""" + _QUOTED],
    "message_ids": [r"""(?i)(?:message[_\s]?id|messageId)["':=\s]*""" + _QUOTED],
    "slack_channels": [r"""(?i)(?:channel[_\s]?(?:id)?|channel)["':=\s]*['"]?([CGD][A-Z0-9]{8,})['"]?"""],
    "slack_thread_ts": [r"""(?i)(?:thread[_\s]?(?:ts|id)|ts)["':=\s]*['"]?(\d{10}\.\d{6})['"]?"""],
    "slack_users": [r"""(?i)(?:user[_\s]?(?:id)?|user)["':\s]*['"]?([UW][A-Z0-9]{8,})['"]?"""],
    "arns": [r"(arn:aws:[a-z0-9-]+:[a-z0-9-]*:\d{12}:[a-zA-Z0-9/:_-]+)"],
    "uuids": [r"(?i)\b(" + _UUID + r")\b"],
}
# Words without one of which, in lower case, no text can match: most texts are spared the
# patterns.
HARVEST_WORDS = {
    "agent_ids": ["agent"],
    "alias_ids": ["alias"],
    "session_ids": ["session"],
    "trace_ids": ["trace"],
    "request_ids": ["request"],
    "correlation_ids": ["correlation"],
    "message_ids": ["message"],
    "slack_channels": ["channel"],
    "slack_thread_ts": ["ts", "thread"],
    "slack_users": ["user"],
    "arns": ["arn:aws:"],
    "uuids": ["-"],
}
# Shorter values of these are noise.
LONGER_THAN = {"session_ids": 5, "message_ids": 3}

# Patterns that speak for a component, in order of preference on ties.
COMPONENT_PATTERNS = {
    "bedrock": [
        r"(?i)bedrock",
        r"(?i)agent[_\s]?(?:id|response|invoke)",
        r"(?i)InvokeAgent",
        r"orchestrationTrace",
        r"(?i)knowledgeBase",
    ],
    "slack": [r"(?i)slack", r"SlackMessage", r"thread_ts", r"""channel["':\s]*['"]?[CGD][A-Z0-9]"""],
    "lambda": [r"(?i)lambda", r"handler", r"LAMBDA_", r"(?i)aws[_\s]?request[_\s]?id"],
    "sqs": [r"(?i)sqs", r"(?i)message[_\s]?id", r"(?i)receipt[_\s]?handle"],
    "dynamodb": [r"(?i)dynamodb", r"(?i)table[_\s]?name", r"PutItem|GetItem|UpdateItem|DeleteItem"],
    "s3": [r"s3://", r"(?i)bucket[_\s]?name"],
}

# A word, in lower case, that each of these patterns needs.
_PATTERN_WORDS = {
    "bedrock": ["bedrock", "agent", "invokeagent", "orchestrationtrace", "knowledgebase"],
    "slack": ["slack", "slackmessage", "thread_ts", "channel"],
    "lambda": ["lambda", "handler", "lambda_", "request"],
    "sqs": ["sqs", "message", "receipt"],
    "dynamodb": ["dynamodb", "table", "item"],
    "s3": ["s3://", "bucket"],
}

TIME_KEYS = ["timestamp", "@timestamp", "time", "eventTime", "ts"]
LEVEL_KEYS = ["level", "severity", "log_level", "@level"]

# Identifier lists that serve as correlation keys, with the type of their values.
KEY_TYPES = {
    "agent_ids": "agent_id",
    "session_ids": "session",
    "trace_ids": "trace",
    "request_ids": "lambda_request",
    "correlation_ids": "correlation",
    "message_ids": "message",
    "slack_thread_ts": "slack_ts",
    "slack_channels": "channel",
}
NOISY_TYPES = {"slack_users": "user", "uuids": "uuid"}


def harvest(text: Column, name: str, low: Column | None = None) -> Column:
    """Distinct identifiers of one kind, in order of appearance. `low` is the text in lower
    case, where that is a column already."""
    low = F.lower(text) if low is None else low
    parts = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in HARVEST[name]]
    values = parts[0] if len(parts) == 1 else F.concat(*parts)
    if name == "uuids":
        values = F.transform(values, F.lower)
    if name in LONGER_THAN:
        least = LONGER_THAN[name]
        values = F.filter(values, lambda v: F.length(v) > least)
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(contains_any(low, HARVEST_WORDS[name]), F.array_distinct(values)).otherwise(none)


def _first_key(record: Column, keys: list[str]) -> Column:
    return F.coalesce(*[record[k] for k in keys])


def record_time(record: Column) -> Column:
    """First time field as text; epoch milliseconds become ISO text in UTC."""
    value = _first_key(record, TIME_KEYS)
    ms = F.when(value.rlike("^[0-9]{10,}$"), value.try_cast("long"))
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), value)


def wall_time(text: Column) -> Column:
    """Time as written: a zone suffix is dropped, not applied."""
    return parse_time(F.regexp_replace(text, r"(Z|[+-]\d{2}:\d{2})$", ""))


def _component(text: Column, logger: Column, words: Column) -> Column:
    """STRUCT(name, confidence): share of matching patterns plus evidence. `words` is the
    text in lower case."""
    low = F.lower(F.coalesce(logger, F.lit("")))

    def score(rank: int, name: str, hits: Column) -> Column:
        extra = F.lit(0.0)
        if name == "bedrock":
            extra = F.when(F.size("agent_ids") > 0, 0.5).otherwise(0.0)
        if name == "slack":
            chat = (F.size("slack_channels") > 0) | (F.size("slack_thread_ts") > 0)
            extra = F.when(chat, 0.5).otherwise(0.0)
        named = F.when(F.contains(low, F.lit(name)), 0.3).otherwise(0.0)
        # A component only known from evidence ranks behind those that patterns found.
        order = F.when(hits > 0, -rank).otherwise(-rank - 100)
        return F.struct((hits + extra + named).alias("score"), order.alias("order"), F.lit(name).alias("name"))

    scored = []
    for rank, (name, patterns) in enumerate(COMPONENT_PATTERNS.items()):
        found = [F.contains(words, F.lit(w)) & text.rlike(p) for w, p in zip(_PATTERN_WORDS[name], patterns, strict=True)]
        hits = sum((f.cast("double") for f in found), F.lit(0.0)) / float(len(patterns))
        scored.append(bound(hits, partial(score, rank, name)))
    return bound(
        F.array_max(F.array(*scored)),
        lambda best: F.when(
            best["score"] > 0,
            F.struct(best["name"].alias("name"), F.least(best["score"], F.lit(1.0)).alias("confidence")),
        ),
    )


def _bare_envelope(record: Column, inner: Column) -> Column:
    marked = F.lit(False)
    for key in ("appname", "level", "logger_name", "component"):
        marked = marked | F.map_contains_key(record, key)
    return F.coalesce(~marked & (F.size(inner) > 0), F.lit(False))


def unwrap_envelope(record: Column, inner: Column) -> Column:
    """Record inside `message` with the outer times, for records that are a bare
    envelope; `inner` is the MAP read from the message, or null."""
    times = F.map_filter(record, lambda k, _: k.isin("timestamp", "@timestamp"))
    return F.when(_bare_envelope(record, inner), F.map_concat(times, inner)).otherwise(record)


def read_records(records: DataFrame) -> DataFrame:
    """(idx, record, json, embedded) out of (seq, json): envelopes removed, and the
    Python dict inside the message as JSON text.

    What several columns need is a column of an earlier step, so that each text is parsed
    once.
    """
    base = records.select(F.col("seq").alias("idx"), "json", json_map(F.col("json")).alias("outer"))
    # A message that is an object itself is no envelope.
    base = base.withColumn("_message", F.nullif(written_message("json", "outer"), F.lit("")))
    message = F.col("_message")
    base = base.withColumn("_dict", embedded_dict(message)).withColumn("_own", json_map(message))
    # Merging would put the text of nested values through a string map; the JSON
    # text of an unwrapped record is rebuilt only where something was unwrapped.
    base = base.withColumn("_inner_json", F.coalesce(F.when(F.col("_own").isNotNull(), message), F.col("_dict")))
    base = base.withColumn("_inner", F.coalesce("_own", json_map(F.col("_dict"))))
    base = base.withColumn("record", unwrap_envelope(F.col("outer"), F.col("_inner")))
    differs = F.to_json("record") != F.to_json("outer")
    base = base.withColumn("_unwrapped", _bare_envelope(F.col("outer"), F.col("_inner")) & differs)
    unwrapped = F.col("_unwrapped")
    again = F.when(unwrapped, embedded_dict(F.when(unwrapped, F.col("record")["message"]))).otherwise(F.col("_dict"))
    return base.select(
        "idx",
        "record",
        F.when(unwrapped, _with_times_in(F.col("_inner_json"), F.col("_inner"), F.col("outer")))
        .otherwise(F.col("json"))
        .alias("json"),
        again.alias("embedded"),
    )


def _with_times_in(inner_json: Column, inner: Column, outer: Column) -> Column:
    """Inner JSON text with the outer times appended where it has none."""
    extra = F.map_filter(
        outer, lambda k, _: k.isin("timestamp", "@timestamp") & ~F.map_contains_key(inner, k)
    )
    tail = F.to_json(extra)
    return F.when(F.size(extra) == 0, inner_json).otherwise(
        F.concat(F.regexp_replace(inner_json, r"\}\s*$", ", "), F.substring(tail, 2, 1 << 30))
    )


def fact_sheets(records: DataFrame) -> DataFrame:
    """One wide row per record of `read_records`."""
    rec = F.col("record")
    base = records.withColumn("_flat", flat_record(F.col("json"))).select(
        *records.columns,
        searchable_text(F.col("json"), F.col("_flat")).alias("text"),
        record_time(rec).alias("timestamp"),
        F.upper(_first_key(rec, LEVEL_KEYS)).alias("level"),
        first_truthy(rec["logger_name"], rec["logger"]).alias("logger_name"),
        first_truthy(rec["appname"], rec["app"]).alias("appname"),
        rec["message"].alias("message"),
    )
    base = base.withColumn("_low", F.lower("text"))
    sheets = base.select(
        "*",
        wall_time(F.col("timestamp")).alias("timestamp_parsed"),
        *[harvest(F.col("text"), name, F.col("_low")).alias(name) for name in HARVEST],
    )
    inferred = _component(F.col("text"), F.col("logger_name"), F.col("_low"))
    return (
        sheets.withColumn("_c", inferred)
        .withColumn("component", F.col("_c.name"))
        .withColumn("confidence", F.coalesce("_c.confidence", F.lit(0.0)))
        .drop("_c", "_low")
    )


def with_nested_values(sheets: DataFrame) -> DataFrame:
    """Add `extracted_kvs` (path to value) and `nested_data` (objects in strings)."""
    json, flat = F.col("json"), F.col("_flat")
    return (
        sheets.withColumn("_flat", flat_record(json))
        .withColumns({"extracted_kvs": flat_values(json, flat), "nested_data": nested_data(json, flat)})
        .drop("_flat")
    )


def correlation_keys() -> Column:
    """Identifiers of a fact sheet usable as correlation keys."""
    return F.array_distinct(F.concat(*[F.col(name) for name in KEY_TYPES]))


def _typed(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(kind).alias("value_type")))


def correlation_values() -> Column:
    """Typed identifiers of a fact sheet."""
    parts = []
    for name, kind in {**KEY_TYPES, **NOISY_TYPES}.items():
        parts.append(_typed(F.col(name), kind))
    return F.array_distinct(F.concat(*parts))


def log_entries(records: DataFrame) -> DataFrame:
    """(idx, record, embedded, said, component, timestamp, correlation_values): what
    chains are built from. `records` has (seq, json); `said` is the message if it is text."""
    sheets = fact_sheets(read_records(records))
    rec = F.col("record")
    return sheets.select(
        "idx",
        "record",
        "embedded",
        written_message("json", "record").alias("said"),
        detect_component(rec, F.col("component"), F.col("json")).alias("component"),
        first_truthy(rec["timestamp"], rec["time"], rec["@timestamp"]).alias("timestamp"),
        correlation_values().alias("correlation_values"),
    )


def corpus_profile(sheets: DataFrame) -> DataFrame:
    """One row: entries, distinct identifiers, time range."""
    kinds = ["agent_ids", "session_ids", "slack_channels", "slack_thread_ts", "request_ids"]
    ids = corpus_identifiers(sheets, kinds).groupBy().pivot("kind", kinds).agg(F.count(F.lit(1)))
    head = sheets.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.min("timestamp_parsed").alias("earliest"),
        F.max("timestamp_parsed").alias("latest"),
    )
    # Two one-row tables.
    return head.withColumn("_one", F.lit(1)).join(ids.withColumn("_one", F.lit(1)), "_one", "left").select(
        "total_entries", "earliest", "latest",
        *[F.coalesce(k, F.lit(0)).alias(f"unique_{k}") for k in kinds],
    )


def corpus_identifiers(sheets: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(kind, value): distinct identifiers of the whole corpus, as rows."""
    kinds = kinds or list(HARVEST)
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("vs")) for k in kinds])
    return (
        sheets.select(F.explode(each).alias("e"))
        .select("e.kind", F.explode("e.vs").alias("value"))
        .distinct()
    )


def counts_by(sheets: DataFrame, column: str) -> DataFrame:
    """Entries per component or level, entries without one left out."""
    return sheets.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("entries"))


# --- values without a fact sheet: by field name and by format ---

# Field names that carry correlation values, lower-case.
VALUE_FIELDS = [
    "thread_id", "threadid", "thread_ts", "ts", "session_id", "sessionid", "request_id", "requestid",
    "reqid", "awsrequestid", "message_id", "messageid", "trace_id", "traceid", "correlationid",
    "correlation_id", "channel", "channel_id", "channelid", "user", "user_id", "userid",
]

# Formats, most telling first; the first group is the value.
VALUE_FORMATS = [
    ("uuid", r"\b([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\b"),
    ("slack_ts", r"\b(\d{10}\.\d{6})\b"),
    ("xray", r"(1-[0-9a-fA-F]{8}-[0-9a-fA-F]{24})"),
    ("channel", r"\b([CDG][0-9A-Z]{8,})\b"),
    ("user", r"\b([UW][0-9A-Z]{8,})\b"),
]
LOGGED_REQUEST = r"RequestId:\s*([0-9a-fA-F\-]{36})"


def value_type(value: Column, name: Column) -> Column:
    """Type by format, then by field name."""
    low = F.lower(name)

    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    by_format = F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), kind) for kind, p in VALUE_FORMATS])
    return F.coalesce(
        by_format,
        F.when(has("thread") | (low == "ts"), "thread"),
        F.when(has("session"), "session"),
        F.when(has("req"), "request"),
        F.when(has("message") & has("id"), "message"),
        F.when(has("trace"), "trace"),
        F.when(has("channel"), "channel"),
        F.when(has("user"), "user"),
        F.lit("unknown"),
    )


def values_without_sheet(flat: Column) -> Column:
    """Typed values of a path-to-value MAP: known fields plus all formats found."""
    fields = F.filter(F.map_entries(flat), lambda e: F.trim(e["value"]) != "")
    named = F.transform(
        fields,
        lambda e: F.struct(
            e["value"].alias("value"),
            F.element_at(F.split(e["key"], r"\."), -1).alias("name"),
        ),
    )
    known = F.transform(
        F.filter(
            named,
            lambda n: F.translate(F.lower(n["name"]), "- ", "__").isin(VALUE_FIELDS),
        ),
        lambda n: F.struct(n["value"].alias("value"), value_type(n["value"], n["name"]).alias("value_type")),
    )
    text = F.array_join(F.transform(fields, lambda e: e["value"]), "\n")
    by_format = [
        _typed(F.regexp_extract_all(text, F.lit(p), F.lit(1)), kind)
        for kind, p in [*VALUE_FORMATS, ("lambda_request", LOGGED_REQUEST)]
    ]
    return F.array_distinct(F.concat(known, *by_format))
