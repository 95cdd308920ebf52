"""Queries over log lines and documents: normalising, ids, fact sheets, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.ids import all_ids, has_any, ids_from_record, ids_from_text
from spanloom.functions.redaction import (
    DEFAULT_PATTERNS,
    RedactionConfig,
    pattern_hits,
    redact_json,
    redact_map,
    redact_text,
)
from spanloom.operators import normalise as nm
from spanloom.operators import profile as pf
from spanloom.operators import validate as vl
from spanloom.plans.oracle import EV, LINES, sql
from spanloom.sources.driver_tables import raw_logs, spread, table
from spanloom.sources.logs import scan_log_lines, varied_counters


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return raw_logs(spark, d).select("seq", F.col("message").alias("line"))


def normalized_spans(spark, d):
    return nm.parse_events(raw_logs(spark, d)).select(
        "seq", "span_id", "component", "operation", "ts_start", "attempt", "trace_id", "request_id", "thread_id", "request"
    )


def deterministic_ids(spark, d):
    return (
        nm.parse_events(raw_logs(spark, d))
        .filter(F.startswith("span_id", F.lit("auto-")))
        .select("seq", "span_id")
    )


def parse_counters(spark, d):
    return nm.parse_counters(raw_logs(spark, d))


def file_counters(spark, d):
    return varied_counters(_lines(spark, d))


def runtime_lines(spark, d):
    return nm.runtime_lines(raw_logs(spark, d)).select("seq", "message")


def lenient_scan(spark, d):
    return scan_log_lines(_lines(spark, d)).select("seq", "timestamp", "message")


def flattened_records(spark, d):
    rec = nm.json_map(F.col("json"))
    flat = nm.flatten_wrappers(F.col("rec"))
    return (
        nm.deep_unpacked(raw_logs(spark, d).select("seq", F.col("message").alias("json")))
        .select("seq", rec.alias("rec"))
        .filter(F.col("rec").isNotNull())
        .select("seq", F.array_join(F.sort_array(F.map_keys(flat)), ",").alias("fields"), flat["component"].alias("component"))
    )


def validation_errors(spark, d):
    return vl.validate_lines(_lines(spark, d))


def validation_counts(spark, d):
    return vl.validation_counts(_lines(spark, d))


def extracted_ids(spark, d):
    ids = ids_from_text(F.col("message"))
    return raw_logs(spark, d).select("seq", ids.alias("ids")).select(
        "seq", "ids.request_id", "ids.message_id", "ids.agent_session_id", "ids.thread_id", "ids.session_id",
        has_any(F.col("ids")).alias("has_any"),
        F.array_join(F.sort_array(F.map_keys(all_ids(F.col("ids")))), ",").alias("kinds"),
    )


def record_ids(spark, d):
    return (
        scan_log_lines(_lines(spark, d))
        .select("seq", ids_from_record(nm.json_map(F.col("json"))).alias("ids"))
        .select("seq", "ids.request_id", "ids.trace_id", "ids.thread_id", "ids.session_id")
    )


def id_harvest(spark, d):
    return raw_logs(spark, d).select(
        "seq", *[F.array_join(pf.harvest(F.col("message"), name), "|").alias(name) for name in pf.HARVEST]
    )


def document_ids(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", *[F.array_join(pf.harvest(text, n), "|").alias(n) for n in pf.HARVEST]
    )


def _sheets(spark, d):
    records = scan_log_lines(_lines(spark, d)).select("seq", "json")
    return pf.fact_sheets(pf.read_records(records))


def fact_sheets(spark, d):
    return _sheets(spark, d).select(
        F.col("idx").alias("seq"), "level", "appname", "logger_name",
        F.col("timestamp_parsed").cast("timestamp_ntz").alias("timestamp_parsed"),
        "component", F.round("confidence", 6).alias("confidence"),
        F.array_join(pf.correlation_keys(), "|").alias("keys"),
        *[F.array_join(n, "|").alias(n) for n in ("session_ids", "trace_ids", "request_ids", "message_ids",
                                                  "slack_channels", "slack_thread_ts", "slack_users", "uuids")],
    )


def nested_values(spark, d):
    kv = F.col("extracted_kvs")
    return pf.with_nested_values(_sheets(spark, d)).select(
        F.col("idx").alias("seq"),
        F.array_join(F.sort_array(F.map_keys(kv)), ",").alias("paths"),
        F.coalesce(kv["message.repr.channel"], kv["message.json.component"], kv["component"]).alias("value"),
        F.size("nested_data").cast("long").alias("nested"),
    )


def field_values(spark, d):
    values = pf.values_without_sheet(F.col("extracted_kvs"))
    return (
        pf.with_nested_values(_sheets(spark, d))
        .select(F.explode(values).alias("v"))
        .groupBy("v.value_type")
        .agg(F.count(F.lit(1)).alias("found"), F.count_distinct("v.value").alias("distinct_values"))
    )


def corpus_profile(spark, d):
    c = pf.corpus_profile(_sheets(spark, d))
    for name in ("earliest", "latest"):
        c = c.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return c


def level_counts(spark, d):
    return pf.counts_by(_sheets(spark, d), "level")


def inferred_components(spark, d):
    return pf.counts_by(_sheets(spark, d), "component")


def redacted_documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", redact_text(F.col("text")).alias("text"))


def redaction_counts(spark, d):
    hits = table(spark, d, "documents").select(F.explode(pattern_hits(F.col("text"))).alias("pattern", "n"))
    return hits.groupBy("pattern").agg(F.sum("n").cast("long").alias("matches"), F.count_if(F.col("n") > 0).alias("documents"))


ALL_ON = RedactionConfig().with_pattern("ipv4", True).with_pattern("email", False)


def redacted_payloads(spark, d):
    """A nested payload around each turn; keys and texts are hidden at any depth."""
    turn = table(spark, d, "conversations")
    payload = F.to_json(
        F.struct(
            F.struct(F.lit("hunter2").alias("Password"), F.col("text").alias("note")).alias("user"),
            F.array(F.struct(F.col("role").alias("session_id"), F.concat(F.lit("10.0.0."), "turn").alias("from"))).alias("hops"),
            F.concat(F.lit("sk-"), F.lpad(F.col("conv_id").cast("string"), 20, "0")).alias("memo"),
        )
    )
    cleaned = redact_json(F.col("payload"), ALL_ON)
    return turn.select("conv_id", "turn", payload.alias("payload")).select("conv_id", "turn", cleaned.alias("p")).select(
        "conv_id", "turn",
        F.get_json_object("p", "$.user.Password").alias("secret"),
        F.get_json_object("p", "$.user.note").alias("note"),
        F.get_json_object("p", "$.hops[0].session_id").alias("session_id"),
        F.get_json_object("p", "$.hops[0].from").alias("origin"),
        F.get_json_object("p", "$.memo").alias("memo"),
    )


def redacted_maps(spark, d):
    turn = table(spark, d, "conversations")
    flat = F.create_map(F.lit("Token"), F.col("role"), F.lit("text"), F.col("text"))
    return turn.select("conv_id", "turn", redact_map(flat).alias("m")).select(
        "conv_id", "turn", F.col("m")["Token"].alias("secret"), F.col("m")["text"].alias("text")
    )


QUERIES = {
    f.__name__: f
    for f in (
        normalized_spans, deterministic_ids, parse_counters, file_counters, runtime_lines, lenient_scan,
        flattened_records, validation_errors, validation_counts, extracted_ids, record_ids, id_harvest,
        document_ids, fact_sheets, nested_values, field_values, corpus_profile, level_counts,
        inferred_components, redacted_documents, redaction_counts, redacted_payloads, redacted_maps,
    )
}

# --- DuckDB twins: expected rows follow from how a line was made ---

_WORDS = "CASE k % 4 WHEN 0 THEN 'lambda' WHEN 1 THEN 'sqs' WHEN 3 THEN 'slack' END"
_AUTO = """'auto-' || substr(sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode({})), 1, 12)"""
_EXPECTED = f"""expected AS (
  SELECT seq, CASE WHEN style < 2 THEN 'ev-' || seq WHEN style IN (2, 3) THEN {_AUTO.format("'x-' || x || ':' || event_type || ':' || iso")}
      ELSE {_AUTO.format("':None:' || iso")} END AS span_id,
    CASE style WHEN 4 THEN 'lambda' WHEN 6 THEN {_WORDS} ELSE component END AS component,
    CASE style WHEN 4 THEN regexp_extract(message, '"message": "(.*)"}}$', 1) WHEN 6 THEN message ELSE event_type END AS operation,
    iso AS ts_start, CASE WHEN style < 2 THEN 1 + k % 3 END AS attempt, CASE WHEN style < 4 THEN 'x-' || x END AS trace_id,
    CASE WHEN style < 3 THEN 'r-' || x END AS request_id, CASE WHEN style = 4 THEN slack_ts END AS thread_id,
    CASE WHEN style = 0 THEN '{{"k":' || k || '}}' END AS request
  FROM lines WHERE style <> 5 AND NOT (style = 6 AND k % 4 = 2))"""


def on_lines(select: str, *more: str) -> str:
    return sql(EV, LINES, *more, select=select)


_U = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_IDS = f"""ids AS (
  SELECT seq, style,
    coalesce(nullif(regexp_extract(message, 'RequestId:\\s*([0-9a-fA-F\\-]{{36}})', 1), ''),
      CASE WHEN contains(lower(message), 'lambda') OR contains(lower(message), 'request') THEN nullif(regexp_extract(message, '{_U}'), '') END) AS request_id,
    CASE WHEN contains(lower(message), 'messageid') OR contains(lower(message), 'sqs') THEN nullif(regexp_extract(message, '{_U}'), '') END AS message_id,
    CASE WHEN contains(lower(message), 'session') OR contains(lower(message), 'bedrock') THEN nullif(regexp_extract(message, '{_U}'), '') END AS agent_session_id,
    coalesce(nullif(regexp_extract(message, 'thread_id[''"]?\\s*[:=]\\s*[''"]?(\\d{{10}}\\.\\d{{6}})[''"]?', 1), ''),
      CASE WHEN regexp_matches(lower(message), 'thread|slack|ts') THEN nullif(regexp_extract(message, '\\b(\\d{{10}}\\.\\d{{6}})\\b', 1), '') END) AS thread_id,
    nullif(regexp_extract(message, 'session[_-]?[iI]d[''"]?\\s*[:=]\\s*[''"]?([^''"}}\\s,]+)[''"]?', 1), '') AS session_id
  FROM lines)"""


def _found(name: str, text: str) -> str:
    """The harvest of one kind in DuckDB, first-seen order."""
    parts = " || ".join(
        f"regexp_extract_all({text}, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in pf.HARVEST[name]
    )
    expr = f"({parts})"
    if name == "uuids":
        expr = f"list_transform({expr}, lambda v: lower(v))"
    if name in pf.LONGER_THAN:
        expr = f"list_filter({expr}, lambda v: length(v) > {pf.LONGER_THAN[name]})"
    return f"list_filter({expr}, lambda v, i: list_position({expr}, v) = i)"


def _joined(name: str, text: str) -> str:
    return f"coalesce(array_to_string({_found(name, text)}, '|'), '') AS {name}"


# Searchable text of each line as its record reads: key=value, embedded objects appended.
_SEARCH = """search AS (
  SELECT *, CASE style
    WHEN 0 THEN 'message=' || message || ' span_id=ev-' || seq || ' component=' || component || ' operation=' || event_type || ' ts_start=' || iso ||
      ' trace_id=x-' || x || ' lambda_request_id=r-' || x || ' attempt=' || (1 + k % 3) || ' request=k=' || k || ' timestamp='
    WHEN 1 THEN 'message=' || message || ' spanId=ev-' || seq || ' spanType=' || component || ' action=' || event_type || ' startTime=' || iso ||
      ' traceId=x-' || x || ' reqId=r-' || x || ' retryAttempt=' || (1 + k % 3) || ' timestamp='
    WHEN 2 THEN 'message=' || message || ' level=INFO timestamp=' || iso || ' data=component=' || component || ' op=' || event_type ||
      ' correlationId=x-' || x || ' request_id=r-' || x || ' timestamp=' || iso
    WHEN 3 THEN 'level=WARN timestamp=' || iso || ' message={"component": "' || component || '", "operation": "' || event_type || '", "traceId": "x-' || x ||
      '"} component=' || component || ' operation=' || event_type || ' traceId=x-' || x
    WHEN 4 THEN 'appname=shop-orchestrator level=INFO logger_name=main timestamp=' || iso || ' message=' || regexp_extract(message, '"message": "(.*)"}$', 1) ||
      ' ts=' || slack_ts || ' channel=' || channel || ' user=' || slack_user
    ELSE 'message=' || message || ' timestamp=' END AS text
  FROM lines)"""
# Lines without a message wrap themselves; a bare envelope then opens to the record itself.
_UNWRAPPED = """unwrapped AS (
  SELECT * REPLACE (CASE style
    WHEN 0 THEN 'span_id=ev-' || seq || ' component=' || component || ' operation=' || event_type || ' ts_start=' || iso ||
      ' trace_id=x-' || x || ' lambda_request_id=r-' || x || ' attempt=' || (1 + k % 3) || ' request=k=' || k || ' timestamp='
    WHEN 1 THEN 'spanId=ev-' || seq || ' spanType=' || component || ' action=' || event_type || ' startTime=' || iso ||
      ' traceId=x-' || x || ' reqId=r-' || x || ' retryAttempt=' || (1 + k % 3) || ' timestamp='
    WHEN 2 THEN 'level=INFO timestamp=' || iso || ' data=component=' || component || ' op=' || event_type ||
      ' correlationId=x-' || x || ' request_id=r-' || x
    ELSE text END AS text) FROM search)"""

def _share(name: str) -> str:
    tests = " + ".join(
        f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')::DOUBLE" for p in pf.COMPONENT_PATTERNS[name]
    )
    return f"({tests}) / {len(pf.COMPONENT_PATTERNS[name])}.0::DOUBLE"


_SHEET_IDS = list(pf.HARVEST)
_SHEETS = f"""found AS (
  SELECT *, {', '.join(f'{_found(n, "text")} AS l_{n}' for n in _SHEET_IDS)},
    {', '.join(f'{_share(n)} AS p_{n}' for n in pf.COMPONENT_PATTERNS)} FROM unwrapped),
scored AS (
  SELECT *, [
    {{'s': p_bedrock + CASE WHEN len(l_agent_ids) > 0 THEN 0.5::DOUBLE ELSE 0 END, 'r': CASE WHEN p_bedrock > 0 THEN 0 ELSE -100 END, 'n': 'bedrock'}},
    {{'s': p_slack + CASE WHEN len(l_slack_channels) + len(l_slack_thread_ts) > 0 THEN 0.5::DOUBLE ELSE 0 END, 'r': CASE WHEN p_slack > 0 THEN -1 ELSE -101 END, 'n': 'slack'}},
    {{'s': p_lambda, 'r': -2, 'n': 'lambda'}}, {{'s': p_sqs, 'r': -3, 'n': 'sqs'}},
    {{'s': p_dynamodb, 'r': -4, 'n': 'dynamodb'}}, {{'s': p_s3, 'r': -5, 'n': 's3'}}] AS options FROM found),
sheets AS (
  SELECT *, list_max(options) AS best, CASE WHEN list_max(options).s > 0 THEN list_max(options).n END AS inferred,
    CASE WHEN style IN (2, 4) THEN 'INFO' WHEN style = 3 THEN 'WARN' END AS level,
    CASE WHEN style IN (2, 3, 4) THEN strptime(iso, '%Y-%m-%dT%H:%M:%S.%fZ') END AS timestamp_parsed FROM scored)"""


def _redact(text: str, config: RedactionConfig = RedactionConfig()) -> str:
    for p in config.active():
        text = f"regexp_replace({text}, '{p.regex.replace(chr(39), chr(39) * 2)}', '{p.replacement}', 'g')"
    return text


_V = "SELECT seq, '{}' AS path, '{}' AS message FROM lines WHERE {}"
_VALIDATION = "errs AS (" + " UNION ALL ".join(
    [
        _V.format("$", "not valid JSON", "style IN (5, 6)"),
        _V.format("$", "''span_id'' is required", "style IN (1, 2, 3, 4)"),
        _V.format("$", "''component'' is required", "style IN (1, 2, 3, 4)"),
        _V.format("$", "''operation'' is required", "style IN (1, 2, 3, 4)"),
    ]
) + ")"

ORACLES = {
    "normalized_spans": on_lines("SELECT * FROM expected", _EXPECTED),
    "deterministic_ids": on_lines("SELECT seq, span_id FROM expected WHERE span_id LIKE 'auto-%'", _EXPECTED),
    "parse_counters": on_lines(
        """SELECT count(*) AS total, count(*) FILTER (style = 5) AS runtime, count(*) FILTER (style = 6) AS not_json,
          count(*) FILTER (style = 6 AND k % 4 = 2) AS no_span, (SELECT count(*) FROM expected) AS spans FROM lines""", _EXPECTED),
    "file_counters": on_lines(
        """SELECT count(*) AS total, count(*) FILTER (style >= 5) AS json_errors, count(*) FILTER (style = 6) AS unexpected,
          CAST(0 AS BIGINT) AS skipped, count(*) FILTER (style < 5) AS spans FROM lines"""),
    "runtime_lines": on_lines("SELECT seq, message FROM lines WHERE style = 5"),
    "lenient_scan": on_lines(
        """SELECT seq, CASE WHEN style IN (2, 3, 4) THEN iso ELSE '' END AS timestamp,
          CASE WHEN style IN (3, 4) THEN replace(regexp_extract(message, '"message": "(.*)"}$', 1), '\\"', '"') ELSE message END AS message FROM lines"""),
    "flattened_records": on_lines(
        """SELECT seq, CASE style WHEN 0 THEN 'attempt,component,lambda_request_id,operation,request,span_id,trace_id,ts_start'
            WHEN 1 THEN 'action,reqId,retryAttempt,spanId,spanType,startTime,traceId'
            WHEN 2 THEN 'component,correlationId,data,level,op,request_id,timestamp'
            WHEN 3 THEN 'component,level,message,operation,timestamp,traceId' ELSE 'appname,level,logger_name,message,timestamp' END AS fields,
          CASE WHEN style IN (0, 2, 3) THEN component END AS component FROM lines WHERE style < 5"""),
    "validation_errors": on_lines("SELECT * FROM errs", _VALIDATION),
    "validation_counts": on_lines(
        "SELECT count(*) FILTER (style = 0) AS valid, count(*) FILTER (style <> 0) AS invalid FROM lines"),
    "extracted_ids": on_lines(
        """SELECT seq, request_id, message_id, agent_session_id, thread_id, session_id,
          coalesce(request_id, message_id, agent_session_id, thread_id, session_id) IS NOT NULL AS has_any,
          concat_ws(',', CASE WHEN agent_session_id IS NOT NULL THEN 'agent_session_id' END, CASE WHEN message_id IS NOT NULL THEN 'message_id' END,
            CASE WHEN request_id IS NOT NULL THEN 'request_id' END, CASE WHEN session_id IS NOT NULL THEN 'session_id' END,
            CASE WHEN thread_id IS NOT NULL THEN 'thread_id' END) AS kinds FROM ids""", _IDS),
    "record_ids": on_lines(
        """SELECT seq, CASE WHEN style IN (5, 6) THEN request_id END AS request_id, NULL AS trace_id,
          CASE WHEN style IN (4, 5, 6) THEN thread_id END AS thread_id, CASE WHEN style = 6 THEN session_id END AS session_id FROM ids""", _IDS),
    "id_harvest": on_lines(f"SELECT seq, {', '.join(_joined(n, 'message') for n in pf.HARVEST)} FROM lines"),
    "document_ids": "SELECT doc_id, " + ", ".join(
        _joined(n, "text") for n in pf.HARVEST) + " FROM documents",
    "fact_sheets": on_lines(
        f"""SELECT seq, level, CASE WHEN style = 4 THEN 'shop-orchestrator' END AS appname, CASE WHEN style = 4 THEN 'main' END AS logger_name,
          timestamp_parsed, inferred AS component, round(CASE WHEN best.s > 0 THEN least(best.s, 1.0) ELSE 0.0 END, 6) AS confidence,
          array_to_string(list_filter(ks, lambda v, i: list_position(ks, v) = i), '|') AS keys,
          {', '.join(f"array_to_string(l_{n}, '|') AS {n}" for n in ("session_ids", "trace_ids", "request_ids", "message_ids", "slack_channels", "slack_thread_ts", "slack_users", "uuids"))}
        FROM (SELECT *, {' || '.join('l_' + n for n in pf.KEY_TYPES)} AS ks FROM sheets)""", _SEARCH, _UNWRAPPED, _SHEETS),
    "nested_values": on_lines(
        """SELECT seq, CASE style WHEN 0 THEN 'attempt,component,lambda_request_id,operation,request.k,span_id,timestamp,trace_id,ts_start'
            WHEN 1 THEN 'action,reqId,retryAttempt,spanId,spanType,startTime,timestamp,traceId'
            WHEN 2 THEN 'data.component,data.correlationId,data.op,data.request_id,level,timestamp'
            WHEN 3 THEN 'level,message,message.json.component,message.json.operation,message.json.traceId,timestamp'
            WHEN 4 THEN 'appname,level,logger_name,message,message.repr.channel,message.repr.ts,message.repr.user,timestamp'
            ELSE 'message,timestamp' END AS paths,
          CASE WHEN style IN (0, 3) THEN component WHEN style = 4 THEN channel END AS value,
          CAST(CASE WHEN style IN (3, 4) THEN 1 ELSE 0 END AS BIGINT) AS nested FROM lines"""),
    "corpus_profile": on_lines(
        """SELECT count(*) AS total_entries, min(timestamp_parsed) AS earliest, max(timestamp_parsed) AS latest, """ + ", ".join(
            f"(SELECT count(DISTINCT v) FROM (SELECT unnest(l_{n}) AS v FROM sheets)) AS unique_{n}"
            for n in ("agent_ids", "session_ids", "slack_channels", "slack_thread_ts", "request_ids"))
        + " FROM sheets", _SEARCH, _UNWRAPPED, _SHEETS),
    "level_counts": on_lines(
        """SELECT CASE WHEN style IN (2, 4) THEN 'INFO' ELSE 'WARN' END AS level, count(*) AS entries FROM lines
          WHERE style IN (2, 3, 4) GROUP BY 1"""),
    "inferred_components": on_lines(
        "SELECT inferred AS component, count(*) AS entries FROM sheets WHERE inferred IS NOT NULL GROUP BY 1", _SEARCH, _UNWRAPPED, _SHEETS),
    "redacted_documents": f"SELECT doc_id, {_redact('text')} AS text FROM documents",
    "redaction_counts": " UNION ALL ".join(
        f"""SELECT '{p.name}' AS pattern, CAST(sum(n) AS BIGINT) AS matches, count(*) FILTER (n > 0) AS documents
        FROM (SELECT len(regexp_extract_all(text, '{p.regex.replace(chr(39), chr(39) * 2)}')) AS n FROM documents)"""
        for p in DEFAULT_PATTERNS),
    "redacted_payloads": f"""SELECT conv_id, turn, '[REDACTED]' AS secret, {_redact('text', ALL_ON)} AS note, role AS session_id,
          '[IP_REDACTED]' AS origin, '[API_KEY_REDACTED]' AS memo FROM conversations""",
    "redacted_maps": f"SELECT conv_id, turn, '[REDACTED]' AS secret, {_redact('text')} AS text FROM conversations",
}
