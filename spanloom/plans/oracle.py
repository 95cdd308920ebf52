"""DuckDB text of the views in `spanloom.sources.driver_tables`."""

from __future__ import annotations

EV = r"""ev AS (
  SELECT *, event_id // 4 AS x, CAST(event_id % 4 AS INT) AS p,
         CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k
  FROM events)"""

_COMPONENT = """CASE event_type WHEN 'signup' THEN 'entrypoint:web' WHEN 'click' THEN 'agent:router'
       WHEN 'view' THEN 'lambda:render' WHEN 'purchase' THEN 'model:pay' ELSE 'service:backend' END"""

SPANS = f"""spans AS (
  SELECT *, CASE WHEN error IS NOT NULL OR seq % 7 = 0 THEN NULL ELSE props END AS response,
         strftime(start_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_start,
         strftime(end_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_end
  FROM (SELECT event_id AS seq, 'x-' || x AS exec_id, 'ev-' || event_id AS span_id,
    CASE WHEN p = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'missing-' || event_id
         ELSE 'ev-' || (event_id - 1 - (k % p)) END AS parent_span_id,
    {_COMPONENT} AS component, event_type AS operation,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN k < 70 THEN 1 WHEN k < 90 THEN 2 WHEN k < 97 THEN 4 ELSE 7 END AS attempt,
    CASE WHEN event_id % 131 = 0 THEN NULL ELSE ts END AS start_at,
    CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 101 = 0 THEN ts - INTERVAL 1 SECOND
         ELSE make_timestamp(epoch_us(ts) + CAST(round(value * 1000) AS BIGINT)) END AS end_at,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE 'x-' || x END AS trace_id,
    CASE WHEN event_id % 178 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'r-' || x END AS request_id,
    CASE WHEN event_type = 'click' THEN 'a-' || user_id || '-' || p END AS agent_session_id,
    'k' || k || '-' || (epoch_us(ts) // 900000000) AS thread_id,
    CASE WHEN event_id % 267 = 0 THEN 's-' || user_id END AS session_id,
    CASE WHEN event_type <> 'error' THEN NULL
         WHEN k % 5 = 0 THEN '{{"message": "ThrottlingException: slow down"}}'
         WHEN k % 5 = 1 THEN '{{"message": "Rate exceeded"}}'
         WHEN k % 5 = 2 THEN '{{"message": "Connection timeout"}}'
         WHEN k % 5 = 3 THEN '{{"message": "E' || k || '"}}' ELSE '{{}}' END AS error,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS request,
    props, ts AS logged_at, user_id, k, x, p FROM ev))"""

REPEATED = """repeated AS (
  SELECT * REPLACE (CASE WHEN seq % 19 = 0 AND seq % 4 > 0 THEN 'ev-' || (seq - 1) ELSE span_id END AS span_id)
  FROM spans)"""

# How each log line of `raw_logs` was made, and the line itself.
LINES = f"""parts AS (
  SELECT event_id AS seq, event_id % 7 AS style, event_type, x, k, user_id, {_COMPONENT} AS component,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso,
    (epoch_us(ts) // 3600000000 * 3600) || '.' || lpad(CAST(user_id % 1000 AS VARCHAR), 6, '0') AS slack_ts,
    'C' || lpad(printf('%X', user_id % 97), 9, '0') AS channel,
    'U' || lpad(printf('%X', user_id), 9, '0') AS slack_user,
    lpad(printf('%x', x), 8, '0') || '-0000-4000-8000-' || lpad(printf('%x', user_id), 12, '0') AS uuid
  FROM ev),
lines AS (
  SELECT *, CASE style
  WHEN 0 THEN '{{"span_id": "ev-' || seq || '", "component": "' || component || '", "operation": "' || event_type ||
       '", "ts_start": "' || iso || '", "trace_id": "x-' || x || '", "lambda_request_id": "r-' || x ||
       '", "attempt": ' || (1 + k % 3) || ', "request": {{"k": ' || k || '}}}}'
  WHEN 1 THEN '{{"spanId": "ev-' || seq || '", "spanType": "' || component || '", "action": "' || event_type ||
       '", "startTime": "' || iso || '", "traceId": "x-' || x || '", "reqId": "r-' || x || '", "retryAttempt": ' || (1 + k % 3) || '}}'
  WHEN 2 THEN '{{"level": "INFO", "timestamp": "' || iso || '", "data": {{"component": "' || component ||
       '", "op": "' || event_type || '", "correlationId": "x-' || x || '", "request_id": "r-' || x || '"}}}}'
  WHEN 3 THEN '{{"level": "WARN", "timestamp": "' || iso || '", "message": "{{\\"component\\": \\"' || component ||
       '\\", \\"operation\\": \\"' || event_type || '\\", \\"traceId\\": \\"x-' || x || '\\"}}"}}'
  WHEN 4 THEN '{{"appname": "shop-orchestrator", "level": "INFO", "logger_name": "main", "timestamp": "' || iso ||
       '", "message": "Event_body is {{''ts'': ''' || slack_ts || ''', ''channel'': ''' || channel || ''', ''user'': ''' || slack_user || '''}}"}}'
  WHEN 5 THEN 'START RequestId: ' || uuid || ' Version: $LATEST'
  ELSE CASE k % 4
       WHEN 0 THEN 'handler warmed for customer ' || user_id || ' session_id=sess-' || user_id || '-' || k
       WHEN 1 THEN 'queue depth ' || k || ' messageId: ' || uuid
       WHEN 2 THEN 'nothing to see for customer ' || user_id
       ELSE 'slack post failed, retry ' || (1 + k % 9) || ' thread_id=' || slack_ts END
  END AS message FROM parts)"""

AGENT = """agent AS (
  SELECT conv_id * 4294967296 + turn AS seq, 'conv-' || conv_id AS session_id, 't-' || conv_id AS trace_id,
    make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000) AS moment,
    CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN 'action_in' WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'action_out'
         WHEN role = 'user' THEN 'model_in' WHEN role = 'assistant' THEN 'model_out' ELSE 'rationale' END AS kind,
    CASE WHEN conv_id % 3 = 0 THEN 'act-' || (conv_id % 5) END AS action_group, text AS payload
  FROM conversations)"""


def truthy(c: str) -> str:
    return f"""coalesce(trim({c}) NOT IN ('', '""', '{{}}', '[]', 'null', '0', '0.0', 'false'), false)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def on_spans(select: str, *more: str) -> str:
    return sql(EV, SPANS, *more, select=select)
