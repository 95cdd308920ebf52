"""Spans, raw log lines and agent events derived from the given tables.

Everything here is a narrow projection of `events` or `conversations`: no join,
no shuffle, so a query over these views costs what its operator costs. The same
views exist as DuckDB text in `spanloom.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


EVENTS_PER_EXECUTION = 4

ERROR_TEXT = """
  CASE WHEN event_type <> 'error' THEN NULL
       WHEN k % 5 = 0 THEN '{"message": "ThrottlingException: slow down"}'
       WHEN k % 5 = 1 THEN '{"message": "Rate exceeded"}'
       WHEN k % 5 = 2 THEN '{"message": "Connection timeout"}'
       WHEN k % 5 = 3 THEN concat('{"message": "E', k, '"}')
       ELSE '{}' END"""

COMPONENT = """
  CASE event_type WHEN 'signup' THEN 'entrypoint:web' WHEN 'click' THEN 'agent:router'
       WHEN 'view' THEN 'lambda:render' WHEN 'purchase' THEN 'model:pay'
       ELSE 'service:backend' END"""

ATTEMPT = """
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN k < 70 THEN 1 WHEN k < 90 THEN 2
       WHEN k < 97 THEN 4 ELSE 7 END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input tasks for each core below which a table is dealt out before heavy work.
_TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt into as many partitions as the setting `spanloom.partitions` states;
    where that is unset, into some for each core if its files give fewer: a file is cut at
    its row groups only, so few large ones keep few cores busy. For much work on each
    row; large inputs have parts enough."""
    spark = df.sparkSession
    parts = spark.conf.get("spanloom.partitions", None)
    if parts:
        return df.repartition(int(parts))
    wanted = _TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with a zoned time, the number in `props`, and execution parts."""
    return numbered_events(table(spark, sf_dir, "events"))


def numbered_events(raw: DataFrame) -> DataFrame:
    return (
        raw.withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .withColumn("x", F.expr(f"event_id DIV {EVENTS_PER_EXECUTION}"))
        .withColumn("p", F.expr(f"CAST(event_id % {EVENTS_PER_EXECUTION} AS INT)"))
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per event; four events in a row form one execution (`exec_id`)."""
    return spans_of(events(spark, sf_dir))


def spans_of(ev: DataFrame) -> DataFrame:
    ev = ev.select(
        "*",
        F.expr("CASE WHEN event_id % 131 = 0 THEN NULL ELSE ts END").alias("start_at"),
        F.expr(
            """CASE WHEN event_id % 50 = 0 THEN NULL
                    WHEN event_id % 101 = 0 THEN ts - INTERVAL 1 SECOND
                    ELSE timestamp_micros(unix_micros(ts) + CAST(round(value * 1000) AS BIGINT)) END"""
        ).alias("end_at"),
        F.expr(ERROR_TEXT).alias("error"),
    )
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    return ev.select(
        F.col("event_id").alias("seq"),
        F.expr("concat('x-', x)").alias("exec_id"),
        F.expr("concat('ev-', event_id)").alias("span_id"),
        F.expr(
            """CASE WHEN p = 0 THEN NULL WHEN event_id % 97 = 0 THEN concat('missing-', event_id)
                    ELSE concat('ev-', event_id - 1 - (k % p)) END"""
        ).alias("parent_span_id"),
        F.expr(COMPONENT).alias("component"),
        F.col("event_type").alias("operation"),
        F.date_format("start_at", iso).alias("ts_start"),
        F.date_format("end_at", iso).alias("ts_end"),
        F.expr(ATTEMPT).cast("int").alias("attempt"),
        F.expr("CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat('x-', x) END").alias("trace_id"),
        F.expr("CASE WHEN event_id % 178 = 0 THEN NULL WHEN event_id % 2 = 0 THEN concat('r-', x) END").alias("request_id"),
        F.lit(None).cast("string").alias("xray_id"),
        F.lit(None).cast("string").alias("message_id"),
        F.expr("CASE WHEN event_type = 'click' THEN concat('a-', user_id, '-', p) END").alias("agent_session_id"),
        F.expr("concat('k', k, '-', unix_seconds(ts) DIV 900)").alias("thread_id"),
        F.expr("CASE WHEN event_id % 267 = 0 THEN concat('s-', user_id) END").alias("session_id"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END").alias("request"),
        F.expr("CASE WHEN error IS NOT NULL OR event_id % 7 = 0 THEN NULL ELSE props END").alias("response"),
        F.col("error"),
        F.lit(False).alias("is_async"),
        F.lit(False).alias("is_one_way"),
        F.col("start_at"),
        F.col("end_at"),
        F.col("ts").alias("logged_at"),
        F.col("user_id"),
    )


def repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans again, where some carry the id of the span before them."""
    return repeat_some_ids(spans(spark, sf_dir))


def repeat_some_ids(s: DataFrame) -> DataFrame:
    # Never across executions: the first span of each keeps its own id.
    return s.withColumn(
        "span_id",
        F.expr("CASE WHEN seq % 19 = 0 AND seq % 4 > 0 THEN concat('ev-', seq - 1) ELSE span_id END"),
    )


# One log line per event, in seven styles. %-patterns and the like are plain text.
LOG_LINE = """
  CASE CAST(event_id % 7 AS INT)
  WHEN 0 THEN concat('{"span_id": "ev-', event_id, '", "component": "', component, '", "operation": "', event_type,
       '", "ts_start": "', iso, '", "trace_id": "x-', x, '", "lambda_request_id": "r-', x,
       '", "attempt": ', 1 + k % 3, ', "request": {"k": ', k, '}}')
  WHEN 1 THEN concat('{"spanId": "ev-', event_id, '", "spanType": "', component, '", "action": "', event_type,
       '", "startTime": "', iso, '", "traceId": "x-', x, '", "reqId": "r-', x, '", "retryAttempt": ', 1 + k % 3, '}')
  WHEN 2 THEN concat('{"level": "INFO", "timestamp": "', iso, '", "data": {"component": "', component,
       '", "op": "', event_type, '", "correlationId": "x-', x, '", "request_id": "r-', x, '"}}')
  WHEN 3 THEN concat('{"level": "WARN", "timestamp": "', iso, '", "message": "{\\\\"component\\\\": \\\\"', component,
       '\\\\", \\\\"operation\\\\": \\\\"', event_type, '\\\\", \\\\"traceId\\\\": \\\\"x-', x, '\\\\"}"}')
  WHEN 4 THEN concat('{"appname": "shop-orchestrator", "level": "INFO", "logger_name": "main", "timestamp": "', iso,
       '", "message": "Event_body is {''ts'': ''', slack_ts, ''', ''channel'': ''', channel, ''', ''user'': ''', slack_user, '''}"}')
  WHEN 5 THEN concat('START RequestId: ', request_uuid, ' Version: $LATEST')
  ELSE CASE CAST(k % 4 AS INT)
       WHEN 0 THEN concat('handler warmed for customer ', user_id, ' session_id=sess-', user_id, '-', k)
       WHEN 1 THEN concat('queue depth ', k, ' messageId: ', request_uuid)
       WHEN 2 THEN concat('nothing to see for customer ', user_id)
       ELSE concat('slack post failed, retry ', 1 + k % 9, ' thread_id=', slack_ts) END
  END"""

SLACK_TS = "concat(unix_seconds(ts) DIV 3600 * 3600, '.', lpad(CAST(user_id % 1000 AS STRING), 6, '0'))"
CHANNEL = "concat('C', lpad(upper(hex(user_id % 97)), 9, '0'))"
SLACK_USER = "concat('U', lpad(upper(hex(user_id)), 9, '0'))"
REQUEST_UUID = (
    "concat(lpad(lower(hex(x)), 8, '0'), '-0000-4000-8000-', lpad(lower(hex(user_id)), 12, '0'))"
)


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, timestamp, message): one log line per event."""
    return log_lines_of(numbered_events(spread(table(spark, sf_dir, "events"))))


def log_lines_of(ev: DataFrame) -> DataFrame:
    return (
        ev.withColumn("component", F.expr(COMPONENT))
        .withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .withColumn("slack_ts", F.expr(SLACK_TS))
        .withColumn("channel", F.expr(CHANNEL))
        .withColumn("slack_user", F.expr(SLACK_USER))
        .withColumn("request_uuid", F.expr(REQUEST_UUID))
        .select(
            F.col("event_id").alias("seq"),
            F.col("iso").alias("timestamp"),
            F.expr(LOG_LINE).alias("message"),
        )
    )


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent trace events out of `conversations`: a user turn opens a call, an
    assistant turn closes it, a system turn is a rationale. Every third
    conversation calls an action instead of the model."""
    turn = table(spark, sf_dir, "conversations")
    action = F.col("conv_id") % 3 == 0
    return turn.select(
        (F.shiftleft("conv_id", 32) + F.col("turn")).alias("seq"),
        F.concat(F.lit("conv-"), F.col("conv_id")).alias("session_id"),
        F.concat(F.lit("t-"), F.col("conv_id")).alias("trace_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("at"),
        F.when((F.col("role") == "user") & action, "action_in")
        .when((F.col("role") == "assistant") & action, "action_out")
        .when(F.col("role") == "user", "model_in")
        .when(F.col("role") == "assistant", "model_out")
        .otherwise("rationale")
        .alias("kind"),
        F.when(action, F.concat(F.lit("act-"), F.col("conv_id") % 5)).alias("action_group"),
        F.col("text").alias("payload"),
    )
