"""Queries through files: what is written to the shared folder and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import profile as pf
from spanloom.operators.chains import chain_entries, with_payload
from spanloom.plans.graph import _chains, on_entries
from spanloom.plans.oracle import EV, LINES, on_spans, sql
from spanloom.session import scratch_path, stored
from spanloom.sources import bundles, sinks, tables
from spanloom.sources.arrays import array_elements
from spanloom.sources.driver_tables import raw_logs, spans, table
from spanloom.sources.logs import read_lines, read_spans, scan_log_lines

EVENTS_PER_FILE = 4000


def _log_files(spark: SparkSession, d: str) -> str:
    """The log lines as text files, in the order of their numbers."""
    path = scratch_path(spark, "log-files")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = raw_logs(spark, d).repartitionByRange(parts, "seq").sortWithinPartitions("seq")
    rows.select("message").write.text(path)
    return path


def line_positions(spark, d):
    return read_lines(spark, _log_files(spark, d)).select("seq", "line")


def array_records(spark, d):
    """Events as files that hold one array each, read back element by element."""
    path = scratch_path(spark, "array-files")
    ev = table(spark, d, "events").select("event_id", "event_type", "props", F.concat(F.lit('a,"b\\ [{'), "user_id").alias("note"))
    file = F.lpad(F.expr(f"event_id DIV {EVENTS_PER_FILE}").cast("string"), 12, "0")
    of_file = Window.partitionBy("file")
    text = F.concat(
        F.when(F.col("event_id") == F.min("event_id").over(of_file), "[ ").otherwise(" "),
        F.to_json(F.struct("event_id", "event_type", "props", "note")),
        F.when(F.col("event_id") == F.max("event_id").over(of_file), "\n]").otherwise(","),
    )
    rows = ev.withColumn("file", file).withColumn("text", text).repartition("file").sortWithinPartitions("file", "event_id")
    rows.select("file", "text").write.partitionBy("file").text(path)
    got = array_elements(spark, path)
    value = lambda k: F.get_json_object("json", f"$.{k}")
    return got.select("seq", value("event_id").cast("long").alias("event_id"), value("event_type").alias("event_type"), value("props").alias("props"), value("note").alias("note"))


def span_files(spark, d):
    """Spans written redacted and read back by the strict scan."""
    path = scratch_path(spark, "span-files")
    sinks.write_spans(spans(spark, d), path)
    back = read_spans(spark, path, strict=True)
    return back.select(
        "span_id", "parent_span_id", "component", "operation", "ts_start", "ts_end", "attempt", "trace_id", "request_id", "agent_session_id", "thread_id",
        F.get_json_object("request", "$.k").cast("int").alias("k"), F.get_json_object("error", "$.message").alias("error_text"),
    )


def _span_table(spark: SparkSession, d: str) -> str:
    path = scratch_path(spark, "span-table")
    tables.write_span_table(spans(spark, d), path)
    return path


def found_spans(spark, d):
    found = tables.find_spans(spark, _span_table(spark, d), trace_ids=["x-3", "x-70", "x-1999"], request_ids=["r-12"], session_ids=["a-1-0", "a-2-1"])
    return found.select("span_id", "trace_id", "request_id", "agent_session_id")


def window_spans(spark, d):
    found = tables.read_span_table(spark, _span_table(spark, d), datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 18))
    return found.select("span_id", F.col("logged_at").cast("timestamp_ntz").alias("logged_at"))


def chain_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines of chains, out of a bundle of spans, lines and facts."""
    path = scratch_path(spark, "chain-bundle")
    lines = raw_logs(spark, d).select("seq", F.col("message").alias("line"))
    entries = stored(pf.log_entries(scan_log_lines(lines).select("seq", "json")), "entries")
    bundles.write_chains(with_payload(chain_entries(entries), entries), lines, path)
    raw, spans_, chains = (bundles.read_bundle(spark, path, n) for n in ("lines", "spans", "chains"))
    per = raw.groupBy("chain_id").agg(F.count(F.lit(1)).alias("lines"), F.min("seq").alias("first_line"))
    per = per.join(spans_.groupBy("chain_id").agg(F.count(F.lit(1)).alias("spans")), "chain_id")
    return per.join(chains.select("chain_id", "entries"), "chain_id")


QUERIES = {f.__name__: f for f in (line_positions, array_records, span_files, found_spans, window_spans, chain_bundle)}

_REDACTED_ERROR = "regexp_extract(error, '\"message\": \"(.*)\"', 1)"

ORACLES = {
    "line_positions": sql(EV, LINES, select="SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, message AS line FROM lines"),
    "array_records": """SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, event_id, event_type, props, 'a,"b\\ [{' || user_id AS note FROM events""",
    "span_files": on_spans(
        f"""SELECT span_id, parent_span_id, component, operation, ts_start, ts_end, attempt, trace_id, request_id, agent_session_id, thread_id,
          CASE WHEN request IS NOT NULL THEN k END AS k, nullif({_REDACTED_ERROR}, '') AS error_text FROM spans"""),
    "found_spans": on_spans(
        """SELECT span_id, trace_id, request_id, agent_session_id FROM spans
          WHERE trace_id IN ('x-3', 'x-70', 'x-1999') OR request_id = 'r-12' OR agent_session_id IN ('a-1-0', 'a-2-1')"""),
    "chain_bundle": on_entries("SELECT chain_id, entries AS lines, first_index AS first_line, entries AS spans, entries FROM facts", _chains()),
    "window_spans": on_spans("SELECT span_id, logged_at FROM spans WHERE logged_at BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'"),
}
