"""Queries over the span view: executions, order, trees, rules, gaps, paths."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.values import truthy
from spanloom.operators import compare as cmp
from spanloom.operators import executions as ex
from spanloom.operators import gaps as gp
from spanloom.operators import invariants as inv
from spanloom.operators import lookups as lk
from spanloom.operators import sequence as sq
from spanloom.operators import timeline as tl
from spanloom.operators import tree as tr
from spanloom.plans.oracle import REPEATED, on_spans
from spanloom.plans.oracle import truthy as sql_truthy
from spanloom.sources import logs
from spanloom.sources.driver_tables import repeated_spans, spans
from spanloom.sources.sinks import payload_rows

SPLIT_DAY = datetime(2024, 1, 16)
REQUIRED = ["entrypoint:web", "model:pay"]
RULES = inv.InvariantConfig(required_components=REQUIRED, check_errors=True)


def ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return ex.execution_summary(ex.assign_executions(spans(spark, d)))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "exec_id", ntz("started_at"), "span_count", F.round("duration_ms", 6).alias("duration_ms"), "status",
        "error_count", "retry_count", F.array_join("components", ",").alias("components"),
    )


def execution_summary(spark, d):
    return _shown(ex.newest_first(_summary(spark, d)))


def executions_filtered_warnings(spark, d):
    return _shown(ex.filter_executions(_summary(spark, d), "warnings"))


def execution_status_totals(spark, d):
    return rounded(ex.view_totals(ex.assign_executions(spans(spark, d))), "pass_rate")


def orphan_execution_spans(spark, d):
    return ex.orphan_spans(ex.assign_executions(spans(spark, d))).select("span_id", "component", "operation")


def run_statistics(spark, d):
    return ex.run_statistics(spans(spark, d))


def trace_order(spark, d):
    return sq.trace_order(spans(spark, d)).select("exec_id", "span_id", F.col("pos").cast("long").alias("pos"))


def span_latency(spark, d):
    return sq.span_latency(spans(spark, d)).select("span_id", F.round("latency_ms", 6).alias("latency_ms"))


def timeline_positions(spark, d):
    return rounded(
        tl.timeline_positions(spans(spark, d)).drop("seq"), "start_ms", "end_ms", "duration_ms", "range_ms"
    )


def timeline_bars(spark, d):
    s = spans(spark, d)
    bars = tl.with_critical(tl.timeline_positions(s), tr.critical_path(tr.resolve(s)))
    return bars.select("exec_id", "span_id", "row", "is_critical")


def rule_statistics(spark, d):
    return ex.rule_statistics(inv.run_invariants(repeated_spans(spark, d), RULES))


def timeline_statistics(spark, d):
    s = spans(spark, d)
    stats = tl.timeline_statistics(tl.timeline_positions(s), tr.critical_path(tr.resolve(s)))
    return rounded(stats, "total_duration_ms")


def participants(spark, d):
    return sq.participants(spans(spark, d))


def retry_groups(spark, d):
    return sq.retry_groups(spans(spark, d))


def sequence_events(spark, d):
    return rounded(sq.messages(spans(spark, d)), "latency_ms")


def sequence_text(spark, d):
    return sq.sequence_text(spans(spark, d)).drop("sub")


def caller_edges(spark, d):
    return lk.caller_edges(spans(spark, d))


def span_tree(spark, d):
    return tr.tree_nodes(tr.resolve(spans(spark, d)))


def _first_errors(s: DataFrame) -> DataFrame:
    return (
        s.filter(truthy("error"))
        .groupBy("exec_id")
        .agg(F.min_by("span_id", "seq").alias("seed"))
    )


def span_ancestors(spark, d):
    s = spans(spark, d)
    return tr.ancestors(tr.resolve(s), _first_errors(s))


def span_descendants(spark, d):
    s = spans(spark, d)
    return tr.descendants(tr.resolve(s), _first_errors(s))


def critical_path(spark, d):
    return tr.critical_path(tr.resolve(spans(spark, d)))


def orphan_spans(spark, d):
    return lk.spans_without_parent(spans(spark, d)).select("exec_id", "span_id", "parent_span_id")


def invariants_long(spark, d):
    return inv.run_invariants(repeated_spans(spark, d), RULES)


def invariants_summary(spark, d):
    return inv.invariant_totals(inv.run_invariants(spans(spark, d), RULES))


def invariant_violations(spark, d):
    return inv.invariant_violations(repeated_spans(spark, d), RULES)


def required_components(spark, d):
    return inv.missing_components(spans(spark, d), REQUIRED)


def logging_gaps(spark, d):
    return gp.by_severity(gp.detect_gaps(spans(spark, d), "http")).drop("recommendation")


def gap_rollup(spark, d):
    return gp.gap_rollup(gp.detect_gaps(spans(spark, d), "http"))


def _signatures(spark, d):
    return cmp.path_signatures(spans(spark, d))


def path_steps(spark, d):
    return cmp.path_steps(spans(spark, d)).select(
        "exec_id", F.col("pos").cast("long").alias("pos"), "component", "operation"
    )


def path_signatures(spark, d):
    return _signatures(spark, d).select(
        "exec_id", "path_key", "steps", "has_error", "retries", "latency_us"
    )


def path_texts(spark, d):
    s = spans(spark, d)
    return cmp.path_texts(s, cmp.path_signatures(s)).select("path_key", F.col("pos").cast("long").alias("pos"), "step")


def path_stats(spark, d):
    return rounded(
        cmp.path_stats(_signatures(spark, d)),
        "total_latency_ms", "min_latency_ms", "max_latency_ms", "avg_latency_ms",
    )


def _deltas(spark, d):
    sig = _signatures(spark, d)
    early = F.coalesce(F.col("started_at") < F.lit(SPLIT_DAY), F.lit(True))
    # One pass over the signatures: the side is a flag, not a second scan.
    return cmp.compare_by(sig.withColumn("is_baseline", early), "is_baseline")


def compare_deltas(spark, d):
    return rounded(
        cmp.worst_first(_deltas(spark, d)),
        "baseline_avg_ms", "current_avg_ms", "latency_delta_ms", "latency_delta_pct",
        "baseline_error_rate", "current_error_rate", "error_rate_delta",
    )


def compare_verdict(spark, d):
    return cmp.verdict(_deltas(spark, d))


def window_scan(spark, d):
    s = spans(spark, d)
    start, end = datetime(2024, 1, 10), datetime(2024, 1, 20)
    return logs.window_scan(
        [s.filter("component = 'model:pay'"), s.filter("component = 'agent:router'")], start, end, limit=1000
    ).select("span_id", "component", ntz("logged_at"))


def id_filter_scan(spark, d):
    s = spans(spark, d)
    wanted = s.filter("operation = 'error' AND attempt = 7").select("trace_id")
    return logs.spans_by_id(s, trace_ids=wanted, session_ids=["a-1-0", "a-2-1"]).select("span_id", "trace_id", "agent_session_id")


def search_spans(spark, d):
    return logs.search_spans(spans(spark, d), "Render", fuzzy=2).select("span_id", "component", "operation")


def filtered_spans(spark, d):
    s = spans(spark, d)
    return (
        logs.filter_spans(s, "errors").withColumn("kind", F.lit("errors"))
        .unionByName(logs.filter_spans(s, "retries").withColumn("kind", F.lit("retries")))
        .groupBy("kind", "component").agg(F.count(F.lit(1)).alias("spans"))
    )


def span_payloads(spark, d):
    return payload_rows(spans(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        execution_summary, executions_filtered_warnings, execution_status_totals, orphan_execution_spans,
        run_statistics, trace_order, span_latency, timeline_positions, timeline_statistics, participants,
        retry_groups, sequence_events, sequence_text, caller_edges, span_tree, span_ancestors,
        span_descendants, critical_path, orphan_spans, invariants_long, invariants_summary,
        invariant_violations, required_components, logging_gaps, gap_rollup, path_steps, path_texts, path_signatures,
        path_stats, compare_deltas, compare_verdict, window_scan, id_filter_scan, search_spans,
        filtered_spans, span_payloads, timeline_bars, rule_statistics,
    )
}

# --- DuckDB twins ---

_EXECS = """execs AS (SELECT *, coalesce(trace_id, agent_session_id, session_id, request_id) AS e FROM spans)"""
_SUMMARY = _EXECS + """, summary AS (
  SELECT e AS exec_id, min(start_at) AS started_at, count(*) AS span_count,
    round(coalesce((epoch_us(max(end_at)) - epoch_us(min(start_at))) / 1000.0, 0.0), 6) AS duration_ms,
    CASE WHEN count(error) > 0 THEN 'error' WHEN count(*) FILTER (attempt > 1) > 0 THEN 'warning' ELSE 'passed' END AS status,
    count(error) AS error_count, count(*) FILTER (attempt > 1) AS retry_count,
    string_agg(DISTINCT component, ',' ORDER BY component) AS components
  FROM execs WHERE e IS NOT NULL GROUP BY e)"""

_CALLERS = """callers AS (
  SELECT s.*, p.component AS parent_component, coalesce(p.component, s.component) AS caller
  FROM spans s LEFT JOIN spans p ON p.exec_id = s.exec_id AND p.span_id = s.parent_span_id)"""

_TREE = """tree AS (
  SELECT s.exec_id, s.span_id, s.parent_span_id, s.span_id AS root, CAST(0 AS BIGINT) AS depth,
    s.parent_span_id IS NULL AS attached, coalesce(epoch_us(s.end_at) - epoch_us(s.start_at), 0) AS total,
    [coalesce(epoch_us(s.start_at), 4611686018427387904), s.seq] AS way
  FROM spans s LEFT JOIN spans p ON p.exec_id = s.exec_id AND p.span_id = s.parent_span_id WHERE p.span_id IS NULL
  UNION ALL
  SELECT s.exec_id, s.span_id, s.parent_span_id, t.root, t.depth + 1, t.attached,
    t.total + coalesce(epoch_us(s.end_at) - epoch_us(s.start_at), 0),
    list_concat(t.way, [coalesce(epoch_us(s.start_at), 4611686018427387904), s.seq])
  FROM tree t JOIN spans s ON s.exec_id = t.exec_id AND s.parent_span_id = t.span_id)"""

_CRITICAL = _TREE + """, best AS (
  SELECT exec_id, max(total) AS m FROM tree WHERE attached GROUP BY exec_id HAVING max(total) > 0),
ends AS (
  SELECT t.exec_id, arg_min(t.span_id, t.way) AS span_id FROM tree t JOIN best b ON b.exec_id = t.exec_id AND b.m = t.total
  WHERE t.attached GROUP BY t.exec_id),
leaf AS (
  SELECT e.* FROM ends e WHERE NOT EXISTS (SELECT 1 FROM spans c WHERE c.exec_id = e.exec_id AND c.parent_span_id = e.span_id)),
critical AS (
  SELECT exec_id, span_id FROM leaf
  UNION ALL
  SELECT c.exec_id, s.parent_span_id FROM critical c JOIN spans s ON s.exec_id = c.exec_id AND s.span_id = c.span_id
  WHERE s.parent_span_id IS NOT NULL)"""

_BOUNDS = """bounds AS (
  SELECT exec_id, min(least(coalesce(start_at, end_at), coalesce(end_at, start_at))) AS lo,
    max(greatest(coalesce(start_at, end_at), coalesce(end_at, start_at))) AS hi FROM spans GROUP BY exec_id),
placed AS (
  SELECT s.exec_id, span_id, component, error, seq, start_at, coalesce(start_at, lo) AS moment, lo, hi,
    coalesce((epoch_us(start_at) - epoch_us(lo)) / 1000.0, 0.0) AS a,
    coalesce((epoch_us(end_at) - epoch_us(lo)) / 1000.0, coalesce((epoch_us(start_at) - epoch_us(lo)) / 1000.0, 0.0) + 10) AS b
  FROM spans s JOIN bounds USING (exec_id))"""

_ARROWS = _CALLERS + """, arrows AS (
  SELECT *, 'request' AS kind, start_at AS moment, 0 AS later, caller AS source, component AS target FROM callers WHERE start_at IS NOT NULL
  UNION ALL
  SELECT *, 'response' AS kind, end_at AS moment, 1 AS later, component AS source, caller AS target FROM callers WHERE end_at IS NOT NULL)"""

_ORDER = "PARTITION BY exec_id ORDER BY moment, later, start_at NULLS LAST, seq"

_RETRY = """retries AS (
  SELECT exec_id, component, operation, parent_span_id, count(*) AS spans, max(attempt) AS max_attempt, min(seq) AS first_seq,
    coalesce(count(*) > 1 OR max(attempt) > 1, false) AS is_retry
  FROM spans GROUP BY ALL)"""

_KEY = "replace(replace(replace(replace({c}, ':', '_'), '-', '_'), '/', '_'), '.', '_')"
_SRC, _DST = _KEY.format(c="source"), _KEY.format(c="target")

_PEOPLE = """people AS (
  SELECT exec_id, component, row_number() OVER (PARTITION BY exec_id ORDER BY (first).n, (first).s, (first).q) - 1 AS idx
  FROM (SELECT exec_id, component, min({'n': start_at IS NULL, 's': coalesce(start_at, TIMESTAMP '2000-01-01'), 'q': seq}) AS first
        FROM spans GROUP BY exec_id, component))"""

_TEXT = _ARROWS + ", " + _RETRY + ", " + _PEOPLE + f""", shown AS (
  SELECT *, row_number() OVER ({_ORDER}) AS pos FROM arrows WHERE kind = 'request' OR response IS NOT NULL OR error IS NOT NULL),
flagged AS (
  SELECT s.*, coalesce(r.is_retry, false) AS retry, {_SRC} AS src, {_DST} AS dst
  FROM shown s LEFT JOIN retries r ON r.exec_id = s.exec_id AND r.component = s.component AND r.operation = s.operation
    AND r.parent_span_id IS NOT DISTINCT FROM s.parent_span_id),
body AS (
  SELECT exec_id, pos, unnest(list_filter(CASE WHEN kind = 'request' THEN [
      CASE WHEN retry THEN '    loop Retries (up to ' || coalesce(attempt, 1) || ' attempts)' END,
      '    ' || src || '->>' || dst || ': ' || operation || CASE WHEN attempt > 1 THEN ' [attempt ' || attempt || ']' ELSE '' END,
      CASE WHEN concat_ws(', ', CASE WHEN request IS NOT NULL THEN 'q' END, trace_id, request_id, agent_session_id) <> '' THEN
        '    Note over ' || src || ',' || dst || ': ' || concat_ws(', ', CASE WHEN request IS NOT NULL THEN 'req=payloads/' || span_id || '.request.json' END,
           'trace:' || trace_id, 'λ:' || request_id, 'br:' || agent_session_id) END, '']
    ELSE [
      '    ' || src || '-->>' || dst || ': ' || operation || ' response' || CASE WHEN error IS NOT NULL THEN ' [ERROR]' ELSE '' END,
      '    Note over ' || dst || ',' || src || ': ' || concat_ws(', ', CASE WHEN response IS NOT NULL THEN 'res=payloads/' || span_id || '.response.json' END,
           CASE WHEN error IS NOT NULL THEN 'err=payloads/' || span_id || '.error.json' END),
      CASE WHEN retry AND start_at <= end_at THEN '    end' END, ''] END, lambda t: t IS NOT NULL)) AS text,
    generate_subscripts(list_filter(CASE WHEN kind = 'request' THEN [
      CASE WHEN retry THEN 'l' END, 'a',
      CASE WHEN concat_ws(', ', CASE WHEN request IS NOT NULL THEN 'q' END, trace_id, request_id, agent_session_id) <> '' THEN 'n' END, 'e']
    ELSE ['a', 'n', CASE WHEN retry AND start_at <= end_at THEN 'x' END, 'e'] END, lambda t: t IS NOT NULL), 1) - 1 AS line
  FROM flagged)
"""

_RULES = f"""counts AS (
  SELECT exec_id, count(*) AS n, count(*) FILTER (parent_span_id IS NULL) AS roots, count(*) - count(DISTINCT span_id) AS dup,
    count(*) FILTER (end_at < start_at) AS early, count(*) FILTER (attempt > 6) AS often,
    count(*) FILTER ({sql_truthy('error')}) AS err,
    2 - max((component = 'entrypoint:web')::INT) - max((component = 'model:pay')::INT) AS missing
  FROM {{t}} GROUP BY exec_id),
lost AS (
  SELECT exec_id, count(*) AS n FROM {{t}} s WHERE parent_span_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM {{t}} p WHERE p.exec_id = s.exec_id AND p.span_id = s.parent_span_id) GROUP BY exec_id),
long AS (
  SELECT exec_id, unnest(['has_spans', 'no_duplicate_span_ids', 'has_entrypoint', 'no_orphan_spans', 'valid_timestamps',
      'max_retry_count', 'required_components', 'no_error_spans']) AS invariant,
    unnest([0, dup, CASE WHEN roots > 0 THEN 0 ELSE 1 END, coalesce(lost.n, 0), early, often, missing, err]) AS violations
  FROM counts LEFT JOIN lost USING (exec_id))"""

_B = "(component LIKE 'entrypoint:%' OR component LIKE 'agent:%' OR component LIKE 'lambda:%' OR component LIKE 'model:%')"
_GAPS = _CALLERS + f""", gaps AS (
  SELECT exec_id, 'warning' AS severity, component, span_id, 'Missing ts_start timestamp' AS issue FROM spans WHERE start_at IS NULL
  UNION ALL SELECT exec_id, 'critical', component, span_id, 'Missing request payload' FROM spans WHERE request IS NULL AND {_B}
  UNION ALL SELECT exec_id, 'warning', component, span_id, 'Missing response or error payload' FROM spans
    WHERE response IS NULL AND error IS NULL AND {_B}
  UNION ALL SELECT exec_id, 'warning', component, span_id, 'No correlation IDs present' FROM spans
    WHERE trace_id IS NULL AND request_id IS NULL AND agent_session_id IS NULL
  UNION ALL SELECT exec_id, 'info', component, span_id, 'Orphaned span: parent ' || parent_span_id || ' not found' FROM callers
    WHERE parent_span_id IS NOT NULL AND parent_component IS NULL
  UNION ALL SELECT exec_id, unnest(['warning', 'warning']), unnest(['trace', 'case']), NULL,
    unnest(['No entrypoint span found', 'Expected entrypoint type ''http'' not found in trace'])
  FROM (SELECT exec_id FROM spans GROUP BY exec_id HAVING count(*) FILTER (component LIKE 'entrypoint:%') = 0))"""

_STEPS = """steps AS (
  SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY start_at NULLS LAST, CASE WHEN start_at IS NULL THEN span_id END, seq) AS pos
  FROM spans)"""
_SIGS = _STEPS + f""", sums AS (
  SELECT exec_id, count(*) AS steps,
    sum(('0x' || substr(md5(pos || '|' || length(component) || ':' || component || '|' || length(operation) || ':' || operation), 1, 15))::BIGINT) AS h1,
    sum(('0x' || substr(md5(pos || '|' || length(component) || ':' || component || '|' || length(operation) || ':' || operation), 17, 15))::BIGINT) AS h2,
    bool_or({sql_truthy('error')}) AS has_error, greatest(coalesce(max(attempt), 0) - 1, 0) AS retries,
    min(start_at) AS started_at, coalesce(epoch_us(max(end_at)) - epoch_us(min(start_at)), 0) AS latency_us
  FROM steps GROUP BY exec_id),
sigs AS (
  SELECT exec_id, md5(steps || '-' || h1 || '-' || h2 || '-' || has_error) AS path_key,
    steps, has_error, retries, started_at, latency_us FROM sums)"""
_FIRST = "arg_min(exec_id, {'a': coalesce(epoch_us(started_at), 4611686018427387904), 'b': exec_id})"
_DELTAS = _SIGS + f""", sides AS (
  SELECT path_key, {_FIRST} AS example,
    count(*) FILTER (b) AS baseline_count, count(*) FILTER (NOT b) AS current_count,
    count(*) FILTER (b AND has_error) AS baseline_errors, count(*) FILTER (NOT b AND has_error) AS current_errors,
    coalesce(sum(latency_us) FILTER (b), 0) / 1000.0 AS bl, coalesce(sum(latency_us) FILTER (NOT b), 0) / 1000.0 AS cl
  FROM (SELECT *, coalesce(started_at < TIMESTAMP '2024-01-16', true) AS b FROM sigs) GROUP BY path_key),
avgs AS (
  SELECT *, coalesce(bl / nullif(baseline_count, 0), 0.0) AS baseline_avg_ms, coalesce(cl / nullif(current_count, 0), 0.0) AS current_avg_ms,
    coalesce(baseline_errors / nullif(baseline_count, 0), 0.0) AS baseline_error_rate,
    coalesce(current_errors / nullif(current_count, 0), 0.0) AS current_error_rate FROM sides),
diffs AS (
  SELECT *, CASE WHEN baseline_count = 0 OR current_count = 0 THEN 0.0 ELSE current_avg_ms - baseline_avg_ms END AS delta,
    current_error_rate - baseline_error_rate AS error_rate_delta,
    baseline_count = 0 AS is_new, current_count = 0 AS is_missing FROM avgs),
deltas AS (SELECT *, coalesce(delta / nullif(baseline_avg_ms, 0) * 100, 0.0) AS pct FROM diffs)"""

_SEEDS = f"""seeds AS (
  SELECT exec_id, arg_min(span_id, seq) AS seed FROM spans WHERE {sql_truthy('error')} GROUP BY exec_id)"""

ORACLES = {
    "execution_summary": on_spans("SELECT * FROM summary", _SUMMARY),
    "executions_filtered_warnings": on_spans(
        "SELECT * FROM summary WHERE status IN ('warning', 'error')", _SUMMARY),
    "execution_status_totals": on_spans(
        """SELECT count(*) AS executions, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'error') AS errors,
          count(*) FILTER (status = 'warning') AS warnings, (SELECT count(*) FROM execs WHERE e IS NULL) AS orphan_spans,
          round(count(*) FILTER (status = 'passed') / count(*) * 100, 6) AS pass_rate FROM summary""", _SUMMARY),
    "orphan_execution_spans": on_spans("SELECT span_id, component, operation FROM execs WHERE e IS NULL", _EXECS),
    "run_statistics": on_spans(
        """SELECT count(*) AS span_count, count(DISTINCT component) AS components, count(DISTINCT operation) AS operations,
          count(*) FILTER (""" + sql_truthy("error") + """) AS error_spans FROM spans"""),
    "trace_order": on_spans(
        """SELECT exec_id, span_id, row_number() OVER (PARTITION BY exec_id ORDER BY start_at NULLS LAST, seq) AS pos FROM spans"""),
    "span_latency": on_spans(
        "SELECT span_id, round((epoch_us(end_at) - epoch_us(start_at)) / 1000.0, 6) AS latency_ms FROM spans"),
    "timeline_positions": on_spans(
        f"""SELECT exec_id, span_id, row_number() OVER (PARTITION BY exec_id ORDER BY moment, start_at IS NULL, seq) - 1 AS row,
          round(a, 6) AS start_ms, round(b, 6) AS end_ms, round(greatest(b - a, 1.0), 6) AS duration_ms,
          round(greatest((epoch_us(hi) - epoch_us(lo)) / 1000.0, 100.0), 6) AS range_ms,
          lower(split_part(component, ':', 1)) AS component_type, {sql_truthy('error')} AS has_error FROM placed""", _BOUNDS),
    "timeline_bars": on_spans(
        """SELECT p.exec_id, p.span_id, row_number() OVER (PARTITION BY p.exec_id ORDER BY moment, start_at IS NULL, seq) - 1 AS row,
          c.span_id IS NOT NULL AS is_critical FROM placed p LEFT JOIN critical c ON p.exec_id = c.exec_id AND p.span_id = c.span_id""",
        _BOUNDS, _CRITICAL),
    "rule_statistics": on_spans(
        "SELECT count(*) FILTER (violations = 0) AS invariants_passed, count(*) AS invariants_total FROM long", REPEATED, _RULES.replace("{t}", "repeated")),
    "timeline_statistics": on_spans(
        f"""SELECT exec_id, round(sum(greatest(b - a, 1.0)), 6) AS total_duration_ms, count(*) FILTER ({sql_truthy('error')}) AS error_spans,
          coalesce(any_value(n), 0) AS critical_spans
        FROM placed LEFT JOIN (SELECT exec_id, count(*) AS n FROM critical GROUP BY exec_id) USING (exec_id) GROUP BY exec_id""",
        _BOUNDS, _CRITICAL),
    "participants": on_spans(
        """SELECT exec_id, component, lower(split_part(component, ':', 1)) AS component_type,
          regexp_replace(component, '[^a-zA-Z0-9]', '_', 'g') AS participant_id, idx FROM people""", _PEOPLE),
    "retry_groups": on_spans("SELECT * FROM retries", _RETRY),
    "sequence_events": on_spans(
        f"""SELECT exec_id, row_number() OVER ({_ORDER}) AS pos, span_id, kind, source, target,
          CASE WHEN kind = 'response' THEN operation || ' response' ELSE operation END AS label, coalesce(attempt, 1) AS attempt,
          CASE WHEN kind = 'response' THEN round((epoch_us(end_at) - epoch_us(start_at)) / 1000.0, 6) END AS latency_ms,
          kind = 'response' AND error IS NOT NULL AS has_error FROM arrows""", _ARROWS),
    "sequence_text": on_spans(
        f"""SELECT exec_id, 2 AS section, pos, line, text FROM body
        UNION ALL SELECT exec_id, 1, idx, 0, '    participant ' || {_KEY.format(c='component')} || ' as ' || component FROM people
        UNION ALL SELECT DISTINCT exec_id, 0, 0, 0, 'sequenceDiagram' FROM spans
        UNION ALL SELECT DISTINCT exec_id, 1, 1099511627776, 0, '' FROM spans""", _TEXT),
    "caller_edges": on_spans("SELECT caller, component, count(*) AS calls FROM callers GROUP BY ALL", _CALLERS),
    "span_tree": on_spans(
        """SELECT t.exec_id, t.span_id, t.parent_span_id, root, depth, attached,
          (SELECT count(*) FROM spans c WHERE c.exec_id = t.exec_id AND c.parent_span_id = t.span_id) AS children FROM tree t""", _TREE),
    "span_ancestors": on_spans(
        "SELECT exec_id, seed, span_id, distance FROM up WHERE distance > 0 AND span_id IS NOT NULL", _SEEDS,
        """up AS (SELECT exec_id, seed, seed AS span_id, CAST(0 AS BIGINT) AS distance FROM seeds
          UNION ALL SELECT u.exec_id, seed, s.parent_span_id, distance + 1 FROM up u JOIN spans s ON s.exec_id = u.exec_id AND s.span_id = u.span_id)"""),
    "span_descendants": on_spans(
        "SELECT exec_id, seed, span_id, distance FROM down WHERE distance > 0", _SEEDS,
        """down AS (SELECT exec_id, seed, seed AS span_id, CAST(0 AS BIGINT) AS distance FROM seeds
          UNION ALL SELECT u.exec_id, seed, s.span_id, distance + 1 FROM down u JOIN spans s ON s.exec_id = u.exec_id AND s.parent_span_id = u.span_id)"""),
    "critical_path": on_spans("SELECT exec_id, span_id, depth FROM critical JOIN tree USING (exec_id, span_id)", _CRITICAL),
    "orphan_spans": on_spans(
        "SELECT exec_id, span_id, parent_span_id FROM callers WHERE parent_span_id IS NOT NULL AND parent_component IS NULL", _CALLERS),
    "invariants_long": on_spans(
        "SELECT exec_id, invariant, violations = 0 AS passed, violations FROM long", REPEATED, _RULES.replace("{t}", "repeated")),
    "invariants_summary": on_spans(
        """SELECT invariant, count(*) FILTER (violations = 0) AS passed, count(*) FILTER (violations > 0) AS failed,
          CAST(sum(violations) AS BIGINT) AS violations FROM long GROUP BY invariant""", _RULES.replace("{t}", "spans")),
    "invariant_violations": on_spans(
        f"""SELECT exec_id, 'valid_timestamps' AS invariant, span_id, ts_start || ' > ' || ts_end AS detail FROM repeated WHERE end_at < start_at
        UNION ALL SELECT exec_id, 'max_retry_count', span_id, 'retries ' || (attempt - 1) FROM repeated WHERE attempt > 6
        UNION ALL SELECT exec_id, 'no_error_spans', span_id, regexp_extract(error, '": "(.*)"', 1) FROM repeated WHERE {sql_truthy('error')}
        UNION ALL SELECT exec_id, 'no_duplicate_span_ids', span_id, 'written ' || count(*) || ' times' FROM repeated GROUP BY exec_id, span_id HAVING count(*) > 1
        UNION ALL SELECT exec_id, 'no_orphan_spans', span_id, 'parent ' || parent_span_id FROM repeated s WHERE parent_span_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM repeated p WHERE p.exec_id = s.exec_id AND p.span_id = s.parent_span_id)""", REPEATED),
    "required_components": on_spans(
        """SELECT exec_id, c AS component FROM (SELECT exec_id, list(DISTINCT component) AS have FROM spans GROUP BY exec_id),
          (SELECT unnest(['entrypoint:web', 'model:pay']) AS c) WHERE NOT list_contains(have, c)"""),
    "logging_gaps": on_spans("SELECT * FROM gaps", _GAPS),
    "gap_rollup": on_spans("SELECT severity, component, count(*) AS gaps FROM gaps GROUP BY ALL", _GAPS),
    "path_steps": on_spans("SELECT exec_id, pos, component, operation FROM steps", _STEPS),
    "path_texts": on_spans(
        f"""SELECT path_key, pos, component || ':' || operation AS step
        FROM steps JOIN (SELECT path_key, {_FIRST} AS exec_id FROM sigs GROUP BY path_key) USING (exec_id)""", _SIGS),
    "path_signatures": on_spans(
        "SELECT exec_id, path_key, steps, has_error, retries, latency_us FROM sigs", _SIGS),
    "path_stats": on_spans(
        f"""SELECT path_key, {_FIRST} AS example, count(*) AS executions, round(sum(latency_us) / 1000.0, 6) AS total_latency_ms,
          round(min(latency_us) / 1000.0, 6) AS min_latency_ms, round(max(latency_us) / 1000.0, 6) AS max_latency_ms,
          round(sum(latency_us) / 1000.0 / count(*), 6) AS avg_latency_ms, count(*) FILTER (has_error) AS errors
        FROM sigs GROUP BY path_key""", _SIGS),
    "compare_deltas": on_spans(
        """SELECT path_key, example, baseline_count, current_count, baseline_errors, current_errors, is_new, is_missing,
          round(baseline_avg_ms, 6) AS baseline_avg_ms, round(current_avg_ms, 6) AS current_avg_ms, round(delta, 6) AS latency_delta_ms,
          round(pct, 6) AS latency_delta_pct, round(baseline_error_rate, 6) AS baseline_error_rate,
          round(current_error_rate, 6) AS current_error_rate, round(error_rate_delta, 6) AS error_rate_delta FROM deltas""", _DELTAS),
    "compare_verdict": on_spans(
        """SELECT count(*) FILTER (is_new) AS new_paths, count(*) FILTER (is_missing) AS missing_paths,
          count(*) FILTER (NOT is_new AND NOT is_missing AND abs(pct) > 10) AS latency_changes,
          count(*) FILTER (NOT is_new AND NOT is_missing AND error_rate_delta > 0) AS error_regressions,
          count(*) FILTER (NOT is_new AND NOT is_missing AND abs(pct) <= 10 AND error_rate_delta <= 0) AS stable_paths,
          count(*) FILTER (is_missing OR (NOT is_new AND error_rate_delta > 0)) > 0 AS has_regressions FROM deltas""", _DELTAS),
    "window_scan": on_spans(
        """SELECT span_id, component, logged_at FROM spans WHERE component IN ('model:pay', 'agent:router')
          AND logged_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' ORDER BY logged_at, seq LIMIT 1000"""),
    "id_filter_scan": on_spans(
        """SELECT span_id, trace_id, agent_session_id FROM spans
          WHERE trace_id IN (SELECT trace_id FROM spans WHERE operation = 'error' AND attempt = 7 AND trace_id IS NOT NULL)
             OR agent_session_id IN ('a-1-0', 'a-2-1')"""),
    "search_spans": on_spans(
        """SELECT span_id, component, operation FROM spans WHERE component LIKE '%render%' OR operation LIKE '%render%'
          OR levenshtein(lower(operation), 'render') <= 2 OR levenshtein(lower(component), 'render') <= 2 OR levenshtein(span_id, 'render') <= 2"""),
    "filtered_spans": on_spans(
        """SELECT 'errors' AS kind, component, count(*) AS spans FROM spans WHERE error IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'retries', component, count(*) FROM spans WHERE attempt > 1 GROUP BY ALL"""),
    "span_payloads": on_spans(
        """SELECT span_id, 'request' AS kind, request AS payload FROM spans WHERE request IS NOT NULL
        UNION ALL SELECT span_id, 'response', response FROM spans WHERE response IS NOT NULL
        UNION ALL SELECT span_id, 'error', error FROM spans WHERE error IS NOT NULL"""),
}
