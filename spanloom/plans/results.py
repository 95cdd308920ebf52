"""Queries over runs: throttling, soak, suites, derived cases, coverage, agent traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import agent_trace as ag
from spanloom.operators import derive as dv
from spanloom.operators import executions as ex
from spanloom.operators import soak as sk
from spanloom.operators import suite as su
from spanloom.plans.oracle import AGENT, on_spans, sql
from spanloom.plans.oracle import truthy as sql_truthy
from spanloom.plans.spans import _EXECS, _RULES, rounded
from spanloom.sources.driver_tables import agent_events, spans


def throttle_events(spark, d):
    return sk.throttle_events(spans(spark, d)).select("span_id", "throttle_type", "details")


def throttle_by_type(spark, d):
    return sk.throttles_by_type(sk.throttle_events(spans(spark, d)))


def _daily(spark, d) -> DataFrame:
    # One day of spans is one iteration of the run.
    return spans(spark, d).withColumn("iteration", F.dayofyear("logged_at").cast("long"))


def soak_iterations(spark, d):
    return rounded(sk.soak_iterations(_daily(spark, d)), "duration_ms")


def soak_summary(spark, d):
    return rounded(
        sk.soak_summary(sk.soak_iterations(_daily(spark, d))),
        "pass_rate", "consistency_score", "warning_rate", "avg_iteration_ms", "avg_retries_per_iteration", "throttle_rate",
    )


def _rate_changes(spark, d) -> DataFrame:
    rate = F.col("span_count") / F.lit(86400.0)
    days = sk.soak_iterations(_daily(spark, d)).withColumn("run", F.lit("january"))
    return sk.observed_rate_changes(days, rate)


def rate_changes(spark, d):
    return rounded(_rate_changes(spark, d).drop("run"), "old_rate", "new_rate")


def rate_stats(spark, d):
    return rounded(sk.rate_statistics(_rate_changes(spark, d), 0.1, 10.0), "current_rate")


def _cases(spark, d) -> DataFrame:
    # A case is called after the first component and operation of its execution.
    s = spans(spark, d)
    first = s.groupBy("exec_id").agg(F.min(F.struct("seq", "component", "operation")).alias("f")).select(
        "exec_id",
        F.concat_ws("_", F.split_part("f.component", F.lit(":"), F.lit(1)), "f.operation", "exec_id").alias("case_id"),
    )
    return su.case_results(s).join(first, "exec_id")


def case_results(spark, d):
    return rounded(
        _cases(spark, d).withColumn("invariant_failures", F.array_join("invariant_failures", ",")), "duration_ms"
    )


def suite_summary(spark, d):
    return rounded(su.suite_summary(_cases(spark, d)), "pass_rate")


def case_groups(spark, d):
    return rounded(su.case_groups(_cases(spark, d), "case_id"), "duration_ms")


def failing_cases(spark, d):
    return su.filter_cases(_cases(spark, d), "failed").select("case_id", "retry_count")


def derived_cases(spark, d):
    s = ex.assign_executions(spans(spark, d), ex.DERIVE_IDS).filter(F.col("exec_id").isNotNull())
    return dv.cases_from_executions(s, "lambda_invoke").select(
        "case_id", "name", "entrypoint_type", "payload", "derived_from", "span_count"
    )


def _coverage(spark, d) -> DataFrame:
    # Detected: all components. Covered: those of executions that passed.
    s = ex.assign_executions(spans(spark, d))
    passed = ex.filter_executions(ex.execution_summary(s), "passed")
    covered = passed.select(F.explode("components").alias("component"))
    extra = s.filter("attempt = 7").select(F.concat("component", F.lit("-retry")).alias("component"))
    return dv.component_coverage(s, covered.unionByName(extra))


def component_coverage(spark, d):
    return _coverage(spark, d)


def coverage_summary(spark, d):
    return rounded(dv.coverage_summary(_coverage(spark, d)), "coverage_pct")


def skeleton_cases(spark, d):
    return dv.skeleton_cases(_coverage(spark, d)).select(
        "case_id", "name", F.array_join("required_components", ",").alias("required")
    )


def agent_event_pairs(spark, d):
    pairs = ag.event_pairs(agent_events(spark, d))
    for c in ("opened_at", "closed_at"):
        pairs = pairs.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return pairs


def agent_spans(spark, d):
    found = ag.agent_spans(agent_events(spark, d)).drop("seq")
    for c in ("start_at", "end_at"):
        found = found.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return found


def enriched_spans(spark, d):
    """Log spans made of turns lack responses (and every fourth its request), and one
    for the whole session lacks both; agent spans of the same conversation fill them in."""
    events = agent_events(spark, d)
    found = ag.agent_spans(events)
    none = F.lit(None)
    logged = events.filter(F.col("kind").isin("model_in", "action_in", "rationale")).select(
        "seq",
        F.concat(F.lit("log-"), "seq").alias("span_id"),
        F.when(F.col("kind") == "model_in", "CallModel").when(F.col("kind") == "rationale", "Rationale").otherwise("InvokeActionGroup").alias("operation"),
        F.when(F.col("seq") % 4 != 0, F.col("payload")).alias("request"),
        none.cast("string").alias("response"),
        F.col("at").alias("start_at"),
        none.cast("timestamp").alias("end_at"),
        F.col("session_id").alias("agent_session_id"),
        F.col("session_id").alias("thread_id"),
    )
    # In the place of the session's first turn.
    whole = events.groupBy("session_id").agg(F.min("seq").alias("seq")).select(
        "seq", F.concat(F.lit("agent-"), "session_id").alias("span_id"), F.lit("InvokeAgent").alias("operation"),
        none.cast("string").alias("request"), none.cast("string").alias("response"),
        none.cast("timestamp").alias("start_at"), none.cast("timestamp").alias("end_at"),
        F.col("session_id").alias("agent_session_id"), F.col("session_id").alias("thread_id"),
    )
    logged = logged.unionByName(whole)
    return ag.enrich(logged, found).select("span_id", "operation", "request", "response", "agent_session_id", "thread_id")


QUERIES = {
    f.__name__: f
    for f in (
        throttle_events, throttle_by_type, soak_iterations, soak_summary, rate_changes, rate_stats, case_results,
        suite_summary, case_groups, failing_cases, derived_cases, component_coverage, coverage_summary,
        skeleton_cases, agent_event_pairs, agent_spans, enriched_spans,
    )
}

# --- DuckDB twins ---

_ERR = "lower(coalesce(error, ''))"
_THROTTLE = f"""throttle AS (
  SELECT span_id, CASE WHEN contains({_ERR}, 'throttlingexception') THEN 'aws_throttle' ELSE 'rate_limit' END AS throttle_type, error AS details
  FROM spans WHERE contains({_ERR}, 'throttlingexception') OR contains({_ERR}, 'rate exceeded')
  UNION ALL SELECT span_id, 'retry_storm', 'High retry count: ' || (attempt - 1) FROM spans WHERE attempt - 1 >= 3
  UNION ALL SELECT span_id, 'timeout', 'Request timeout' FROM spans WHERE contains({_ERR}, 'timeout'))"""
_DAYS = f"""days AS (
  SELECT *, CASE WHEN error_count > 0 AND retry_count > 0 THEN 'warning' WHEN error_count > 0 THEN 'failed'
      WHEN retry_count > 0 THEN 'warning' ELSE 'passed' END AS status
  FROM (SELECT dayofyear(logged_at) AS iteration, count(*) AS span_count, count(*) FILTER ({sql_truthy('error')}) AS error_count,
    CAST(sum(coalesce(attempt, 1) - 1) AS BIGINT) AS retry_count,
    CAST(sum((contains({_ERR}, 'throttlingexception') OR contains({_ERR}, 'rate exceeded'))::INT
      + coalesce(attempt - 1 >= 3, false)::INT + contains({_ERR}, 'timeout')::INT) AS BIGINT) AS throttle_events,
    (epoch_us(max(end_at)) - epoch_us(min(start_at))) / 1000.0 AS duration_ms FROM spans GROUP BY 1)),
iterations AS (SELECT *, status IN ('passed', 'warning') AS passed, retry_count = 0 AND error_count = 0 AS is_clean_pass FROM days)"""
_CHANGES = _DAYS + """, changes AS (
  SELECT iteration AS at_day, old_rate, new_rate, CASE WHEN throttle_events > 0 THEN 'throttle' ELSE 'stability' END AS reason
  FROM (SELECT *, span_count / 86400.0 AS new_rate, lag(span_count / 86400.0) OVER (ORDER BY iteration) AS old_rate FROM iterations)
  WHERE old_rate <> new_rate)"""
_CASES = _RULES.replace("{t}", "spans") + f""", broken AS (
  SELECT exec_id, string_agg(invariant, ',' ORDER BY invariant) AS invariant_failures FROM long
  WHERE violations > 0 AND invariant <> 'required_components' GROUP BY exec_id),
cases AS (
  SELECT exec_id, span_count, error_count, retry_count, duration_ms, coalesce(invariant_failures, '') AS invariant_failures,
    CASE WHEN invariant_failures IS NOT NULL THEN 'failed' WHEN retry_count > 0 OR error_count > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status,
    split_part(c, ':', 1) || '_' || o || '_' || exec_id AS case_id, split_part(c, ':', 1) AS head, o
  FROM (SELECT exec_id, count(*) AS span_count, count(*) FILTER ({sql_truthy('error')}) AS error_count, count(*) FILTER (attempt > 1) AS retry_count,
      coalesce((epoch_us(max(end_at)) - epoch_us(min(start_at))) / 1000.0, 0.0) AS duration_ms, arg_min(component, seq) AS c, arg_min(operation, seq) AS o
    FROM spans GROUP BY exec_id) LEFT JOIN broken USING (exec_id))"""
_COVER = _EXECS + """, good AS (
  SELECT e FROM execs WHERE e IS NOT NULL GROUP BY e HAVING count(error) = 0 AND count(*) FILTER (attempt > 1) = 0),
detected AS (SELECT DISTINCT component FROM spans),
covered AS (SELECT DISTINCT component FROM execs JOIN good USING (e) UNION SELECT DISTINCT component || '-retry' FROM spans WHERE attempt = 7),
coverage AS (
  SELECT component, 'covered' AS state FROM detected WHERE component IN (SELECT component FROM covered)
  UNION ALL SELECT component, 'uncovered' FROM detected WHERE component NOT IN (SELECT component FROM covered)
  UNION ALL SELECT component, 'extra' FROM covered WHERE component NOT IN (SELECT component FROM detected))"""
_PAIRS = AGENT + """, pairs AS (
  SELECT session_id, 'x' AS k, call, prev_seq AS in_seq, seq AS out_seq, prev_at AS opened_at, at_ AS closed_at, action_group, prev_payload AS request, payload AS response
  FROM (SELECT *, at_, lag(kind) OVER w AS prev_kind, lag(seq) OVER w AS prev_seq, lag(at_) OVER w AS prev_at, lag(payload) OVER w AS prev_payload
    FROM (SELECT * RENAME (moment AS at_), CASE WHEN kind LIKE 'model%' THEN 'model' ELSE 'action' END AS call FROM agent WHERE kind <> 'rationale')
    WINDOW w AS (PARTITION BY session_id, call ORDER BY at_, seq))
  WHERE kind LIKE '%_out' AND prev_kind LIKE '%_in')"""
_AGENT_SPANS = _PAIRS + """, kids AS (
  SELECT session_id, call AS kind, CASE WHEN call = 'model' THEN 'agent:bedrock-model' ELSE 'lambda:' || action_group END AS component,
    CASE WHEN call = 'model' THEN 'InvokeModel' ELSE 'InvokeActionGroup' END AS operation, opened_at AS start_at, closed_at AS end_at,
    request, response, closed_at AS done, out_seq AS seq FROM pairs
  UNION ALL SELECT session_id, kind, 'agent:bedrock-rationale', 'Rationale', moment, NULL, payload, NULL, moment, seq FROM agent WHERE kind = 'rationale'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY done, seq) AS n FROM kids),
agent_span AS (
  SELECT session_id, 'bedrock-' || kind || '-' || lpad(n::VARCHAR, 3, '0') AS span_id, 'bedrock-orchestrator-000' AS parent_span_id,
    component, operation, start_at, end_at, request, response, seq FROM numbered
  UNION ALL
  SELECT session_id, 'bedrock-orchestrator-000', NULL, 'agent:bedrock-orchestrator', 'InvokeAgent', min(moment), max(moment),
    '{"session_id":"' || session_id || '"}', '{"trace_id":"' || arg_min(trace_id, moment) || '"}', min(seq) FROM agent GROUP BY session_id)"""
_ENRICH = _AGENT_SPANS + """, logged AS (
  SELECT seq, 'log-' || seq AS span_id, CASE WHEN kind = 'model_in' THEN 'CallModel' ELSE 'InvokeActionGroup' END AS operation,
    CASE WHEN kind = 'model_in' THEN 'Model' ELSE 'InvokeActionGroup' END AS class,
    CASE WHEN seq % 4 <> 0 THEN payload END AS request, session_id,
    row_number() OVER (PARTITION BY session_id, kind ORDER BY seq) AS n FROM agent WHERE kind IN ('model_in', 'action_in')
  UNION ALL SELECT min(seq), 'agent-' || session_id, 'InvokeAgent', 'InvokeAgent', NULL, session_id, 1 FROM agent GROUP BY session_id
  UNION ALL SELECT seq, 'log-' || seq, 'Rationale', 'Rationale', request, session_id,
    CASE WHEN request IS NULL THEN row_number() OVER (PARTITION BY session_id, request IS NULL ORDER BY seq) END
  FROM (SELECT seq, session_id, CASE WHEN seq % 4 <> 0 THEN payload END AS request FROM agent WHERE kind = 'rationale')),
offered AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, class ORDER BY seq) AS n
  FROM (SELECT *, CASE WHEN contains(operation, 'Model') THEN 'Model' ELSE operation END AS class FROM agent_span)),
matched AS (
  SELECT l.*, o.span_id AS used, o.request AS req, o.response AS res FROM logged l LEFT JOIN offered o USING (session_id, class, n))"""

_SPAN_COLUMNS = "session_id, session_id AS agent_session_id, span_id, parent_span_id, component, operation, start_at, end_at, request, response"

ORACLES = {
    "throttle_events": on_spans("SELECT * FROM throttle", _THROTTLE),
    "throttle_by_type": on_spans("SELECT throttle_type, count(*) AS events FROM throttle GROUP BY 1", _THROTTLE),
    "soak_iterations": on_spans(
        """SELECT iteration, span_count, error_count, retry_count, round(duration_ms, 6) AS duration_ms, status, passed, is_clean_pass,
          throttle_events FROM iterations""", _DAYS),
    "soak_summary": on_spans(
        """SELECT count(*) AS total_iterations, count(*) FILTER (passed) AS total_passed,
          count(*) FILTER (passed AND is_clean_pass) AS total_clean_passes, count(*) FILTER (status = 'warning') AS total_warnings,
          count(*) FILTER (NOT passed) AS total_failures, round(count(*) FILTER (passed) / count(*), 6) AS pass_rate,
          round(coalesce(count(*) FILTER (passed AND is_clean_pass) / nullif(count(*) FILTER (passed), 0), 0), 6) AS consistency_score,
          round(coalesce(count(*) FILTER (status = 'warning') / nullif(count(*) FILTER (passed), 0), 0), 6) AS warning_rate,
          round(sum(CAST(round(duration_ms * 1000) AS BIGINT)) / 1000.0 / count(*), 6) AS avg_iteration_ms,
          CAST(sum(retry_count) AS BIGINT) AS total_retries, round(sum(retry_count) / count(*), 6) AS avg_retries_per_iteration,
          max(retry_count) AS max_retries, CAST(sum(throttle_events) AS BIGINT) AS total_throttle_events,
          round(count(*) FILTER (throttle_events > 0) / count(*), 6) AS throttle_rate, count(*) FILTER (passed) / count(*) >= 0.9 AS accepted FROM iterations""",
        _DAYS),
    "rate_changes": on_spans(
        'SELECT at_day AS "at", round(old_rate, 6) AS old_rate, round(new_rate, 6) AS new_rate, reason FROM changes', _CHANGES),
    "rate_stats": on_spans(
        """SELECT count(*) AS total_adjustments, count(*) FILTER (reason = 'throttle') AS throttle_decreases,
          count(*) FILTER (reason = 'stability') AS stability_increases, round(arg_max(new_rate, at_day), 6) AS current_rate,
          arg_max(new_rate, at_day) <= 0.1 AS min_rate_hit, arg_max(new_rate, at_day) >= 10 AS max_rate_hit FROM changes""", _CHANGES),
    "case_results": on_spans(
        """SELECT exec_id, span_count, error_count, retry_count, round(duration_ms, 6) AS duration_ms, invariant_failures, status, case_id FROM cases""",
        _CASES),
    "suite_summary": on_spans(
        """SELECT count(*) AS total_cases, count(*) FILTER (status = 'passed') AS passed,
          count(*) FILTER (status = 'passed_with_warnings') AS passed_with_warnings, count(*) FILTER (status = 'failed') AS failed,
          CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS skipped, round(count(*) FILTER (status = 'passed') / count(*) * 100, 6) AS pass_rate,
          count(*) FILTER (status = 'failed') = 0 AS all_passed, CAST(sum(span_count) AS BIGINT) AS total_spans,
          CAST(sum(error_count) AS BIGINT) AS total_errors FROM cases""", _CASES),
    "case_groups": on_spans(
        """SELECT upper(head[1]) || head[2:] || ' ' || upper(o[1]) || o[2:] AS name, count(*) AS total, count(*) FILTER (status = 'passed') AS passed,
          round(sum(CAST(round(duration_ms * 1000) AS BIGINT)) / 1000.0, 6) AS duration_ms, count(*) FILTER (status <> 'passed') = 0 AS all_passed,
          count(*) FILTER (status = 'failed') > 0 AS has_failures FROM cases GROUP BY head, o""", _CASES),
    "failing_cases": on_spans("SELECT case_id, retry_count FROM cases WHERE status = 'failed'", _CASES),
    "derived_cases": on_spans(
        f"""SELECT 'derived-' || e AS case_id, 'Derived from ' || arg_min(component, seq) || ':' || arg_min(operation, seq) AS name,
          'lambda_invoke' AS entrypoint_type, coalesce(min_by(r, seq)[1], '{{}}') AS payload, e AS derived_from, count(*) AS span_count
        FROM (SELECT *, [request] AS r, coalesce(trace_id, request_id, agent_session_id) AS e FROM spans) WHERE e IS NOT NULL GROUP BY e"""),
    "component_coverage": on_spans("SELECT * FROM coverage", _COVER),
    "coverage_summary": on_spans(
        """SELECT count(*) FILTER (state = 'covered') AS covered, count(*) FILTER (state = 'uncovered') AS uncovered,
          count(*) FILTER (state = 'extra') AS extra,
          round(coalesce(count(*) FILTER (state = 'covered') / nullif(count(*) FILTER (state <> 'extra'), 0) * 100, 0), 6) AS coverage_pct FROM coverage""",
        _COVER),
    "skeleton_cases": on_spans(
        """SELECT 'auto-' || split_part(component, ':', 2) AS case_id, 'Test ' || split_part(component, ':', 1) || ' ' || split_part(component, ':', 2) AS name,
          component AS required FROM coverage WHERE state = 'uncovered'""", _COVER),
    "agent_event_pairs": sql(_PAIRS, select="SELECT * EXCLUDE (k) FROM pairs"),
    "agent_spans": sql(_AGENT_SPANS, select=f"SELECT {_SPAN_COLUMNS} FROM agent_span"),
    "enriched_spans": sql(_ENRICH, select="""SELECT span_id, operation, coalesce(request, req) AS request, res AS response, session_id AS agent_session_id,
          CASE WHEN used IS NULL THEN session_id END AS thread_id FROM matched
        UNION ALL SELECT span_id, operation, request, response, session_id, NULL FROM offered o
          WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.session_id = o.session_id AND m.used = o.span_id)"""),
}
