"""Queries that link rows by shared values: stitched groups and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.entries import COMPONENT_WORDS
from spanloom.operators import chains as ch
from spanloom.operators import derive as dv
from spanloom.operators import profile as pf
from spanloom.operators import stitch as st
from spanloom.plans.oracle import EV, LINES, on_spans, sql
from spanloom.plans.texts import _SEARCH, _SHEETS, _UNWRAPPED
from spanloom.session import stored
from spanloom.sources.driver_tables import raw_logs, spans
from spanloom.sources.logs import scan_log_lines


def key_index(spark, d):
    return st.key_index(spans(spark, d))


def stitch_groups(spark, d):
    return st.stitch_groups(st.stitch(spans(spark, d)))


def stitched_spans(spark, d):
    return st.stitch(spans(spark, d)).select("span_id", "group_id")


def seeded_stitch(spark, d):
    s = spans(spark, d)
    seeds = s.filter("operation = 'error' AND attempt = 7")
    return st.expand_from(st.stitch(s), seeds).select("span_id")


def _entries(spark, d) -> DataFrame:
    lines = raw_logs(spark, d).select("seq", F.col("message").alias("line"))
    return pf.log_entries(scan_log_lines(lines).select("seq", "json"))


def log_entries(spark, d):
    values = F.array_sort(F.transform("correlation_values", lambda v: F.concat_ws("=", v["value_type"], v["value"])))
    return _entries(spark, d).select(
        F.col("idx").alias("seq"), "component", F.array_join(values, "|").alias("values")
    )


def component_counts(spark, d):
    return ch.component_counts(_entries(spark, d))


def shared_values(spark, d):
    return ch.value_frequency(_entries(spark, d), top=20)


def chains(spark, d):
    facts = ch.chain_facts(ch.chain_entries(_entries(spark, d)))
    return ch.with_min_components(facts).select("chain_id", "first_index", "entries", "component_count", "flow")


def bridge_values(spark, d):
    b = ch.bridge_values(ch.chain_entries(_entries(spark, d)))
    return b.select("chain_id", "value", F.array_join("components", ",").alias("components"))


def chain_summary(spark, d):
    s = ch.chain_summary(ch.chain_entries(_entries(spark, d)), bridges_shown=5)
    return s.select("chain_id", "entries", "component_count", "flow", F.array_join("bridges", ",").alias("bridges"))


def chain_spans(spark, d):
    # Read twice below; lines are parsed once.
    entries = stored(_entries(spark, d), "entries")
    return ch.chain_spans(ch.with_payload(ch.chain_entries(entries), entries)).select(
        "seq", "span_id", "parent_span_id", "component", "operation", "attempt", "trace_id", "thread_id",
        F.col("error").isNotNull().alias("failed"), F.col("response").isNotNull().alias("answered"),
    )


def derived_chain_cases(spark, d):
    entries = stored(_entries(spark, d), "entries")
    chained = ch.chain_entries(entries)
    facts = ch.with_min_components(ch.chain_facts(chained))
    cases = dv.cases_from_chains(ch.with_payload(chained, entries), facts, ch.primary_bridges(ch.bridge_values(chained)))
    rules = F.array_join(F.transform("invariants", lambda r: r["name"]), ",")
    return cases.select(
        "case_id", "name", "entrypoint_type", "payload", rules.alias("rules"), "primary_correlation_id",
        "component_count", "log_entry_count",
    )


QUERIES = {
    f.__name__: f
    for f in (
        key_index, stitch_groups, stitched_spans, seeded_stitch, log_entries, component_counts, shared_values,
        chains, bridge_values, chain_summary, chain_spans, derived_chain_cases,
    )
}

# --- DuckDB twins ---

_KEYS = """keyed AS (
  SELECT span_id, seq, attempt, operation, unnest(list_filter(['trace:' || trace_id, 'lambda:' || request_id, 'bedrock:' || agent_session_id,
    'thread:' || thread_id, 'session:' || session_id], lambda v: v IS NOT NULL)) AS key FROM spans)"""


def labels(keyed: str, node: str) -> str:
    """Least key per component: labels spread along links between keys of one row.
    USING KEY keeps one label per key, so only improvements are followed."""
    return f"""pairs AS (
  SELECT DISTINCT a.key AS src, b.low AS dst FROM {keyed} a JOIN (SELECT {node}, min(key) AS low FROM {keyed} GROUP BY {node}) b USING ({node})
  WHERE a.key <> b.low),
links AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs),
labels(key, label) USING KEY (key) AS (
  SELECT key, key AS label FROM (SELECT DISTINCT key FROM {keyed})
  UNION
  SELECT l.dst, min(c.label) FROM labels c JOIN links l ON l.src = c.key JOIN recurring.labels r ON r.key = l.dst
  WHERE c.label < r.label GROUP BY l.dst),
member AS (SELECT {node}, min(c.label) AS label FROM {keyed} k JOIN labels c USING (key) GROUP BY {node})"""


_STITCH = _KEYS + ", " + labels("keyed", "span_id")

def _words(text: str) -> str:
    options = [
        "{'s': " + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + f", 'r': {-rank}, 'n': '{name}'}}"
        for rank, (name, words) in enumerate(COMPONENT_WORDS.items())
    ]
    return f"list_max([{', '.join(options)}])"


_TYPES = {**pf.KEY_TYPES, **pf.NOISY_TYPES}
_ENTRY = f"""entry AS (
  SELECT *, coalesce(CASE style WHEN 0 THEN given WHEN 4 THEN 'lambda' END, inferred, CASE WHEN w.s > 0 THEN w.n END, 'unknown') AS component
  FROM (SELECT * EXCLUDE (component), component AS given, {_words('lower(message)')} AS w FROM sheets)),
typed AS (
  SELECT DISTINCT seq, component, kind, value FROM (
    {' UNION ALL '.join(f"SELECT seq, component, '{t}' AS kind, unnest(l_{n}) AS value FROM entry" for n, t in _TYPES.items())})),
plain AS (SELECT DISTINCT seq, component, value, value AS key FROM typed)"""


def _chains(keyed: str = "plain") -> str:
    return labels(keyed, "seq") + f""",
chained AS (
  SELECT seq, label, component, first_index, 'chain-' || first_index AS chain_id
  FROM (SELECT seq, label, count(*) OVER (PARTITION BY label) AS n, min(seq) OVER (PARTITION BY label) AS first_index FROM member)
  JOIN entry USING (seq) WHERE n > 1),
facts AS (
  SELECT chain_id, first_index, CAST(sum(n) AS BIGINT) AS entries, count(*) AS component_count, string_agg(component, ' → ' ORDER BY seen) AS flow,
    arg_min(component, seen) AS first_component, list(component) AS components
  FROM (SELECT chain_id, first_index, component, count(*) AS n, min(seq) AS seen FROM chained GROUP BY ALL) GROUP BY chain_id, first_index),
bridges AS (
  SELECT chain_id, value, string_agg(DISTINCT component, ',' ORDER BY component) AS components, count(DISTINCT component) AS n
  FROM (SELECT c.chain_id, c.component, p.value FROM chained c JOIN plain p USING (seq)) GROUP BY chain_id, value HAVING count(DISTINCT component) > 1),
bridge AS (SELECT chain_id, arg_min(value, {{'k': -n, 'v': value}}) AS bridge FROM bridges GROUP BY chain_id)"""


def on_entries(select: str, *more: str) -> str:
    return sql(EV, LINES, _SEARCH, _UNWRAPPED, _SHEETS, _ENTRY, *more, select=select)


_SPAN_ROWS = """SELECT seq, chain_id || '-' || (pos - 1) AS span_id, CASE WHEN pos > 1 THEN chain_id || '-' || (pos - 2) END AS parent_span_id,
    component,
    CASE WHEN style = 0 THEN event_type WHEN style = 1 THEN event_type WHEN style = 3 THEN CASE event_type WHEN 'error' THEN 'error' ELSE 'log' END ELSE
      CASE WHEN contains(m, 'received') THEN 'receive' WHEN contains(m, 'sending') OR contains(m, 'sent') THEN 'send'
           WHEN contains(m, 'invoking') OR contains(m, 'invoked') THEN 'invoke' WHEN contains(m, 'response') THEN 'response'
           WHEN contains(m, 'error') THEN 'error' ELSE 'log' END END AS operation,
    CASE WHEN style = 0 THEN 1 + k % 3 WHEN style = 6 AND k % 4 = 3 THEN 1 + k % 9 ELSE 1 END AS attempt,
    chain_id AS trace_id, coalesce(slack, bridge) AS thread_id,
    style = 6 AND k % 4 = 3 AS failed, false AS answered
  FROM (SELECT c.chain_id, c.component, e.*EXCLUDE (component), row_number() OVER (PARTITION BY c.chain_id ORDER BY c.seq) AS pos,
      CASE WHEN e.style IN (4, 5, 6) THEN lower(e.message) ELSE '' END AS m, l_slack_thread_ts[1] AS slack
    FROM chained c JOIN entry e USING (seq)) LEFT JOIN bridge USING (chain_id)"""

ORACLES = {
    "key_index": on_spans("SELECT DISTINCT key, span_id FROM keyed", _KEYS),
    "stitch_groups": on_spans("SELECT label AS group_id, count(*) AS spans FROM member GROUP BY 1", _STITCH),
    "stitched_spans": on_spans("SELECT span_id, label AS group_id FROM spans LEFT JOIN member USING (span_id)", _STITCH),
    "seeded_stitch": on_spans(
        """SELECT span_id FROM member WHERE label IN (SELECT label FROM member JOIN spans USING (span_id)
          WHERE operation = 'error' AND attempt = 7)""", _STITCH),
    "log_entries": on_entries(
        """SELECT seq, component, coalesce(string_agg(kind || '=' || value, '|' ORDER BY kind || '=' || value), '') AS values
          FROM entry LEFT JOIN (SELECT seq, kind, value FROM typed) USING (seq) GROUP BY seq, component"""),
    "component_counts": on_entries("SELECT component, count(*) AS entries FROM entry GROUP BY 1"),
    "shared_values": on_entries(
        "SELECT value, count(*) AS entries FROM plain GROUP BY value HAVING count(*) > 1 ORDER BY entries DESC, value LIMIT 20"),
    "chains": on_entries(
        "SELECT chain_id, first_index, entries, component_count, flow FROM facts WHERE component_count > 1", _chains()),
    "bridge_values": on_entries("SELECT chain_id, value, components FROM bridges", _chains()),
    "chain_summary": on_entries(
        """SELECT chain_id, entries, component_count, flow, array_to_string(b, ',') AS bridges FROM facts
          LEFT JOIN (SELECT chain_id, list(value ORDER BY value)[1:5] AS b FROM bridges GROUP BY chain_id) USING (chain_id)""", _chains()),
    "chain_spans": on_entries(_SPAN_ROWS, _chains()),
    "derived_chain_cases": on_entries(
        """SELECT chain_id AS case_id, 'Derived: ' || flow AS name,
          CASE split_part(first_component, ':', 1) WHEN 'sqs' THEN 'sqs_event' WHEN 'bedrock' THEN 'bedrock_invoke_agent'
            WHEN 'api_gateway' THEN 'http' WHEN 'slack' THEN 'http' ELSE 'lambda_invoke' END AS entrypoint_type,
          CASE WHEN e.style = 0 THEN '{"k":' || e.k || '}' ELSE '{}' END AS payload,
          concat_ws(',', 'has_spans', CASE WHEN list_contains(components, 'bedrock') THEN 'bedrock_response_present' END,
            CASE WHEN list_contains(components, 'slack') THEN 'slack_message_sent' END, 'component_flow') AS rules,
          bridge AS primary_correlation_id, component_count, entries AS log_entry_count
        FROM facts LEFT JOIN bridge USING (chain_id) JOIN entry e ON e.seq = first_index WHERE component_count > 1""", _chains()),
}
