import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanloom.operators import agent_trace as ag
from spanloom.operators.chains import bridge_values, chain_entries, chain_facts, chain_spans, with_payload
from spanloom.operators.components import connected_components
from spanloom.operators.profile import log_entries
from spanloom.operators.stitch import expand_from, stitch
from spanloom.sources.logs import scan_log_lines


def _least_labels(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)).filter(lambda t: t[0] != t[1]), min_size=1, max_size=40))
def test_components_match_union_find(spark, links):
    links = [(f"n{a:02d}", f"n{b:02d}") for a, b in links]
    df = spark.createDataFrame(links, "src string, dst string")
    got = {r["node"]: r["label"] for r in connected_components(df).collect()}
    assert got == _least_labels(links)


def test_long_path_and_hub(spark):
    links = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("hub", f"z{i}") for i in range(200)]
    random.Random(3).shuffle(links)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got == _least_labels(links)


def test_stitch_transitive_and_typed(spark, make_spans):
    s = make_spans(
        {"trace_id": "1", "request_id": "r"}, {"request_id": "r", "thread_id": "123.456"}, {"session_id": "123.456"},
        {"trace_id": "r"}, {},
    )
    got = {r["span_id"]: r["group_id"] for r in stitch(s).collect()}
    assert got["s0"] == got["s1"] == got["s2"] != got["s3"] and got["s4"] is None
    seeds = spark.createDataFrame([("s2",), ("s4",)], "span_id string")
    assert {r["span_id"] for r in expand_from(stitch(s), seeds).collect()} == {"s0", "s1", "s2", "s4"}


def _entries(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, line string")
    return log_entries(scan_log_lines(df).select("seq", "json"))


CHAT = (
    '{"appname": "bot-orchestrator", "level": "INFO", "logger_name": "main", "message": "Event_body is {\'ts\': \'1768927632.159269\', \'channel\': \'C07GVLMH5EG\'}", "timestamp": "2025-06-20T17:27:12.268959"}',
    '{"component": "bedrock", "level": "ERROR", "message": "Agent retry 3 failed", "session_id": "1768927632.159269", "timestamp": 1750440432268}',
    '{"component": "sqs", "level": "INFO", "message": "unrelated"}',
)


def test_chain_through_a_chat_time(spark):
    entries = _entries(spark, *CHAT)
    chained = chain_entries(entries)
    facts = chain_facts(chained).collect()
    assert [(r["chain_id"], r["entries"], r["flow"]) for r in facts] == [("chain-0", 2, "lambda → bedrock")]
    assert [(r["value"], r["components"]) for r in bridge_values(chained).collect()] == [("1768927632.159269", ["bedrock", "lambda"])]
    a, b = chain_spans(with_payload(chained, entries)).orderBy("seq").collect()
    assert a["parent_span_id"] is None and b["parent_span_id"] == "chain-0-0"
    assert a["thread_id"] == b["thread_id"] == "1768927632.159269"
    assert '"channel": "C07GVLMH5EG"' in a["request"]
    assert b["attempt"] == 3 and '"level":"ERROR"' in b["error"] and b["ts_start"].startswith("2025-06-20T17:27:12.268")


def test_a_value_of_all_entries_makes_one_chain(spark):
    texts = [f'{{"component": "c{i % 2}", "message": "trace id: shared", "session_id": "pair-{i // 2}"}}' for i in range(6)]
    assert chain_facts(chain_entries(_entries(spark, *texts))).count() == 1


def _greedy(logs, traces):
    used, out = set(), {}
    for seq, op, req, res in logs:
        for tseq, top, treq, tres in traces:
            same = op == top or ("Model" in op and "Model" in top)
            if tseq not in used and same and ((not req and treq) or (not res and tres)):
                used.add(tseq)
                out[seq] = tseq
                break
    return out


def test_enrich_is_first_fit(spark):
    rnd = random.Random(5)
    ops = ["InvokeModel", "CallModel", "Run"]
    schema = "seq long, span_id string, operation string, request string, response string, agent_session_id string, thread_id string, session_id string, start_at timestamp, end_at timestamp"

    def row(seq, prefix, session):
        r, s = rnd.random() < 0.5, rnd.random() < 0.5
        return (seq, f"{prefix}{seq}", rnd.choice(ops), f"{prefix}q{seq}" if r else None, f"{prefix}r{seq}" if s else None, session, "th", None, None, None)

    logs = [row(i, "l", f"s{i % 3}") for i in range(30)]
    traces = [row(100 + i, "t", f"s{i % 3}") for i in range(24)]
    want = {}
    for session in ("s0", "s1", "s2"):
        want.update(_greedy(*[[(r[0], r[2], r[3], r[4]) for r in part if r[5] == session] for part in (logs, traces)]))
    got = {r["span_id"]: r for r in ag.enrich(spark.createDataFrame(logs, schema), spark.createDataFrame(traces, schema)).collect()}
    by_seq = {r[0]: r for r in traces}
    for r in logs:
        hit = by_seq.get(want.get(r[0]))
        g = got[r[1]]
        assert g["request"] == (r[3] or (hit and hit[3])) and g["response"] == (r[4] or (hit and hit[4]))
        assert g["thread_id"] == (None if hit else "th")
    assert {s for s in got if s.startswith("t")} == {f"t{s}" for s in by_seq if s not in want.values()}


def _in_turn(wants, offers):
    """First fit, one span in need after the other; {place in need: place of offer}."""
    queues = {k: sorted(p for p, has in offers if has == k) for k in ag.KINDS}
    out = {}
    for pos, (r, s) in wants:
        usable = [q for (has_r, has_s), q in queues.items() if q and ((r and has_r) or (s and has_s))]
        if usable:
            out[pos] = min(usable, key=lambda q: q[0]).pop(0)
    return out


@pytest.mark.parametrize("shares", [(1, 1, 1, 1, 1, 1), (5, 1, 0, 1, 5, 1), (1, 4, 1, 6, 1, 1), (3, 3, 0, 5, 1, 1)])
def test_enrich_cuts_a_busy_session_into_blocks(spark, shares):
    rnd = random.Random(sum(shares))
    kinds = list(ag.KINDS)
    wants = [(i, rnd.choices(kinds, shares[:3])[0]) for i in range(500)]
    # The kinds that are offered change on the way.
    offers = [(i, rnd.choices(kinds, shares[3:] if i % 200 < 120 else shares[:3][::-1])[0]) for i in range(460)]
    schema = "seq long, span_id string, operation string, request string, response string, agent_session_id string, thread_id string, session_id string, start_at timestamp, end_at timestamp"
    logs = [(i, f"l{i}", "Run", None if r else "own", None if s else "own", "s", "th", None, None, None) for i, (r, s) in wants]
    traces = [(i, f"t{i}", "Run", f"q{i}" if r else None, f"r{i}" if s else None, "s", None, None, None, None) for i, (r, s) in offers]
    want = _in_turn(wants, offers)
    flags = dict(offers)
    got = {r["span_id"]: r for r in ag.enrich(spark.createDataFrame(logs, schema), spark.createDataFrame(traces, schema), block=60).collect()}
    for i, (r, s) in wants:
        hit = want.get(i)
        has = flags.get(hit, (False, False))
        row = got[f"l{i}"]
        assert row["request"] == ("own" if not r else f"q{hit}" if has[0] else None)
        assert row["response"] == ("own" if not s else f"r{hit}" if has[1] else None)
        assert row["thread_id"] == ("th" if hit is None else None)
    assert {x for x in got if x[0] == "t"} == {f"t{i}" for i, _ in offers} - {f"t{i}" for i in want.values()}


def test_enrich_tells_rows_of_one_place_apart(spark):
    schema = "seq long, span_id string, operation string, request string, response string, agent_session_id string, thread_id string, session_id string, start_at timestamp, end_at timestamp"
    logs = [(1, "log-1", "InvokeAgent", None, None, "s", "th", None, None, None)]
    traces = [
        (1, "root", "InvokeAgent", "rq", "rs", "s", None, None, None, None),
        (1, "why", "Rationale", "because", None, "s", None, None, None, None),
        (2, "model", "InvokeModel", "in", "out", "s", None, None, None, None),
    ]
    got = ag.enrich(spark.createDataFrame(logs, schema), spark.createDataFrame(traces, schema)).collect()
    assert sorted((r["span_id"], r["request"], r["response"]) for r in got) == [("log-1", "rq", "rs"), ("model", "in", "out"), ("why", "because", None)]


def test_json_written_in_a_message_is_text_and_objects_are_not(spark):
    texts = [
        '{"level": "WARN", "message": "{\\"event\\": \\"error\\", \\"x\\": \\"failed\\"}", "session_id": "s-77777777"}',
        '{"level": "WARN", "message": {"event": "error", "x": "failed"}, "session_id": "s-77777777", "component": "c"}',
        '{"timestamp": 1, "message": {"a": 1, "traceId": "x-1"}, "session_id": "s-77777777"}',
    ]
    entries = _entries(spark, *texts)
    assert entries.filter("idx = 2").first()["record"]["message"].startswith("{")
    a, b, _ = chain_spans(with_payload(chain_entries(entries), entries)).orderBy("seq").collect()
    assert a["operation"] == "error" and '"level":"WARN"' in a["error"]
    assert b["operation"] == "log" and b["error"] is None
