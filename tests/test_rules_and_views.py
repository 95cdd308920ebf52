from spanloom.operators import compare as cmp
from spanloom.operators.executions import assign_executions, execution_summary, filter_executions, view_totals
from spanloom.operators.gaps import detect_gaps
from spanloom.operators.invariants import InvariantConfig, run_invariants
from spanloom.operators.sequence import messages, retry_groups, sequence_text
from spanloom.operators.soak import throttle_events
from spanloom.operators.suite import case_results, group_name, suite_summary
from spanloom.operators.timeline import timeline_positions
from spanloom.sources import logs
from pyspark.sql import functions as F

T0, T1, T2 = "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.250Z", "2024-01-01T00:00:01Z"


def test_execution_ids_in_order_of_preference(make_spans):
    s = make_spans(
        {"trace_id": "t", "session_id": "x"}, {"trace_id": "", "agent_session_id": "a"}, {"request_id": "r"}, {}
    )
    got = {r["span_id"]: r["exec_id"] for r in assign_executions(s).collect()}
    assert got == {"s0": "t", "s1": "a", "s2": "r", "s3": None}
    totals = view_totals(assign_executions(s)).first()
    assert totals["executions"] == 3 and totals["orphan_spans"] == 1


def test_summary_status_and_duration(make_spans):
    s = make_spans(
        {"exec_id": "e", "ts_start": T0, "ts_end": T1, "error": "{}"},
        {"exec_id": "w", "ts_start": T0, "ts_end": T2, "attempt": 2},
        {"exec_id": "p", "ts_start": "junk", "ts_end": T2},
    )
    got = {r["exec_id"]: r for r in execution_summary(s).collect()}
    assert (got["e"]["status"], got["e"]["duration_ms"]) == ("error", 250.0)
    assert (got["w"]["status"], got["w"]["duration_ms"]) == ("warning", 1000.0)
    assert (got["p"]["status"], got["p"]["duration_ms"], got["p"]["started_at"]) == ("passed", 0.0, None)
    kept = filter_executions(execution_summary(s), "warnings").select("exec_id").collect()
    assert {r[0] for r in kept} == {"e", "w"}


def test_invariants(spark, make_spans):
    s = make_spans(
        {"span_id": "a", "exec_id": "bad", "parent_span_id": "gone", "ts_start": T2, "ts_end": T0, "attempt": 7, "error": '{"message": "x"}'},
        {"span_id": "a", "exec_id": "bad", "parent_span_id": "gone"},
        {"exec_id": "good", "component": "api"},
    )
    wanted = spark.createDataFrame([("bad",), ("good",), ("none",)], "exec_id string")
    rows = run_invariants(s, InvariantConfig(required_components=["api"], check_errors=True), executions=wanted).collect()
    failed = {(r["exec_id"], r["invariant"]) for r in rows if not r["passed"]}
    assert {i for e, i in failed if e == "bad"} == {
        "no_duplicate_span_ids", "has_entrypoint", "no_orphan_spans", "valid_timestamps",
        "max_retry_count", "required_components", "no_error_spans",
    }
    assert not [i for e, i in failed if e == "good"]
    assert ("none", "has_spans") in failed
    orphans = [r["violations"] for r in rows if (r["exec_id"], r["invariant"]) == ("bad", "no_orphan_spans")]
    assert orphans == [2]
    plain = run_invariants(s).collect()
    assert "no_error_spans" not in {r["invariant"] for r in plain}


def test_gaps(make_spans):
    s = make_spans({"component": "agent:x", "thread_id": "1.2"}, {"component": "other", "parent_span_id": "no", "trace_id": "t", "ts_start": T0})
    got = sorted((r["severity"], r["component"], r["issue"]) for r in detect_gaps(s, "http").collect())
    assert got == sorted([
        ("critical", "agent:x", "Missing request payload"),
        ("warning", "agent:x", "Missing ts_start timestamp"),
        ("warning", "agent:x", "Missing response or error payload"),
        ("warning", "agent:x", "No correlation IDs present"),
        ("info", "other", "Orphaned span: parent no not found"),
        ("warning", "trace", "No entrypoint span found"),
        ("warning", "case", "Expected entrypoint type 'http' not found in trace"),
    ])


def test_compare_new_missing_and_regressed(make_spans):
    def sigs(*rows):
        return cmp.path_signatures(make_spans(*rows))

    base = sigs({"exec_id": "1", "component": "a", "ts_start": T0, "ts_end": T1}, {"exec_id": "2", "component": "gone"})
    cur = sigs({"exec_id": "3", "component": "a", "ts_start": T0, "ts_end": T2}, {"exec_id": "4", "component": "new"})
    deltas = cmp.compare(base, cur)
    shown = {r["example"]: r for r in deltas.collect()}
    assert shown["2"]["is_missing"] and shown["4"]["is_new"]
    assert shown["1"]["latency_delta_ms"] == 750.0 and shown["1"]["latency_delta_pct"] == 300.0
    v = cmp.verdict(deltas).first()
    assert (v["new_paths"], v["missing_paths"], v["latency_changes"], v["has_regressions"]) == (1, 1, 1, True)


def test_messages_and_text_with_times(make_spans):
    s = make_spans(
        {"component": "entrypoint:web", "ts_start": T0, "ts_end": T2, "response": "{}"},
        {"component": "lambda:f-1", "parent_span_id": "s0", "ts_start": T1, "ts_end": T2, "attempt": 2, "trace_id": "trace-123456"},
    )
    got = [(r["kind"], r["source"], r["target"]) for r in messages(s).orderBy("pos").collect()]
    assert got == [
        ("request", "entrypoint:web", "entrypoint:web"),
        ("request", "entrypoint:web", "lambda:f-1"),
        ("response", "entrypoint:web", "entrypoint:web"),
        ("response", "lambda:f-1", "entrypoint:web"),
    ]
    text = [r["text"] for r in sequence_text(s).orderBy("section", "pos", "sub", "line").collect()]
    assert text == [
        "sequenceDiagram",
        "    participant entrypoint_web as entrypoint:web",
        "    participant lambda_f_1 as lambda:f-1",
        "",
        "    entrypoint_web->>entrypoint_web: op",
        "",
        "    loop Retries (up to 2 attempts)",
        "    entrypoint_web->>lambda_f_1: op [attempt 2]",
        "    Note over entrypoint_web,lambda_f_1: trace:trace-123456",
        "",
        "    entrypoint_web-->>entrypoint_web: op response",
        "    Note over entrypoint_web,entrypoint_web: res=payloads/s0.response.json",
        "",
    ]


def test_text_without_times_groups_retries(make_spans):
    s = make_spans({"component": "a"}, {"component": "b", "parent_span_id": "s0"}, {"component": "b", "parent_span_id": "s0", "attempt": 2})
    text = [r["text"] for r in sequence_text(s).orderBy("section", "pos", "sub", "line").collect()]
    assert text[4:] == ["    a->>a: op", "", "    loop Retries (up to 2 attempts)", "    a->>b: op", "    a->>b: op [attempt 2]", "    end", ""]
    assert {r["component"]: r["is_retry"] for r in retry_groups(s).collect()} == {"a": False, "b": True}
    arrows = [(r["kind"], r["source"], r["target"]) for r in messages(s).orderBy("pos").collect()]
    assert arrows == [("span", "a", "a"), ("span", "b", "a"), ("span", "b", "a")]


def test_timeline(make_spans):
    s = make_spans({"ts_start": T1, "ts_end": T2}, {"ts_start": T0}, {"ts_start": None, "ts_end": None})
    got = {r["span_id"]: (r["row"], r["start_ms"], r["end_ms"], r["duration_ms"], r["range_ms"]) for r in timeline_positions(s).collect()}
    assert got == {"s1": (0, 0.0, 10.0, 10.0, 1000.0), "s2": (1, 0.0, 10.0, 10.0, 1000.0), "s0": (2, 250.0, 1000.0, 750.0, 1000.0)}
    flat = {r["span_id"]: (r["row"], r["start_ms"], r["end_ms"]) for r in timeline_positions(make_spans({}, {})).collect()}
    assert flat == {"s0": (0, 0.0, 100.0), "s1": (1, 100.0, 200.0)}


def test_throttle_signs(make_spans):
    s = make_spans({"error": '{"message": "Rate exceeded, timeout"}', "attempt": 4}, {"error": None}).withColumn(
        "status_code", F.when(F.col("span_id") == "s1", 429)
    )
    got = sorted((r["span_id"], r["throttle_type"]) for r in throttle_events(s).collect())
    assert got == [("s0", "rate_limit"), ("s0", "retry_storm"), ("s0", "timeout"), ("s1", "http_429")]


def test_suite(spark, make_spans):
    s = make_spans({"exec_id": "ok"}, {"exec_id": "warn", "attempt": 2}, {"exec_id": "bad", "error": '{"a": 1}'})
    cases = case_results(s)
    assert {r["exec_id"]: r["status"] for r in cases.collect()} == {"ok": "passed", "warn": "passed_with_warnings", "bad": "failed"}
    total = suite_summary(cases).first()
    assert (total["passed"], total["all_passed"]) == (1, False)
    ids = spark.createDataFrame([("sqs_entry_test",), ("sqs_one",), ("api-x",), ("dir/x",), ("plain",)], "id string")
    assert [r[0] for r in ids.select(group_name(F.col("id"))).collect()] == ["Sqs Entry", "Sqs", "Api", "Dir", "Default"]


def test_compare_two_executions(make_spans):
    sig = cmp.path_signatures(make_spans(
        {"exec_id": "1", "component": "a", "ts_start": T0, "ts_end": T1},
        {"exec_id": "2", "component": "a", "ts_start": T0, "ts_end": T1, "error": '{"message": "x"}'},
        {"exec_id": "3", "component": "z"},
    ))
    got = {r["example"]: (r["is_new"], r["is_missing"]) for r in cmp.compare_executions(sig, "1", "2").collect()}
    assert got == {"1": (False, True), "2": (True, False)}


def test_long_paths_are_whole_and_names_cannot_shift(make_spans):
    rows = [{"exec_id": e, "component": f"c{i % 7}", "operation": f"o{i}" if i < 999 else last, "ts_start": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z"}
            for e, last in (("1", "x"), ("2", "x"), ("3", "y")) for i in range(1000)]
    spans = make_spans(*[dict(r, span_id=f"{r['exec_id']}-{i}") for i, r in enumerate(rows)])
    sig = cmp.path_signatures(spans)
    keys = {r["exec_id"]: r["path_key"] for r in sig.collect()}
    assert keys["1"] == keys["2"] != keys["3"]
    texts = cmp.path_texts(spans, sig).collect()
    assert len(texts) == 2000 and {r["step"] for r in texts if r["pos"] == 1000} == {"c5:x", "c5:y"}
    odd = [{"exec_id": "1", "component": "x|y", "operation": "z"}, {"exec_id": "2", "component": "x", "operation": "y|z"}]
    assert len({r["path_key"] for r in cmp.path_signatures(make_spans(*odd)).collect()}) == 2


def test_ids_are_found_alike_in_short_and_long_lists(make_spans):
    spans = make_spans({"trace_id": "p"}, {"trace_id": "q"}, {"trace_id": None, "request_id": "p"}).withColumn("seq", F.lit(5).cast("long"))
    for more in ([], [f"n{i}" for i in range(600)]):
        got = logs.spans_by_id(spans, trace_ids=["p", *more], request_ids=["p"]).collect()
        assert sorted(r["span_id"] for r in got) == ["s0", "s2"]
        assert [r["span_id"] for r in logs.spans_by_id(spans, trace_ids=["p", *more]).collect()] == ["s0"]
