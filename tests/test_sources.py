import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.operators.agent_trace import agent_spans, classify_events
from spanloom.sources import logs, sinks


def test_lenient_scan(spark, lines):
    path = lines({"message": "m", "timestamp": "t"}, "", {"other": 1}, "plain")
    got = logs.scan_log_lines(logs.read_lines(spark, path)).orderBy("seq").collect()
    assert [(r["message"], r["timestamp"]) for r in got] == [("m", "t"), ('{"other": 1}', ""), ("plain", "")]


def test_canonical_spans(spark, lines):
    good = {"span_id": "a", "component": "c", "operation": "o", "lambda_request_id": "r", "request": {"k": 1}}
    (r,) = logs.read_spans(spark, lines(good), strict=True).collect()
    assert (r["span_id"], r["request_id"], json.loads(r["request"])) == ("a", "r", {"k": 1})
    with pytest.raises(Exception, match="without a required field"):
        logs.read_spans(spark, lines({"span_id": "a"})).select("span_id").collect()
    with pytest.raises(Exception, match="unknown span field"):
        logs.read_spans(spark, lines({**good, "odd": 1}), strict=True).select("span_id").collect()


def test_varied_spans_and_counters(spark, lines):
    path = lines({"op": "x", "service": "s"}, "START RequestId", "junk", {"level": "DEBUG"})
    assert [r["component"] for r in logs.read_varied_spans(spark, path).collect()] == ["s"]
    c = logs.varied_counters(logs.read_lines(spark, path)).first()
    assert (c["total"], c["json_errors"], c["unexpected"], c["skipped"], c["spans"]) == (4, 2, 1, 1, 1)


def test_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [{"a": 1},\n 2, {"b": 2}]')
    (tmp_path / "b.jsonl").write_text('{"c": 3}\nnope\n')
    got = [json.loads(r["json"]) for r in logs.scan_json_records(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [{"c": 3}, {"a": 1}, {"b": 2}]


def test_large_arrays_keep_their_numbers_apart(spark, tmp_path):
    n = (1 << 20) + 5
    (tmp_path / "a.json").write_text("[" + ",".join(['{"a":1}'] * n) + "]")
    (tmp_path / "b.json").write_text("[" + ",".join(['{"b":1}'] * 9) + "]")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = logs.scan_json_records(spark, str(tmp_path)).groupBy(F.col("json").contains("b").alias("b"))
        got = got.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("ids"), F.min("seq").alias("first"), F.max("seq").alias("last"))
        a, b = got.orderBy("b").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert (a["n"], a["ids"], b["n"], b["ids"]) == (n, n, 9, 9)
    assert a["last"] < b["first"]


def test_agent_trace_file(spark, lines):
    def event(t, **orch):
        return {"sessionId": "s", "traceId": "t", "eventTime": t, "trace": {"orchestrationTrace": orch}}

    path = lines(
        event("2024-01-01T00:00:00Z", modelInvocationInput={"text": "q"}),
        event("2024-01-01T00:00:01Z", modelInvocationOutput={"parsedResponse": {"x": 1}}),
        event("2024-01-01T00:00:02Z", rationale={"text": "why"}),
        event("2024-01-01T00:00:03Z", invocationInput={"invocationType": "ACTION_GROUP", "actionGroupInvocationInput": {"actionGroupName": "g", "verb": "GET"}}),
        event("2024-01-01T00:00:04Z", observation={"type": "ACTION_GROUP", "actionGroupInvocationOutput": {"text": "done"}}),
    )
    got = agent_spans(classify_events(logs.read_agent_trace(spark, path))).orderBy("seq", "span_id").collect()
    assert {r["span_id"]: r["component"] for r in got} == {
        "bedrock-orchestrator-000": "agent:bedrock-orchestrator",
        "bedrock-model-001": "agent:bedrock-model",
        "bedrock-rationale-002": "agent:bedrock-rationale",
        "bedrock-action-003": "lambda:g",
    }
    action = next(r for r in got if r["span_id"] == "bedrock-action-003")
    assert json.loads(action["request"])["verb"] == "GET" and json.loads(action["response"]) == {"text": "done"}


def test_windows():
    now = datetime(2024, 1, 2)
    assert logs.parse_since("30M") == timedelta(minutes=30)
    assert logs.relative_window(now, "7d", "24h") == (datetime(2023, 12, 26), datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        logs.parse_since("soon")


def test_window_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("logged_at")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    df = logs.window_scan([t], datetime(1970, 1, 1, 0, 0, 2), datetime(1970, 1, 1, 0, 0, 5), limit=3)
    assert [r["seq"] for r in df.collect()] == [2, 3, 4]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(logged_at" in plan and "TakeOrderedAndProject" in plan


def test_id_lists_and_search(make_spans):
    s = make_spans({"trace_id": "a"}, {"request_id": "b"}, {"agent_session_id": "c"}, {"trace_id": "d", "operation": "Checkout"})
    got = {r["span_id"] for r in logs.spans_by_id(s, ["a"], ["b"], ["zzz"]).collect()}
    assert got == {"s0", "s1"}
    many = [f"n{i}" for i in range(600)] + ["d"]
    assert {r["span_id"] for r in logs.spans_by_id(s, trace_ids=many).collect()} == {"s3"}
    assert {r["span_id"] for r in logs.search_spans(s, "check").collect()} == {"s3"}
    assert {r["span_id"] for r in logs.search_spans(s, "chekout", fuzzy=1).collect()} == {"s3"}


def test_sinks_redact_and_split(spark, make_spans, tmp_path):
    s = make_spans(
        {"trace_id": "t1", "request": '{"mail": "a@b.com", "password": "x"}'}, {"trace_id": "t2", "error": '{"message": "m"}'}
    )
    sinks.write_spans(s, str(tmp_path / "spans"), per="trace_id")
    back = {r["span_id"]: r for r in spark.read.json(str(tmp_path / "spans")).collect()}
    assert json.loads(back["s0"]["request"]) == {"mail": "[EMAIL_REDACTED]", "password": "[REDACTED]"}
    assert back["s1"]["trace_id"] == "t2"
    sinks.write_payloads(s, str(tmp_path / "payloads"))
    assert spark.read.json(str(tmp_path / "payloads")).count() == 2


def test_a_stream_resumes_in_its_folder(spark, tmp_path):
    from spanloom.streaming import jobs

    source, home = tmp_path / "in", str(tmp_path / "home")
    rows = lambda *ids: spark.createDataFrame([(i, f"mail a{i}@b.org") for i in ids], "id long, text string")
    run = lambda: jobs.run_available(jobs.redact_stream(jobs.read_folder(spark, str(source), rows(1).schema), "text"), "t", folder=home)
    rows(1, 2).write.parquet(str(source))
    assert sorted(r["id"] for r in run().collect()) == [1, 2]
    rows(3).write.mode("append").parquet(str(source))
    got = run().collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3] and "@" not in got[0]["text"]
    assert sorted(r["id"] for r in run().collect()) == [1, 2, 3]
