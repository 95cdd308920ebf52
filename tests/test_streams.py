"""Streams give the same rows whatever files they come in."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.streaming import jobs, states

MINUTE = 60_000_000


def spans(rnd, n):
    """(span_id, exec_id, minute) over four hours, some executions with pauses."""
    out = []
    for i in range(n):
        key = f"x{rnd.randrange(12)}" if rnd.random() < 0.7 else "hot"
        out.append((f"s{i % (n - 9)}", key, rnd.choice([5, 40, 90, 200]) + rnd.random() * 12, rnd.random() < 0.1, rnd.choice([None, 1, 3])))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "span_id string, exec_id string, minute double, bad boolean, attempt int")
    at = F.timestamp_micros((F.col("minute") * MINUTE).cast("long") + F.lit(1_700_000_000_000_000))
    return df.select(
        "span_id", "exec_id", "attempt", at.alias("logged_at"), F.when(F.col("minute") < 95, at).alias("start_at"),
        (at + F.expr("INTERVAL 1 SECOND")).alias("end_at"), F.when(F.col("bad"), '{"message": "Rate exceeded"}').alias("error"),
    )


def read_as(spark, folder, df, files, per_batch):
    df.repartition(files).write.parquet(str(folder)) if files > 1 else df.coalesce(1).write.parquet(str(folder))
    return jobs.read_folder(spark, str(folder), df.schema, "*.parquet", per_batch)


def collected(df):
    return sorted(tuple(r) for r in df.drop("open").collect())


@pytest.fixture(scope="module")
def given(spark):
    return frame(spark, spans(random.Random(11), 600))


@pytest.mark.parametrize("files,per_batch", [(1, 1), (40, 15)])
def test_executions_are_all_rows_in_any_files(spark, tmp_path, given, files, per_batch):
    parts = jobs.run_available(jobs.execution_parts(read_as(spark, tmp_path / "in", given, files, per_batch)), "t")
    got = jobs.executions_of(parts)
    batch = given.groupBy(F.session_window("logged_at", "30 minutes").alias("w"), "exec_id").agg(
        F.count("*").alias("n"), F.count("error").alias("e"), F.count_if(F.col("attempt") > 1).alias("r"),
        F.min("start_at").alias("a"), F.max("end_at").alias("b"),
    )
    micros = F.coalesce((F.unix_micros("b") - F.unix_micros("a")) / F.lit(1000.0), F.lit(0.0))
    want = batch.select("exec_id", "w.start", "w.end", "n", "e", "r", jobs.execution_status(F.col("e"), F.col("r")), micros)
    assert collected(got) == sorted(tuple(r) for r in want.collect())
    assert got.agg(F.sum("span_count")).first()[0] == given.count()
    late = jobs.late_parts(parts).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    assert (late > 0) == (files > 1)
    if files == 1:
        end = given.agg(F.max("logged_at")).first()[0]
        assert {r["open"] for r in got.filter(F.col("window_end") <= F.lit(end) - F.expr("INTERVAL 10 MINUTES")).collect()} == {False}
        assert {r["open"] for r in got.filter(F.col("window_end") > F.lit(end)).collect()} == {True}


@pytest.mark.parametrize("files,per_batch", [(40, 15)])
def test_rates_are_all_rows_in_any_files(spark, tmp_path, given, files, per_batch):
    parts = jobs.run_available(jobs.rate_parts(read_as(spark, tmp_path / "in", given, files, per_batch), slide="30 minutes"), "t")
    batch = given.groupBy(F.window("logged_at", "1 hour", "30 minutes").alias("w")).agg(
        F.count("*").alias("n"), F.sum(jobs.throttle_signs(given.columns)).alias("s"), F.count_if(~jobs.truthy("error")).alias("p")
    )
    want = batch.select("w.start", "w.end", "n", "s", F.col("p") / F.col("n"))
    assert collected(jobs.rates_of(parts)) == sorted(tuple(r) for r in want.collect())


def test_every_row_is_first_repeat_or_late(spark, tmp_path, given):
    rows = given.select("span_id", "exec_id", "logged_at").unionByName(given.select("span_id", "exec_id", "logged_at").limit(50))
    rows = rows.withColumn("span_id", F.when(F.col("span_id") != "s7", F.col("span_id")))
    out = jobs.run_available(jobs.repeats_sorted_out(read_as(spark, tmp_path / "in", rows, 30, 10), lateness="20 minutes"), "t")
    assert sorted(map(str, out.drop("kind").collect())) == sorted(map(str, rows.collect()))
    per = out.groupBy("span_id").agg(F.count_if(F.col("kind") == "first").alias("firsts"), F.count_if(F.col("kind") == "late").alias("lates"))
    assert per.filter("firsts = 0 AND lates = 0").isEmpty()
    kinds = {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()}
    assert kinds["late"] > 0 and kinds["repeat"] > 0
    once = jobs.run_available(jobs.repeats_sorted_out(read_as(spark, tmp_path / "one", rows, 1, 1)), "t")
    kinds = {r["kind"]: r["count"] for r in once.groupBy("kind").count().collect()}
    ids = rows.select("span_id").distinct().count()
    assert kinds == {"first": ids, "repeat": rows.count() - ids}


def test_parts_meet_what_they_touch():
    parts = []
    for start, last in [(0, 10), (100, 110), (50, 60), (15, 95)]:
        parts = states.merged(parts, [start, last, [1], None, last], 5)
    assert parts == [[0, 10, [1], None, 10], [15, 95, [2], None, 95], [100, 110, [1], None, 110]]
    assert states.merged(parts, [14, 15, [1], 3, None], 5) == [[0, 95, [4], 3, 95], [100, 110, [1], None, 110]]


class Calls:
    """A bucket's state, with the calls it gets."""

    def __init__(self):
        self.kept, self.writes, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.kept

    def exists(self):
        return self.kept is not None

    def update(self, value):
        self.kept, self.writes = value, self.writes + 1

    def clear(self):
        self.kept = None

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.passed

    def getExpiryTimeInMs(self):
        return self.timers[-1]


def test_ids_of_a_bucket_are_one_state():
    calls = Calls()
    ids = states.SeenIds(100, ["span_id"])
    ids.init(calls)

    def kinds(passed, *rows):
        calls.passed = passed
        given = [Row(span_id=i, _at=at * 1000 if at is not None else None, _id=i, _again=False) for i, at in rows]
        return [r["kind"] for r in ids.handleInputRows((1,), iter(given), calls)]

    many = [(f"s{i}", 500 + i) for i in range(1000)]
    assert kinds(0, *many, (None, None), ("null", 7)) == ["first"] * 1002
    assert calls.writes == 1 and calls.timers == [100]
    assert kinds(600, ("s3", 700), ("s3", 3), ("null", 800), (None, 900), ("new", 450)) == ["repeat", "late", "repeat", "repeat", "late"]
    assert calls.writes == 1
    list(ids.handleExpiredTimer((1,), calls, calls))
    assert calls.timers == [100, 600]
    assert kinds(700, (None, 900), ("s0", 900), ("null", 800)) == ["first", "repeat", "first"]
    calls.passed = 10_000
    list(ids.handleExpiredTimer((1,), calls, calls))
    assert calls.kept is None


def test_rows_of_shared_buckets_come_out_once(spark, tmp_path, given, monkeypatch):
    monkeypatch.setattr(states, "BUCKETS", 3)
    rows = given.select("span_id", "logged_at").unionByName(given.select("span_id", "logged_at").limit(50))
    once = jobs.run_available(jobs.repeats_sorted_out(read_as(spark, tmp_path / "in", rows, 30, 10)), "t")
    kinds = {r["kind"]: r["count"] for r in once.groupBy("kind").count().collect()}
    ids = rows.select("span_id").distinct().count()
    assert kinds == {"first": ids, "repeat": rows.count() - ids}
