"""Places of lines and array elements do not depend on how files are cut."""

import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from spanloom.operators import profile as pf
from spanloom.operators.chains import chain_entries, chain_spans, with_payload
from spanloom.sources import arrays, logs, positions


@contextmanager
def blocks_of(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def write_lines(folder, rnd, files=3):
    want = []
    for f in range(files):
        rows = [rnd.choice(["", " ", f"row {f} {i} " + "x" * rnd.randint(0, 40)]) for i in range(rnd.randint(0, 300))]
        (folder / f"{f}.log").write_text("".join(r + "\n" for r in rows))
        want += [(f"{f}.log", i + 1, r) for i, r in enumerate(rows)]
    return [(seq, f, n, r.strip()) for seq, (f, n, r) in enumerate(want) if r.strip()]


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_lines_are_numbered_alike_in_any_blocks(spark, tmp_path, size, monkeypatch):
    want = write_lines(tmp_path, random.Random(1))
    with blocks_of(spark, size):
        got = logs.read_lines(spark, str(tmp_path)).select("seq", F.regexp_extract("file", r"[^/]+$", 0), "number", "line").collect()
        assert sorted(tuple(r) for r in got) == want
        monkeypatch.setattr(positions, "SENT_BLOCKS", 0)
        assert logs.read_lines(spark, str(tmp_path)).count() == len(want)


def test_changed_blocks_are_noticed(spark, tmp_path):
    write_lines(tmp_path, random.Random(2))
    with blocks_of(spark, 1000):
        lines = positions.numbered_lines(spark, str(tmp_path))
    with blocks_of(spark, 100), pytest.raises(Exception, match="other blocks"):
        lines.select("seq").collect()


def test_chains_are_the_same_in_one_block_and_in_many(spark, tmp_path):
    rnd = random.Random(4)
    rows = [
        {"timestamp": f"2024-01-01T00:00:{i % 60:02d}Z", "level": "INFO", "appname": f"app-{i % 3}",
         "message": f"request_id=req-{rnd.randrange(12):08d} session_id=sess-{rnd.randrange(9)}-1"}
        for i in range(80)
    ]
    (tmp_path / "a.log").write_text("".join(json.dumps(r) + "\n" for r in rows))
    found = []
    for size in (1 << 20, len((tmp_path / "a.log").read_text()) // 40):
        with blocks_of(spark, size):
            lines = logs.read_lines(spark, str(tmp_path))
            entries = pf.log_entries(logs.scan_log_lines(lines).select("seq", "json"))
            found.append(sorted(map(str, chain_spans(with_payload(chain_entries(entries), entries)).collect())))
    assert found[0] == found[1] and found[0]


def elements(rnd, n):
    def value(depth):
        kind = rnd.randrange(7 if depth < 4 else 4)
        if kind == 0:
            return rnd.randrange(1000)
        if kind in (1, 2, 3):
            return "".join(rnd.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "a", "b", "\n"]) for _ in range(rnd.randrange(12)))
        if kind == 4:
            return [value(depth + 1) for _ in range(rnd.randrange(4))]
        return {f"k{i},{i}": value(depth + 1) for i in range(rnd.randrange(4))}

    return [value(0) for _ in range(n)]


@pytest.mark.parametrize("size", [37, 500, 1 << 20])
def test_array_elements_in_any_blocks(spark, tmp_path, size):
    rnd = random.Random(size)
    want, seq = [], 0
    for f, (n, indent) in enumerate([(300, None), (0, None), (1, 2), (120, 1), (1, None)]):
        items = elements(rnd, n)
        (tmp_path / f"{f}.json").write_text("\n " + json.dumps(items, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
        want += [(seq + i, i, x) for i, x in enumerate(items)]
        seq += n
    (tmp_path / "9.json").write_text("[ \n ]")
    with blocks_of(spark, size):
        got = arrays.array_elements(spark, str(tmp_path)).select("seq", "number", "json").orderBy("seq").collect()
    assert [(r["seq"], r["number"], json.loads(r["json"])) for r in got] == want


def test_array_blocks_are_joined_by_keys_beyond_the_limit(spark, tmp_path, monkeypatch):
    items = elements(random.Random(5), 200)
    (tmp_path / "a.json").write_text(json.dumps(items))
    monkeypatch.setattr(arrays, "SENT_BLOCKS", 0)
    with blocks_of(spark, 200):
        got = arrays.array_elements(spark, str(tmp_path)).orderBy("seq").collect()
    assert [json.loads(r["json"]) for r in got] == items


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path):
    n = 200_000
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"a":{i},"b":[1,2]}}' for i in range(n)) + "]")
    with blocks_of(spark, 1 << 18):
        got = arrays.array_elements(spark, str(tmp_path))
        checked = got.select("seq", F.get_json_object("json", "$.a").cast("long").alias("a"), F.spark_partition_id().alias("p"))
        r = checked.agg(F.count("*").alias("n"), F.count_if(F.col("seq") != F.col("a")).alias("bad"), F.count_distinct("p").alias("tasks")).first()
    assert (r["n"], r["bad"]) == (n, 0) and r["tasks"] > 8
