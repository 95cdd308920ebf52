"""What a plan or a written folder must not grow with."""

from pyspark.sql import functions as F

from spanloom.operators import normalise as nm
from spanloom.operators import profile as pf
from spanloom.operators.chains import chain_entries, with_payload
from spanloom.sources import bundles, logs
from spanloom.sources.driver_tables import spread


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _records(spark, n):
    rows = [(i, f'{{"message": "session_id=sess-{i // 2}-long", "timestamp": "2024-01-01T00:00:00Z", "appname": "app{i % 2}"}}') for i in range(n)]
    return spark.createDataFrame(rows, "seq long, line string")


def test_each_pattern_is_looked_for_once(spark):
    entries = pf.log_entries(logs.scan_log_lines(_records(spark, 2)).select("seq", "json"))
    assert _plan(entries.groupBy("component").count()).count("orchestrationTrace") <= 2  # pattern and its guard are no copies
    assert entries.filter("component IS NOT NULL").count() == 2


def test_a_filter_on_ids_does_not_look_fields_up_again(spark):
    events = spark.createDataFrame([(0, "t", '{"component": "a", "operation": "b", "timestamp": "t"}'), (1, "t", '{"component": "a", "span_id": "x"}')], "seq long, timestamp string, message string")
    found = nm.parse_events(events).filter(F.startswith("span_id", F.lit("auto-"))).select("seq", "span_id")
    assert [r["seq"] for r in found.collect()] == [0]
    assert _plan(found).count("eventId") <= 1


def test_chains_share_a_bounded_number_of_folders(spark, tmp_path):
    lines = _records(spark, 120)
    entries = pf.log_entries(logs.scan_log_lines(lines).select("seq", "json"))
    path = str(tmp_path / "chains")
    version = bundles.write_chains(with_payload(chain_entries(entries), entries), lines, path)
    assert bundles.manifest(spark, path)["facts"]["chains"] == 60
    for name in ("lines", "spans", "chains"):
        assert len(list((tmp_path / "chains" / version / name).glob("folder=*"))) <= bundles.CHAIN_FOLDERS
    assert sorted(r["seq"] for r in bundles.read_chain(spark, path, "lines", "chain-8").collect()) == [8, 9]


def test_a_table_of_one_piece_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    given = spark.read.parquet(path)
    out = spread(given)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > given.rdd.getNumPartitions()
    assert out.count() == 1000
