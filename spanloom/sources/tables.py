"""Span tables that a window or an id finds without reading the rest.

Spans are written by day, so a window reads the folders of its days. Within a file, rows
are sorted by trace, and each row group carries bounds and Bloom filters of the ids, so
a row group without any of the wanted ids is not read.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDS = ["trace_id", "request_id", "agent_session_id"]

#: Values of one id column that Spark tests in the file footers (its own default for
#: lists); longer lists are joined.
FOOTER_VALUES = 10


def write_span_table(spans: DataFrame, path: str, at: str = "logged_at", ids: list[str] = IDS, distinct: int = 100_000, group_bytes: int | None = None) -> None:
    """Spans as Parquet, a folder for each day of `at` (`day=none` without a time).

    `distinct` is how many values of an id a file is expected to hold at most; with more,
    filters let more row groups pass. A day is dealt over several files by trace.
    """
    day = F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("none"))
    spread = F.pmod(F.xxhash64(ids[0], "span_id"), F.lit(16))
    rows = spans.withColumn("day", day).withColumn("_spread", spread)
    rows = rows.repartition("day", "_spread").drop("_spread").sortWithinPartitions("day", *ids)
    writer = rows.write.mode("overwrite").partitionBy("day")
    for c in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    if group_bytes:
        writer = writer.option("parquet.block.size", str(group_bytes))
    writer.parquet(path)


def _days(start: datetime | None, end: datetime | None) -> Column:
    # Folders are compared as text, which sorts like days.
    day = F.col("day")
    found = F.lit(True)
    if start:
        found = found & (day >= start.strftime("%Y-%m-%d"))
    if end:
        found = found & (day <= end.strftime("%Y-%m-%d"))
    return found & (day != "none") if start or end else found


def read_span_table(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None, at: str = "logged_at") -> DataFrame:
    """Spans of a written table, with a time in [start, end] if bounds are given."""
    # Read as text: else `none` would make days of no type, or dates of text.
    spans = spark.read.option("basePath", path).schema(_with_day(spark, path)).parquet(path)
    if start or end:
        spans = spans.filter(_days(start, end))
        if start:
            spans = spans.filter(F.col(at) >= F.lit(start))
        if end:
            spans = spans.filter(F.col(at) <= F.lit(end))
    return spans.drop("day")


def _with_day(spark: SparkSession, path: str):
    from pyspark.sql.types import StringType, StructField, StructType

    schema = spark.read.parquet(path).schema
    return StructType([f for f in schema.fields if f.name != "day"] + [StructField("day", StringType())])


def find_spans(
    spark: SparkSession, path: str,
    trace_ids: list[str] | None = None, request_ids: list[str] | None = None, session_ids: list[str] | None = None,
    start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """Spans of a written table that carry any of the ids (session ids are agent session
    ids), by time. Lists of more than `FOOTER_VALUES` ids are joined instead."""
    spans = read_span_table(spark, path, start, end)
    wanted = {c: list(dict.fromkeys(v)) for c, v in zip(IDS, (trace_ids, request_ids, session_ids), strict=True) if v is not None}
    if any(len(v) > FOOTER_VALUES for v in wanted.values()):
        from spanloom.sources.logs import spans_by_id

        return spans_by_id(spans, *(wanted.get(c) for c in IDS))
    tests = [F.col(c) == v for c, values in wanted.items() for v in values]
    if wanted:
        spans = spans.filter(reduce(Column.__or__, tests, F.lit(False)))
    return spans.orderBy(F.col("start_at").asc_nulls_last(), "seq")
