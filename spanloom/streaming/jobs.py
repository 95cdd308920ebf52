"""The same work on streams. Every function takes and returns a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.functions.redaction import RedactionConfig, redact_text
from spanloom.functions.values import present, truthy
from spanloom.operators.executions import execution_status
from spanloom.operators.normalise import parse_events
from spanloom.operators.soak import throttle_signs
from spanloom.session import scratch_path
from spanloom.sources.sinks import redact_spans
from spanloom.streaming.states import parts_of, sorted_out, whole

SESSION_GAP = "30 minutes"
LATENESS = "10 minutes"

# State of open executions and seen ids outgrows executor heaps at scale.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_folder(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """A stream over the Parquet parts of a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def normalise_stream(events: DataFrame, config: RedactionConfig = RedactionConfig()) -> DataFrame:
    """Log events (seq, timestamp, message) to redacted spans."""
    return redact_spans(parse_events(events), config)


def redact_stream(texts: DataFrame, column: str, config: RedactionConfig = RedactionConfig()) -> DataFrame:
    return texts.withColumn(column, redact_text(F.col(column), config))


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def duration_us(text: str) -> int:
    """`30 minutes` and the like in microseconds."""
    number, unit = text.split()
    return int(number) * _UNITS[unit.rstrip("s")] * 1_000_000


def _watermarked(spans: DataFrame, at: str, lateness: str) -> DataFrame:
    return spans.withWatermark(at, lateness)


def execution_parts(
    spans: DataFrame, by: str = "exec_id", at: str = "logged_at", gap: str = SESSION_GAP, lateness: str = LATENESS
) -> DataFrame:
    """Executions of a stream as parts that are open, closed (nothing came for `gap`) or
    late; `executions_of` puts the written table together. Rows without a time are left
    out."""
    timed = _watermarked(spans, at, lateness).filter(F.col(at).isNotNull())
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    rows = timed.select(
        F.col(by).cast("string").alias("key"),
        F.unix_micros(at).alias("start"),
        F.unix_micros(at).alias("last"),
        F.array(F.lit(1).cast("long"), one(present("error")), one(F.col("attempt") > 1)).alias("sums"),
        F.unix_micros("start_at").alias("low"),
        F.unix_micros("end_at").alias("high"),
    )
    return parts_of(rows, duration_us(gap))


def executions_of(parts: DataFrame, by: str = "exec_id", gap: str = SESSION_GAP) -> DataFrame:
    """One row per execution out of `execution_parts`, those still open included (`open`)
    and late rows counted in."""
    reach = duration_us(gap)
    n = F.col("sums")
    return whole(parts, reach).select(
        F.col("key").alias(by),
        F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros(F.col("last") + reach).alias("window_end"),
        n[0].alias("span_count"),
        n[1].alias("error_count"),
        n[2].alias("retry_count"),
        execution_status(n[1], n[2]).alias("status"),
        F.coalesce((F.col("high") - F.col("low")) / F.lit(1000.0), F.lit(0.0)).alias("duration_ms"),
        "open",
    )


def rate_parts(
    spans: DataFrame, at: str = "logged_at", width: str = "1 hour", slide: str | None = None, lateness: str = LATENESS
) -> DataFrame:
    """Spans, throttle signs and spans without error per time window, as parts that are
    open, closed or late; `rates_of` puts the written table together."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    facts = _watermarked(spans, at, lateness).select(
        F.timestamp_micros(F.unix_micros(at)).alias("at"), throttle_signs(spans.columns).alias("signs"), (~truthy("error")).alias("passed")
    )
    rows = facts.filter("at IS NOT NULL").select(window.alias("w"), "signs", "passed").select(
        F.unix_micros("w.start").cast("string").alias("key"),
        F.unix_micros("w.start").alias("start"),
        F.unix_micros("w.end").alias("last"),
        F.array(F.lit(1).cast("long"), one(F.col("signs")), one(F.col("passed"))).alias("sums"),
        F.lit(None).cast("long").alias("low"),
        F.lit(None).cast("long").alias("high"),
    )
    return parts_of(rows, 0)


def rates_of(parts: DataFrame) -> DataFrame:
    """One row per window out of `rate_parts`, those still open included (`open`)."""
    n = F.col("sums")
    return whole(parts, 0).select(
        F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros("last").alias("window_end"),
        n[0].alias("spans"),
        n[1].alias("throttle_events"),
        (n[2] / n[0]).alias("pass_rate"),
        "open",
    )


def late_parts(parts: DataFrame) -> DataFrame:
    """(key, start, last, rows): what came after its time had been closed."""
    return parts.filter("kind = 'late'").select(
        "key", F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), F.col("sums")[0].alias("rows")
    )


def without_repeats(spans: DataFrame, at: str = "logged_at", lateness: str = "1 day") -> DataFrame:
    """Spans whose id was not seen within `lateness` before."""
    return _watermarked(spans, at, lateness).dropDuplicatesWithinWatermark(["span_id"])


def repeats_sorted_out(spans: DataFrame, at: str = "logged_at", lateness: str = "1 day") -> DataFrame:
    """All spans with `kind`: the `first` of its id within `lateness`, a `repeat` of
    one, or `late`."""
    return sorted_out(_watermarked(spans, at, lateness), "span_id", at, duration_us(lateness) // 1000)


def run_available(
    stream: DataFrame, name: str, partition_by: list[str] | None = None, folder: str | None = None
) -> DataFrame:
    """Process what is there, through a Parquet sink, and return the written table.

    Table and progress live in `folder`: a rerun with the same folder resumes and reads
    only what is new. Without one, each run begins anew in the shared folder.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    root = folder.rstrip("/") if folder else scratch_path(spark, f"stream-{name}")
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/table")
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")
