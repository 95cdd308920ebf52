"""Soak runs: throttling, iterations, summary, rate changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import ratio, truthy
from spanloom.operators.ordering import rank_within

# Error texts that mean throttling, first match decides the type.
THROTTLE_TEXTS = [
    ("throttlingexception", "aws_throttle"),
    ("provisionedthroughputexceeded", "aws_throttle"),
    ("rate exceeded", "rate_limit"),
    ("too many requests", "rate_limit"),
    ("request limit exceeded", "rate_limit"),
]
RETRY_STORM = 3
PASS_RATE = 0.9


def _signs(columns: list[str]) -> Column:
    """Throttle signs of a span as an array of (throttle_type, details)."""

    def given(name: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(name), otherwise) if name in columns else otherwise

    text = F.when(truthy("error"), F.col("error")).otherwise("")
    low = F.lower(text)
    retries = given("retry_count", F.coalesce(F.col("attempt") - 1, F.lit(0)))
    matched = F.coalesce(*[F.when(F.contains(low, F.lit(w)), kind) for w, kind in THROTTLE_TEXTS])
    limited = given("status_code", F.lit(0)) == 429

    def sign(kind: Column, details: Column) -> Column:
        return F.struct(kind.alias("throttle_type"), details.alias("details"))

    return F.when(
        limited,
        F.array(sign(F.lit("http_429"), F.concat(F.lit("HTTP 429 from "), given("target", F.lit("unknown"))))),
    ).otherwise(
        F.array_compact(
            F.array(
                F.when(matched.isNotNull(), sign(matched, text)),
                F.when(
                    retries >= RETRY_STORM,
                    sign(F.lit("retry_storm"), F.concat(F.lit("High retry count: "), retries)),
                ),
                F.when(
                    given("timed_out", F.lit(False)) | F.contains(low, F.lit("timeout")),
                    sign(F.lit("timeout"), F.lit("Request timeout")),
                ),
            )
        )
    )


def throttle_events(spans: DataFrame) -> DataFrame:
    """Rows of `spans` with (throttle_type, details), several per span if several
    signs show; status 429 hides the others.

    Optional columns: status_code, target, retry_count (else attempt - 1), timed_out.
    """
    return spans.select("*", F.explode(_signs(spans.columns)).alias("_s")).select(*spans.columns, "_s.*")


def throttles_by_type(throttles: DataFrame) -> DataFrame:
    return throttles.groupBy("throttle_type").agg(F.count(F.lit(1)).alias("events"))


def live_status(errors: Column, retries: Column) -> Column:
    return (
        F.when((errors > 0) & (retries > 0), "warning")
        .when(errors > 0, "failed")
        .when(retries > 0, "warning")
        .otherwise("passed")
    )


def throttle_signs(columns: list[str]) -> Column:
    """Number of throttle signs of a span with these columns."""
    return F.size(_signs(columns))


def soak_iterations(spans: DataFrame, by: str = "iteration") -> DataFrame:
    """One row per iteration of a run: size, errors, retries, duration, status, throttles.

    Throttle signs are counted in the same aggregation as everything else.
    """
    retries = F.coalesce(F.col("attempt"), F.lit(1)) - 1
    facts = spans.groupBy(by).agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(truthy("error")).alias("error_count"),
        F.sum(retries).alias("retry_count"),
        F.sum(throttle_signs(spans.columns)).alias("throttle_events"),
        ((F.unix_micros(F.max("end_at")) - F.unix_micros(F.min("start_at"))) / F.lit(1000.0)).alias("duration_ms"),
    )
    status = live_status(F.col("error_count"), F.col("retry_count"))
    return facts.withColumn("status", status).select(
        by, "span_count", "error_count", "retry_count",
        F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
        "status",
        F.col("status").isin("passed", "warning").alias("passed"),
        ((F.col("retry_count") == 0) & (F.col("error_count") == 0)).alias("is_clean_pass"),
        "throttle_events",
    )


def soak_summary(iterations: DataFrame) -> DataFrame:
    """One row over the iterations of a run."""
    total, passed = F.count(F.lit(1)), F.count_if("passed")
    clean = F.count_if(F.col("passed") & F.col("is_clean_pass"))
    warned = F.count_if(F.col("status") == "warning")
    throttled = F.count_if(F.col("throttle_events") > 0)
    micros = F.sum(F.round(F.col("duration_ms") * 1000).cast("long"))
    return iterations.agg(
        total.alias("total_iterations"),
        passed.alias("total_passed"),
        clean.alias("total_clean_passes"),
        warned.alias("total_warnings"),
        F.count_if(~F.col("passed")).alias("total_failures"),
        ratio(passed, total).alias("pass_rate"),
        ratio(clean, passed).alias("consistency_score"),
        ratio(warned, passed).alias("warning_rate"),
        ratio(micros / F.lit(1000.0), total).alias("avg_iteration_ms"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).alias("total_retries"),
        ratio(F.sum("retry_count"), total).alias("avg_retries_per_iteration"),
        F.coalesce(F.max("retry_count"), F.lit(0)).alias("max_retries"),
        F.coalesce(F.sum("throttle_events"), F.lit(0)).alias("total_throttle_events"),
        ratio(throttled, total).alias("throttle_rate"),
        (ratio(passed, total) >= PASS_RATE).alias("accepted"),
    )


def rate_statistics(changes: DataFrame, min_rate: float, max_rate: float) -> DataFrame:
    """One row over recorded rate changes (at, old_rate, new_rate, reason)."""
    return changes.agg(
        F.count(F.lit(1)).alias("total_adjustments"),
        F.count_if(F.col("reason") == "throttle").alias("throttle_decreases"),
        F.count_if(F.col("reason") == "stability").alias("stability_increases"),
        F.max_by("new_rate", "at").alias("current_rate"),
    ).select(
        "*",
        (F.col("current_rate") <= min_rate).alias("min_rate_hit"),
        (F.col("current_rate") >= max_rate).alias("max_rate_hit"),
    )


def observed_rate_changes(iterations: DataFrame, rate: Column, run: str = "run", at: str = "iteration") -> DataFrame:
    """(run, at, old_rate, new_rate, reason) between iterations of a run that follow
    each other: `throttle` if the later one was throttled, else `stability`."""
    rated = iterations.withColumn("new_rate", rate).select(run, at, "new_rate", "throttle_events")
    ranked = rank_within(rated, [run], [F.col(at)], previous=["new_rate"])
    return ranked.filter(F.col("prev.new_rate") != F.col("new_rate")).select(
        run,
        F.col(at).alias("at"),
        F.col("prev.new_rate").alias("old_rate"),
        "new_rate",
        F.when(F.col("throttle_events") > 0, "throttle").otherwise("stability").alias("reason"),
    )
