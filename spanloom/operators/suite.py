"""Suites: case results, totals, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import ratio, truthy
from spanloom.operators.invariants import InvariantConfig, run_invariants


def case_results(spans: DataFrame, by: str = "exec_id", config: InvariantConfig = InvariantConfig(check_errors=True)) -> DataFrame:
    """One row per case: status, sizes, duration, names of failed rules."""
    failed = (
        run_invariants(spans, config, by)
        .filter(~F.col("passed"))
        .groupBy(by)
        .agg(F.sort_array(F.collect_list("invariant")).alias("invariant_failures"))
    )
    facts = spans.groupBy(by).agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(truthy("error")).alias("error_count"),
        F.count_if(F.col("attempt") > 1).alias("retry_count"),
        F.coalesce(
            (F.unix_micros(F.max("end_at")) - F.unix_micros(F.min("start_at"))) / F.lit(1000.0), F.lit(0.0)
        ).alias("duration_ms"),
    )
    none = F.array().cast("array<string>")
    return (
        facts.join(failed, by, "left")
        .withColumn("invariant_failures", F.coalesce("invariant_failures", none))
        .withColumn(
            "status",
            F.when(F.size("invariant_failures") > 0, "failed")
            .when((F.col("retry_count") > 0) | (F.col("error_count") > 0), "passed_with_warnings")
            .otherwise("passed"),
        )
    )


def _count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def suite_summary(cases: DataFrame) -> DataFrame:
    """One row. The pass rate counts clean passes only; `all_passed` accepts warnings."""
    total = F.count(F.lit(1))
    good = F.count_if(F.col("status").isin("passed", "passed_with_warnings"))
    return cases.agg(
        total.alias("total_cases"),
        _count("passed").alias("passed"),
        _count("passed_with_warnings").alias("passed_with_warnings"),
        _count("failed").alias("failed"),
        _count("error").alias("errors"),
        _count("skipped").alias("skipped"),
        (ratio(_count("passed"), total) * 100).alias("pass_rate"),
        ((good == total) & (total > 0)).alias("all_passed"),
        F.coalesce(F.sum("span_count"), F.lit(0)).alias("total_spans"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"),
    )


def group_name(case_id: Column) -> Column:
    """Readable group out of the front of a case id: `a_b_c` gives `A B`, `a_b` and
    `a-b` and `a/b` give `A`, anything else `Default`."""
    parts = F.split(case_id, "_")
    name = (
        F.when(F.size(parts) > 2, F.concat_ws("_", parts[0], parts[1]))
        .when(F.size(parts) == 2, parts[0])
        .when(F.contains(case_id, F.lit("-")), F.split_part(case_id, F.lit("-"), F.lit(1)))
        .when(F.contains(case_id, F.lit("/")), F.split_part(case_id, F.lit("/"), F.lit(1)))
        .otherwise("default")
    )
    return F.initcap(F.translate(name, "_-", "  "))


def case_groups(cases: DataFrame, case_id: str) -> DataFrame:
    micros = F.sum(F.round(F.col("duration_ms") * 1000).cast("long"))
    total = F.count(F.lit(1))
    return cases.groupBy(group_name(F.col(case_id)).alias("name")).agg(
        total.alias("total"),
        _count("passed").alias("passed"),
        (micros / F.lit(1000.0)).alias("duration_ms"),
        (_count("passed") == total).alias("all_passed"),
        (F.count_if(F.col("status").isin("failed", "error")) > 0).alias("has_failures"),
    )


def filter_cases(cases: DataFrame, kind: str) -> DataFrame:
    """`failed` (errors included), `passed`, `warning`, `retries`, or all."""
    rule = {
        "failed": F.col("status").isin("failed", "error"),
        "passed": F.col("status") == "passed",
        "warning": F.col("status").isin("warning", "passed_with_warnings"),
        "retries": F.col("retry_count") > 0,
    }.get(kind)
    return cases if rule is None else cases.filter(rule)
