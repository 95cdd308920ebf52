"""Rules every execution must satisfy."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import truthy, with_times
from spanloom.operators.lookups import spans_without_parent


@dataclass(frozen=True)
class InvariantConfig:
    max_retry_count: int = 5
    required_components: list[str] = field(default_factory=list)
    check_orphans: bool = True
    check_timestamps: bool = True
    # Also demand that no span failed (what suites do).
    check_errors: bool = False

    def names(self) -> list[str]:
        names = ["has_spans", "no_duplicate_span_ids", "has_entrypoint"]
        if self.check_orphans:
            names.append("no_orphan_spans")
        if self.check_timestamps:
            names.append("valid_timestamps")
        names.append("max_retry_count")
        if self.required_components:
            names.append("required_components")
        if self.check_errors:
            names.append("no_error_spans")
        return names


def _ends_early() -> Column:
    return F.coalesce(F.col("end_at") < F.col("start_at"), F.lit(False))


def _retries_too_often(limit: int) -> Column:
    return F.coalesce(F.col("attempt") - 1 > limit, F.lit(False))


def invariant_facts(
    spans: DataFrame,
    config: InvariantConfig = InvariantConfig(),
    by: str = "exec_id",
    executions: DataFrame | None = None,
) -> DataFrame:
    """One row per execution with a violation count per rule.

    Each span is written twice, under its own id and under its parent's. Grouping
    by (execution, id) then shows ids used twice and parents that do not exist
    without a self-join, and hot parents shrink before the shuffle. `executions`
    may name executions that should exist; those without spans fail `has_spans`.
    """
    own = F.struct(
        F.col("span_id").alias("id"),
        F.lit(1).alias("defined"),
        F.lit(0).alias("used"),
        F.col("parent_span_id").isNull().cast("int").alias("root"),
        _ends_early().cast("int").alias("early"),
        _retries_too_often(config.max_retry_count).cast("int").alias("retries"),
        truthy("error").cast("int").alias("errors"),
        *[
            (F.col("component") == c).cast("int").alias(f"has_{i}")
            for i, c in enumerate(config.required_components)
        ],
    )
    zero = [F.lit(0).alias(n) for n in ("root", "early", "retries", "errors")]
    zero += [F.lit(0).alias(f"has_{i}") for i in range(len(config.required_components))]
    parent = F.struct(
        F.col("parent_span_id").alias("id"), F.lit(0).alias("defined"), F.lit(1).alias("used"), *zero
    )
    rows = with_times(spans).select(
        by,
        F.explode(
            F.when(F.col("parent_span_id").isNull(), F.array(own)).otherwise(F.array(own, parent))
        ).alias("r"),
    ).select(by, "r.*")
    summed = ["defined", "used", "root", "early", "retries", "errors"]
    has = [f"has_{i}" for i in range(len(config.required_components))]
    per_id = rows.groupBy(by, "id").agg(
        *[F.sum(c).alias(c) for c in summed], *[F.max(c).alias(c) for c in has]
    )
    facts = per_id.groupBy(by).agg(
        F.sum("defined").alias("span_count"),
        F.sum("root").alias("root_count"),
        F.sum(F.greatest(F.col("defined") - 1, F.lit(0))).alias("duplicates"),
        F.sum(F.when(F.col("defined") == 0, F.col("used")).otherwise(0)).alias("orphans"),
        F.sum("early").alias("early"),
        F.sum("retries").alias("retries"),
        F.sum("errors").alias("errors"),
        (
            F.lit(len(has)) - reduce(lambda a, b: a + b, [F.max(c) for c in has], F.lit(0))
        ).alias("missing"),
    )
    if executions is not None:
        facts = executions.select(by).distinct().join(facts, by, "left").fillna(0)
    return facts


def run_invariants(
    spans: DataFrame,
    config: InvariantConfig = InvariantConfig(),
    by: str = "exec_id",
    executions: DataFrame | None = None,
) -> DataFrame:
    """(execution, invariant, passed, violations), one row per rule."""
    facts = invariant_facts(spans, config, by, executions)
    none = F.lit(0)
    violations = {
        "has_spans": F.when(F.col("span_count") > 0, 0).otherwise(1),
        "no_duplicate_span_ids": F.col("duplicates"),
        "has_entrypoint": F.when(F.col("root_count") > 0, 0).otherwise(1),
        "no_orphan_spans": F.col("orphans"),
        "valid_timestamps": F.col("early"),
        "max_retry_count": F.col("retries"),
        "required_components": F.col("missing") if config.required_components else none,
        "no_error_spans": F.col("errors"),
    }
    checks = F.array(
        *[
            F.struct(F.lit(name).alias("invariant"), violations[name].cast("long").alias("violations"))
            for name in config.names()
        ]
    )
    return facts.select(by, F.explode(checks).alias("c")).select(
        by,
        "c.invariant",
        (F.col("c.violations") == 0).alias("passed"),
        "c.violations",
    )


def invariant_totals(results: DataFrame) -> DataFrame:
    """Passed and failed executions per rule."""
    return results.groupBy("invariant").agg(
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.sum("violations").alias("violations"),
    )


def invariant_violations(
    spans: DataFrame, config: InvariantConfig = InvariantConfig(), by: str = "exec_id"
) -> DataFrame:
    """The spans behind failed rules: (execution, invariant, span_id, detail)."""
    spans = with_times(spans)
    per_span = F.array_compact(
        F.array(
            F.when(
                _ends_early() & F.lit(config.check_timestamps),
                F.struct(
                    F.lit("valid_timestamps").alias("invariant"),
                    F.concat_ws(" > ", "ts_start", "ts_end").alias("detail"),
                ),
            ),
            F.when(
                _retries_too_often(config.max_retry_count),
                F.struct(
                    F.lit("max_retry_count").alias("invariant"),
                    F.concat(F.lit("retries "), F.col("attempt") - 1).alias("detail"),
                ),
            ),
            F.when(
                truthy("error") & F.lit(config.check_errors),
                F.struct(
                    F.lit("no_error_spans").alias("invariant"),
                    F.coalesce(F.get_json_object("error", "$.message"), "error").alias("detail"),
                ),
            ),
        )
    )
    found = spans.select(by, "span_id", F.explode(per_span).alias("v")).select(
        by, "v.invariant", "span_id", "v.detail"
    )
    repeated = (
        spans.groupBy(by, "span_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(
            by,
            F.lit("no_duplicate_span_ids").alias("invariant"),
            "span_id",
            F.concat(F.lit("written "), F.col("n"), F.lit(" times")).alias("detail"),
        )
    )
    out = found.unionByName(repeated)
    if config.check_orphans:
        lost = spans_without_parent(spans, by).select(
            by,
            F.lit("no_orphan_spans").alias("invariant"),
            "span_id",
            F.concat(F.lit("parent "), F.col("parent_span_id")).alias("detail"),
        )
        out = out.unionByName(lost)
    return out


def missing_components(spans: DataFrame, required: list[str], by: str = "exec_id") -> DataFrame:
    """(execution, component) for each required component that is absent."""
    names = F.array(*[F.lit(c) for c in required])
    present = spans.groupBy(by).agg(
        F.collect_set(F.when(F.col("component").isin(required), F.col("component"))).alias("present")
    )
    return present.select(by, F.explode(F.array_except(names, "present")).alias("component"))
