"""Small column helpers: truth of JSON text, times, durations, labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON texts that count as "nothing" although the field is present.
FALSY_JSON = ["", '""', "{}", "[]", "null", "0", "0.0", "false"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: str | Column) -> Column:
    """The field is there (possibly empty)."""
    return col(c).isNotNull()


def truthy(c: str | Column) -> Column:
    """The field is there and not empty; never null."""
    return F.coalesce(~F.trim(col(c)).isin(FALSY_JSON), F.lit(False))


def first_truthy(*cs: str | Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(truthy(c), col(c)) for c in cs])


def contains_any(c: str | Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(c), F.lit(w)) for w in words])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, where the value is computed once for all places that `use` has for it.
    Spark computes a costly expression anew wherever it is written below a condition."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_time(c: str | Column) -> Column:
    """ISO text to TIMESTAMP; zone-less text is UTC, unreadable text is null. A text
    that does not begin with a whole date (a time of day, a year) is unreadable."""
    text = F.trim(col(c))
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text))


def with_times(spans: DataFrame) -> DataFrame:
    """Add `start_at` / `end_at` parsed from the text columns, if absent."""
    if "start_at" not in spans.columns:
        spans = spans.withColumn("start_at", parse_time("ts_start"))
    if "end_at" not in spans.columns:
        spans = spans.withColumn("end_at", parse_time("ts_end"))
    return spans


def unreadable_time() -> Column:
    """A time was written but could not be read."""
    return F.coalesce(
        (F.nullif(F.col("ts_start"), F.lit("")).isNotNull() & F.col("start_at").isNull())
        | (F.nullif(F.col("ts_end"), F.lit("")).isNotNull() & F.col("end_at").isNull()),
        F.lit(False),
    )


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c))


def millis_between(start: str | Column, end: str | Column) -> Column:
    """Exact difference in milliseconds (null if either side is null)."""
    return (micros(end) - micros(start)) / F.lit(1000.0)


def component_type(c: str | Column = "component") -> Column:
    return F.lower(F.split_part(col(c), F.lit(":"), F.lit(1)))


def participant_key(c: str | Column = "component") -> Column:
    return F.translate(col(c), ":-/.", "____")


def safe_id(c: str | Column) -> Column:
    safe = F.regexp_replace(col(c), "[^a-zA-Z0-9]", "_")
    safe = F.when(safe.rlike("^[0-9]"), F.concat(F.lit("id_"), safe)).otherwise(safe)
    return F.when(safe == "", F.lit("unknown")).otherwise(safe)


def duration_label(ms: str | Column) -> Column:
    """`250ms`, `1.5s`, `2m 5s`."""
    ms = col(ms)
    return (
        F.when(ms < 1000, F.format_string("%.0fms", ms))
        .when(ms < 60000, F.format_string("%.1fs", ms / 1000))
        .otherwise(
            F.format_string(
                "%dm %.0fs",
                F.floor(ms / 60000),
                (ms - F.floor(ms / 60000) * F.lit(60000)) / 1000,
            )
        )
    )


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as DOUBLE, 0 where bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))
