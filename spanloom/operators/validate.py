"""Checking span lines against the span rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required fields, and fields by type.
REQUIRED = ["span_id", "component", "operation"]
TEXT_FIELDS = ["span_id", "component", "operation"]
OPTIONAL_TEXT_FIELDS = [
    "parent_span_id", "ts_start", "ts_end", "trace_id", "lambda_request_id", "xray_trace_id",
    "sqs_message_id", "bedrock_session_id", "thread_id", "session_id",
]
OBJECT_FIELDS = ["request", "response", "error"]


def _issue(path: str, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(path).alias("path"), text.alias("message"))


def validate_lines(lines: DataFrame) -> DataFrame:
    """(seq, path, message): one row per broken rule of each line (seq, line)."""
    v = F.try_parse_json("line")
    base = lines.select("seq", v.alias("v"))

    def kind(path: str) -> Column:
        # VOID is a JSON null, SQL null an absent field.
        return F.split(F.schema_of_variant(F.try_variant_get("v", path, "variant")), r"[<(]")[0]

    is_object = kind("$") == "OBJECT"
    rules = [F.when(F.col("v").isNull(), _issue("$", "not valid JSON"))]
    rules.append(F.when(F.col("v").isNotNull() & ~is_object, _issue("$", "not an object")))
    for name in REQUIRED:
        rules.append(F.when(is_object & kind(f"$.{name}").isNull(), _issue("$", f"'{name}' is required")))
    for name in TEXT_FIELDS:
        rules.append(F.when(is_object & (kind(f"$.{name}") != "STRING"), _issue(f"$.{name}", "not a string")))
    for name in OPTIONAL_TEXT_FIELDS:
        rules.append(
            F.when(is_object & ~kind(f"$.{name}").isin("STRING", "VOID"), _issue(f"$.{name}", "not a string or null"))
        )
    for name in OBJECT_FIELDS:
        rules.append(
            F.when(is_object & ~kind(f"$.{name}").isin("OBJECT", "VOID"), _issue(f"$.{name}", "not an object or null"))
        )
    attempt = F.try_variant_get("v", "$.attempt", "double")
    whole = attempt == F.floor(attempt)
    number = kind("$.attempt").isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    rules.append(
        F.when(
            is_object & ~kind("$.attempt").isin("VOID") & ~(number & F.coalesce(whole, F.lit(False))),
            _issue("$.attempt", "not an integer or null"),
        )
    )
    rules.append(F.when(is_object & number & (attempt < 1), _issue("$.attempt", "less than 1")))
    error_kind = kind("$.error")
    for name, want in (("code", "STRING"), ("message", "STRING"), ("retryable", "BOOLEAN")):
        wrong = (error_kind == "OBJECT") & (kind(f"$.error.{name}") != want)
        rules.append(F.when(is_object & wrong, _issue(f"$.error.{name}", f"not a {want.lower()}")))
    return base.select("seq", F.explode(F.array_compact(F.array(*rules))).alias("e")).select(
        "seq", "e.path", "e.message"
    )


def validation_counts(lines: DataFrame) -> DataFrame:
    """One row: valid and invalid lines."""
    broken = validate_lines(lines).select("seq").distinct()
    marked = lines.select("seq").join(broken.withColumn("_bad", F.lit(True)), "seq", "left")
    return marked.agg(
        F.count_if(F.col("_bad").isNull()).alias("valid"),
        F.count_if(F.col("_bad").isNotNull()).alias("invalid"),
    )
