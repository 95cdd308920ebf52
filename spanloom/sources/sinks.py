"""Writing results: spans, payloads, per-execution folders, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.redaction import RedactionConfig, redact_json, redact_text
from spanloom.schema import SPAN_COLUMNS, SPAN_FILE_NAMES

_PAYLOADS = ["request", "response", "error"]
_TEXTS = ["operation"]


def redact_spans(spans: DataFrame, config: RedactionConfig = RedactionConfig()) -> DataFrame:
    """Redact payloads and free text of spans."""
    out = spans
    for c in _PAYLOADS:
        if c in spans.columns:
            out = out.withColumn(c, redact_json(F.col(c), config))
    for c in _TEXTS:
        if c in spans.columns:
            out = out.withColumn(c, redact_text(F.col(c), config))
    return out


def write_spans(
    spans: DataFrame, path: str, config: RedactionConfig = RedactionConfig(), per: str | None = None
) -> None:
    """Redacted spans as JSON lines under their file names, one folder per value of
    `per` if given."""
    renamed = redact_spans(spans, config).select(
        *([per] if per and per not in SPAN_COLUMNS else []),
        *[F.col(c).alias(SPAN_FILE_NAMES.get(c, c)) for c in SPAN_COLUMNS if c in spans.columns],
    )
    if per is None:
        renamed.write.mode("overwrite").json(path)
        return
    folder = SPAN_FILE_NAMES.get(per, per)
    # Rows of one folder go to few tasks, but a hot folder is not forced into one.
    parts = renamed.withColumn("_spread", F.pmod(F.xxhash64("span_id"), F.lit(16)))
    parts.repartition(folder, "_spread").drop("_spread").write.mode("overwrite").partitionBy(folder).json(path)


def payload_rows(spans: DataFrame) -> DataFrame:
    """(span_id, kind, payload): one row per payload that is present."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("payload")) for k in _PAYLOADS])
    return (
        spans.select("span_id", F.explode(each).alias("p"))
        .select("span_id", "p.kind", "p.payload")
        .filter(F.col("payload").isNotNull())
    )


def write_payloads(spans: DataFrame, path: str, config: RedactionConfig = RedactionConfig()) -> None:
    rows = payload_rows(spans).withColumn("payload", redact_json(F.col("payload"), config))
    rows.write.mode("overwrite").partitionBy("kind").json(path)


def write_table(df: DataFrame, path: str, form: str = "json") -> None:
    """Any result table as `json` or `parquet`."""
    df.write.mode("overwrite").format(form).save(path)


def write_sequence_text(lines: DataFrame, path: str, by: str = "exec_id") -> None:
    """Diagram source, sorted by execution and line, as (execution, line) text rows.

    A range sort keeps the lines of an execution in order across files without
    putting an execution into one task.
    """
    ordered = lines.orderBy(by, "section", "pos", "sub", "line")
    ordered.select(by, "text").write.mode("overwrite").json(path)
