"""Places of lines in their source.

The place of a line is where its file, the block of the file that one task reads, and
its row in that block stand. Blocks are counted once, a small table with a row for each
block; running totals over it give the number of rows before each block, and a line's
place is that number plus its row in the block. So places are the same into however
many blocks the files are cut, and no row is moved for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.ordering import running_total

#: Blocks up to which their table is sent to all tasks (some 100 bytes each); with more,
#: how it is joined is left to Spark.
SENT_BLOCKS = 100_000

# Rows are numbered within a task; the number of the task is in the bits above.
_ROW_BITS = 33


def numbered_lines(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """(seq, file, number, value) of all lines: `number` counts from 1 in the file, `seq`
    from 0 over all files in the order of their paths."""
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    numbered = running_total(blocks, ["file", "block"], "n").withColumnRenamed("before", "before_all")
    files = numbered.groupBy("file").agg(F.min("before_all").alias("before_file"))
    offsets = numbered.join(files, "file")
    if offsets.count() <= SENT_BLOCKS:
        offsets = F.broadcast(offsets)
    row = F.col("id") - F.col("first")
    # Both reads cut the files alike. Should settings change between them, the row tells.
    fits = (row >= 0) & (row < F.col("n")) & (F.shiftright("id", _ROW_BITS) == F.shiftright("first", _ROW_BITS))
    row = F.when(F.coalesce(fits, F.lit(False)), row).otherwise(F.raise_error(F.lit("files were cut into other blocks than when counted")))
    return raw.join(offsets, ["file", "block"], "left").select(
        (F.col("before_all") + row).cast("long").alias("seq"),
        "file",
        (F.col("before_all") - F.col("before_file") + row + 1).cast("long").alias("number"),
        "value",
    )
