"""What the operators share: rows that keep all their columns, batches as bytes,
and small model files.

An operator never relies on a caller's ids being unique or present. It packs each
row into one struct, so that no column of the caller can clash with its own, and
recognises a document by two 64-bit hashes of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import scratch_path, shipped

KEY = ["k1", "k2"]

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 21
#: The same where many numbers are held for each byte.
SMALL_STEP = 1 << 19


def prepared(spark: SparkSession) -> SparkSession:
    """Batches small enough that many long texts fit into a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return shipped(spark)


#: Where tables are noted that somebody will drop; the last one notes.
_NOTES: list[list[str]] = []


#: Shuffle files go at the end of a query, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, which cuts the lineage; shuffle files
    of the write go with its end."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for notes in _NOTES[-1:]:
        notes.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of tables that are stored meanwhile."""
    _NOTES.append([])
    try:
        yield _NOTES[-1]
    finally:
        _NOTES.pop()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def others(docs: DataFrame, text_col: str) -> Column:
    """One struct ``row`` of all columns but the text."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).alias("none")]).alias("row")


def packed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: bool = True) -> DataFrame:
    """``text`` (null: empty), the key ``k1``, ``k2``, and ``row`` with all other columns,
    or only ``doc_id`` when ``keep`` is false."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col)
    return docs.select(
        others(docs, text_col) if keep else id_.alias("doc_id"),
        text.alias("text"),
        F.xxhash64(F.lit(1), id_, text).alias("k1"),
        F.xxhash64(F.lit(2), text, id_).alias("k2"),
    )


def crc_rest(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(data: np.ndarray, at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, end row, bytes, starts."""
    first = 0
    while first < len(at) - 1:
        end = int(np.searchsorted(at, at[first] + most, "right")) - 1
        end = max(end, first + 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column out of flat values and list starts (one more at the end)."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))
