"""Several outputs of one job that appear together or not at all.

Outputs are written into a staging folder next to the versions that are there. When all
are complete, a manifest with their parts and rows is added, the folder gets its final
name, and last a small file that names the current version is replaced. A job that
fails before leaves what readers see as it was; its staging folder is never read, and
the next successful write removes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.redaction import RedactionConfig, redact_text
from spanloom.operators.chains import bridge_values, chain_spans, chain_summary
from spanloom.session import stored
from spanloom.sources.sinks import redact_spans

_CURRENT = "_current"
_STAGING = "_staging-"
#: Folders that the chains of a bundle are dealt over.
CHAIN_FOLDERS = 32


class _Folder:
    """A folder in whatever store Spark's own readers reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.root = path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(""))] if self.fs.exists(self.at("")) else []

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{self.root}: cannot rename {old} to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def write_bundle(spark: SparkSession, path: str, outputs: dict[str, DataFrame], partition_by: str | None = None, facts: dict | None = None) -> str:
    """Write all `outputs` as JSON lines below `path`, each in a folder of its name and by
    `partition_by`, and return the version's name. The manifest holds `facts`."""
    folder, version = _Folder(spark, path), f"version-{uuid.uuid4().hex}"
    staging = f"{_STAGING}{version}"
    parts = {}
    for name, rows in outputs.items():
        target = f"{folder.root}/{staging}/{name}"
        writer = rows.write
        if partition_by and partition_by in rows.columns:
            # Rows of one folder go to few tasks, but a hot folder is not forced into one.
            spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != partition_by]), F.lit(16))
            writer = rows.repartition(F.col(partition_by), spread).write.partitionBy(partition_by)
        writer.json(target)
        back = spark.read.schema(rows.schema).json(target)
        seen = back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_metadata.file_path").alias("files")).first()
        parts[name] = {"rows": seen["n"], "files": seen["files"], "schema": json.loads(rows.schema.json())}
    folder.write(f"{staging}/_manifest.json", json.dumps({"version": version, "outputs": parts, "facts": facts or {}}))
    folder.rename(staging, version)
    before = folder.read(_CURRENT)
    # A reader finds the old name or the new one.
    folder.write(f"{_CURRENT}-{version}", version)
    folder.delete(_CURRENT)
    folder.rename(f"{_CURRENT}-{version}", _CURRENT)
    for name in folder.names():
        if name.startswith(_STAGING) or (name.startswith("version-") and name not in (version, before)):
            folder.delete(name)
    return version


def _current(folder: _Folder) -> str:
    version = folder.read(_CURRENT)
    if version is None:
        # Between the two steps of the replacement, the complete version with a note counts.
        notes = [n.removeprefix(f"{_CURRENT}-") for n in folder.names() if n.startswith(f"{_CURRENT}-version-")]
        if not notes:
            raise FileNotFoundError(f"nothing was written to {folder.root}")
        version = notes[0]
    return version


def manifest(spark: SparkSession, path: str) -> dict:
    """What the current version holds."""
    folder = _Folder(spark, path)
    return json.loads(folder.read(f"{_current(folder)}/_manifest.json"))


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One output of the current version."""
    from pyspark.sql.types import StructType

    found = manifest(spark, path)
    schema = StructType.fromJson(found["outputs"][name]["schema"])
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/{found['version']}/{name}")


def write_chains(chained: DataFrame, lines: DataFrame, path: str, config: RedactionConfig = RedactionConfig()) -> str:
    """Chains with their spans, raw lines and facts. All rows of a chain lie in one of
    `CHAIN_FOLDERS` folders, which `read_chain` knows: a folder for each chain would be as
    many folders and files as there are chains.

    `chained` comes from `with_payload`, `lines` has (seq, line) and `seq` is the place an
    entry came from. Spans and lines are redacted. Outputs: `spans`, `lines` and
    `chains`; the manifest counts chains and entries.
    """
    spark = chained.sparkSession
    chained = stored(chained, "chained")
    spans = redact_spans(chain_spans(chained), config)
    raw = lines.join(chained.select(F.col("idx").alias("seq"), "chain_id"), "seq").select("seq", "chain_id", redact_text(F.col("line"), config).alias("line"))
    summary = stored(chain_summary(chained), "chain-summary")
    totals = summary.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("chains")).first()
    components = chained.select("component").distinct().count()
    bridges = summary.select(F.explode("bridges").alias("value")).distinct().count()
    outputs = {"spans": spans, "lines": raw, "chains": summary}
    return write_bundle(
        spark, path, {name: rows.withColumn("folder", _chain_folder(F.col("chain_id"))) for name, rows in outputs.items()}, "folder",
        {"entries": totals["entries"], "chains": totals["chains"], "components": components, "bridges": bridges},
    )


def _chain_folder(chain_id: Column) -> Column:
    return F.pmod(F.xxhash64(chain_id), F.lit(CHAIN_FOLDERS)).cast("int")


def read_chain(spark: SparkSession, path: str, name: str, chain_id: str) -> DataFrame:
    """One output of one chain; reads that chain's folder only."""
    rows = read_bundle(spark, path, name)
    return rows.filter((F.col("folder") == _chain_folder(F.lit(chain_id))) & (F.col("chain_id") == chain_id)).drop("folder")
