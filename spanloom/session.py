"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. All of them can be changed at run time, so
# they apply equally to a session that somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed probe side even when that costs one more exchange above it:
    # look-ups by parent, key or value are where hot keys show up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Later entries win when maps are concatenated (see normalise.flatten_wrappers).
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Sets collected per execution are small (component names); staying on the
    # hash path avoids a sort of the whole input.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return shipped(spark)


def shipped(spark: SparkSession) -> SparkSession:
    """Give the workers this package, once for each context, from wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_spanloom_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        # Spark copies the file to its own file server.
        path = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
        context._spanloom_shipped = True
    return spark


def build_session(app: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session; ``conf`` takes extra ``key=value`` settings."""
    builder = SparkSession.builder.appName(app).config(
        "spark.cleaner.referenceTracking.cleanCheckpoints", "true"
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where that is unset,
    one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_spanloom"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so that a lost executor costs
    one re-read instead of the whole loop."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder as Parquet and read again: cuts the lineage, and
    later steps read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables written between jobs."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
