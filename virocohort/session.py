"""Session defaults and lineage cutting shared by every job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_private: str | None = None  # scratch folder of a local session without a named one (tests); gone with the process

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "virocohort", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; extra settings come as keyword pairs (dots as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only for local masters, one per process."""
    global _private
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _private is None:
        _private = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _private, ignore_errors=True)
    return _private


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the checkpoint folder.

    A lost executor then rereads files instead of replaying earlier rounds, and the planner sees the
    real size of what it joins next.
    """
    spark = df.sparkSession
    folder = checkpoint_folder(spark)
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(table: DataFrame) -> None:
    """Drop a table of ``cut_lineage`` that nothing reads any more.  Call it on the frame that function gave."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
