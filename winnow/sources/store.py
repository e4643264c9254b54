"""Tables written between the steps of an iteration."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, or its context's checkpoint
    folder; where there is neither, one is made, which only a session on one machine can do."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="winnow-store-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: evaluated once, with no lineage above.

    The shuffle files of the write go when it ends, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/winnow/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    except Exception:
        delete(spark, path)
        raise
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._winnow_path = path
    return out


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that it is on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._winnow_path)
