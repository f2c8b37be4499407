"""Paths: one without a scheme is in Spark's default file system, on the driver and on executors alike."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark reads and writes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def file_system(path: str):
    """(file system, path within it) for pyarrow."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write(path: str, data: bytes) -> None:
    system, at = file_system(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at, compression=None) as stream:
        stream.write(data)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); without it, a temporary one if all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/rasterloom-scratch"
    return qualified(spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table to scratch and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
