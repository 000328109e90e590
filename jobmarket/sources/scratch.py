"""Folders for what a job writes and reads again, and small files through the file system of the session."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for what a job writes and reads again: in spark.checkpoint.dir; unset, a local one in local mode, and on a cluster the job fails."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: its lineage ends there, and every later reading sees the same rows in the same files."""
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match; one listing of each folder that the pattern goes through."""
    at, fs = files(spark, pattern)
    return [str(s.getPath().toString()) for s in fs.globStatus(at) or []]


def write_file(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small file; without `replace` only if there is none by that name, which the file system grants to one writer."""
    at, fs = files(spark, path)
    fs.mkdirs(at.getParent())
    try:
        out = fs.create(at, replace)
    except Py4JJavaError:
        if not replace and fs.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_file(spark: SparkSession, path: str) -> str:
    at, fs = files(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    at, fs = files(spark, path)
    fs.delete(at, True)
