"""The folder that all executors share, tables stored there on the way, and inputs of too few partitions."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where none is set, a temporary one, but only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tonarm-"))
    return sc.getCheckpointDir()


_steps: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is written there goes at the end of the `step` it was asked for in, or else of the application."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _steps:
        _steps[-1].append(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def step(spark: SparkSession):
    """Tables stored inside are deleted at the end: only for work whose results have been written by then."""
    _steps.append([])
    try:
        yield
    finally:
        for path in _steps.pop():
            files, at = _path(spark, path)
            files.delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, dealt over all cores if its files make fewer partitions; of many files nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
