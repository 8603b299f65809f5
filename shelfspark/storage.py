"""Intermediate results that outlive executors."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_paths: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A folder of this machine only where executors run on it too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="shelfspark-"))
    return _own_dir[0]


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has; what is written there goes when the session's file systems close."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts the lineage.

    What follows reads the same rows however often it runs and whichever executors are lost. The files go when the
    session's file systems close.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


#: Inputs up to so many bytes are dealt out; a shuffle of them is nothing beside the work on them.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is small and its files give fewer tasks than that, as one file of one row group does.

    Larger inputs have more splits than there are cores and are read as they are. The rows are the same either way.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.optimizedPlan().stats().sizeInBytes() > SMALL or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def discard(*frames: DataFrame) -> None:
    """Delete the files of what materialize() gave, once nothing reads them any more. Other DataFrames are left alone."""
    for df in frames:
        known, path = _paths.pop(id(df), (None, None))
        if known is not None and known() is df:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
