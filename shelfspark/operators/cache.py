"""The identity cache: what a listing already knows, what has to be read, what is kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, TTL, MOST = 8, 90 * 86400, 20_000
#: Saved versions that stay, for those who still read them.
HELD = 3


def known(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Listed rows that the cache knows by key; a cached row whose file is gone stays away."""
    return listing.join(cache, "key")


def todo(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Listed rows that have to be read: a null key (no modification time) always."""
    return listing.join(cache.select("key"), "key", "left_anti")


def split_counts(listing: DataFrame, cache: DataFrame) -> DataFrame:
    marked = listing.join(cache.select("key", F.lit(True).alias("hit")), "key", "left")
    return marked.groupBy("place").agg(F.count("hit").alias("known"), (F.count("*") - F.count("hit")).alias("todo"))


def refreshed(cache: DataFrame, used: DataFrame, read: DataFrame, now: int) -> DataFrame:
    """The cache after a scan: what was used is seen now, what was read is added."""
    hit = used.select("key", F.lit(now).alias("again")).distinct()
    old = cache.join(hit, "key", "left").withColumn("seen", F.coalesce("again", "seen")).drop("again")
    return old.join(read.select("key"), "key", "left_anti").unionByName(read.withColumn("seen", F.lit(now).cast("bigint")), allowMissingColumns=True)


def kept(cache: DataFrame, now: int, ttl: int = TTL, most: int = MOST) -> DataFrame:
    """Rows seen within the time to live, the newest of them up to a number; by key among equals."""
    return cache.where(F.col("seen") >= now - ttl).orderBy(F.col("seen").desc(), "key").limit(most)


def dirty(used: DataFrame, read: DataFrame) -> bool:
    """Whether a scan has to save the cache: only what it has read anew is worth a write, hits alone are not."""
    return not read.isEmpty()


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    """The folder of the last version that has been named; a cache that was written straight to path is one itself."""
    where, files = _files(spark, path)
    if not files.exists(where):
        return None
    names = [x.getPath().getName() for x in files.listStatus(where)]
    saved = sorted(n for n in names if n.startswith("saved-"))
    return f"{path}/{saved[-1]}" if saved else path if any(n.endswith(".parquet") for n in names) else None


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache at path; an empty one if there is none, it can't be read or another version wrote it."""
    empty = spark.createDataFrame([], schema)
    try:
        folder = _current(spark, path)
        if folder is None:
            return empty
        got = spark.read.parquet(folder)
        if "version" not in got.columns:
            return empty
        return got.where(F.col("version") == VERSION).select(*empty.columns)
    except Exception as e:  # noqa: BLE001  a cache never stops a scan
        if type(e).__name__ not in ("AnalysisException", "SparkException", "Py4JJavaError", "IllegalArgumentException"):
            raise
        return empty


def save(cache: DataFrame, path: str, now: int, held: int = HELD) -> None:
    """Writes the cache beside what is there and names it by one rename, so that it may come from the same path and a save that stops loses nothing.

    Readers of the versions before keep their files: the last `held` stay.
    """
    spark = cache.sparkSession
    where, files = _files(spark, path)
    files.mkdirs(where)
    known = sorted(x.getPath().getName() for x in files.listStatus(where) if x.getPath().getName().startswith("saved-"))
    number = int(known[-1].partition("-")[2]) + 1 if known else 0
    writing, _ = _files(spark, f"{path}/_writing-{uuid.uuid4().hex}")
    kept(cache, now).withColumn("version", F.lit(VERSION)).write.parquet(writing.toString())
    while not files.rename(writing, _files(spark, f"{path}/saved-{number:09d}")[0]):
        if not files.exists(_files(spark, f"{path}/saved-{number:09d}")[0]):
            raise RuntimeError(f"the cache can't be named in {path}")
        number += 1  # another scan was first; the later save counts
    for name in known[: max(0, len(known) + 1 - held)]:
        files.delete(_files(spark, f"{path}/{name}")[0], True)
    for x in files.listStatus(where):
        if x.getPath().getName().startswith("part-") or x.getPath().getName() == "_SUCCESS":
            files.delete(x.getPath(), False)  # of a cache that was written straight to path


def scanned(cache: DataFrame, used: DataFrame, read: DataFrame, path: str, now: int) -> bool:
    """Saves the cache after a scan if it is dirty; whether it was."""
    if not dirty(used, read):
        return False
    save(refreshed(cache, used, read, now), path, now)
    return True
