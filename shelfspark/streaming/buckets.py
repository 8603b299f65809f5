"""Tables kept by batches, in versions, each dealt into buckets that split as they grow.

A bucket holds the rows whose key's hash ends in certain bits, written depth-value; a batch reads and rewrites only the buckets that its rows fall into,
beside those that are there, and one that would get more than a number of rows is dealt over longer endings. So what a batch costs follows the
batch and not the table. A manifest for each version names the folders and row counts of all buckets of all its tables. It is written under another name and
then renamed to a name that didn't exist, which is atomic; the manifest with the highest number counts. So readers always see a whole version of all tables
together, and a batch that fails at any point, or comes again, changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table as a power of two, rows of a bucket at most (but for a batch's own chance), and versions that readers may still hold.
DEPTH, MOST, KEPT = 6, 500_000, 3


@dataclass
class Change:
    """What a batch does to a table: rows with these keys go, then these rows come. by: the columns of the key that buckets go by."""

    by: list[str]
    gone: DataFrame
    added: DataFrame


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = file_system(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def manifests(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that have been named, in order."""
    return sorted(int(n.removeprefix("CURRENT-")) for n in names(spark, root) if n.startswith("CURRENT-"))


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    """What a version says of its tables: an entry for each bucket."""
    p, fs = file_system(spark, f"{root}/CURRENT-{version:012d}")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The last version, and its tables by name: schema, by, folders and rows by bucket; -1 and none before the first."""
    known = manifests(spark, root)
    return (known[-1], manifest(spark, root, known[-1])) if known else (-1, {})


def name(spark: SparkSession, root: str, version: int, tables: dict) -> None:
    """Makes a version the current one, by a rename to a new name."""
    new, fs = file_system(spark, f"{root}/_naming-{version}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    if not fs.rename(new, file_system(spark, f"{root}/CURRENT-{version:012d}")[0]):
        raise RuntimeError(f"version {version} can't be named in {root}")


def forget(spark: SparkSession, root: str) -> None:
    """Deletes what none of the last versions names."""
    known = manifests(spark, root)
    held = {f for n in known[-KEPT:] for t in manifest(spark, root, n).values() for f in t["folders"].values()}

    def drop(path: str) -> None:
        p, fs = file_system(spark, f"{root}/{path}")
        fs.delete(p, True)

    for n in known[:-KEPT]:
        drop(f"CURRENT-{n:012d}")
    for version in (x for x in names(spark, root) if x.startswith("v") and int(x[1:]) < known[-1]):
        if not any(f.startswith(f"{version}/") for f in held):
            drop(version)
            continue
        for table in names(spark, f"{root}/{version}"):
            for bucket in names(spark, f"{root}/{version}/{table}"):
                if f"{version}/{table}/{bucket}" not in held:
                    drop(f"{version}/{table}/{bucket}")


def _ends(by: list[str], bits: Column) -> Column:
    """So many last bits of the key's hash."""
    return F.xxhash64(*by).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1)


def located(rows: DataFrame, table: dict) -> DataFrame:
    """rows with __depth and __value of the bucket that each falls into."""
    directory = [tuple(map(int, b.split("-"))) for b in table["rows"]]
    depths = sorted({d for d, _ in directory})
    if len(depths) == 1:
        return rows.withColumn("__depth", F.lit(depths[0])).withColumn("__value", _ends(table["by"], F.lit(depths[0])))
    there = rows.sparkSession.createDataFrame(directory, "__depth int, __value bigint")
    tried = rows.withColumn("__depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("__value", _ends(table["by"], F.col("__depth")))
    return tried.join(F.broadcast(there), ["__depth", "__value"])  # a row for each bucket


def _bucket() -> Column:
    return F.concat_ws("-", "__depth", "__value")


def _read(spark: SparkSession, root: str, table: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(table["schema"])
    folders = [f"{root}/{f}" for b, f in table["folders"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """All rows of a table in its current version."""
    _, tables = current(spark, root)
    return _read(spark, root, tables[table]) if table in tables else None


def lookup(keys: DataFrame, root: str, table: dict, seen: set[str] | None = None) -> DataFrame:
    """Rows of a table with the given keys (its columns `by`); only the buckets they fall into are read, and named in seen."""
    touched = [r[0] for r in located(keys, table).select(_bucket()).distinct().collect()]  # the number of buckets at most
    if seen is not None:
        seen.update(touched)
    return _read(keys.sparkSession, root, table, touched).join(keys.select(*table["by"]).distinct(), table["by"], "left_semi")


def apply(spark: SparkSession, root: str, version: int, changes: dict[str, Change], naming: Callable = name, most: int = MOST, depth: int = DEPTH) -> None:
    """Puts a version's changes into their tables, all at once; a version that is there already is left alone. New tables begin with 2 ** depth buckets."""
    done, tables = current(spark, root)
    if version <= done:
        return
    tables = dict(tables)
    for table, change in changes.items():
        first = {"schema": change.added.schema.jsonValue(), "by": change.by, "folders": {}, "rows": {f"{depth}-{v}": 0 for v in range(1 << depth)}}
        tables[table] = _changed(spark, root, f"v{version}/{table}", tables.get(table, first), change, most)
    naming(spark, root, version, tables)
    forget(spark, root)


def _changed(spark: SparkSession, root: str, into: str, table: dict, change: Change, most: int) -> dict:
    added, gone = located(change.added, table), located(change.gone.select(*change.by), table)
    more = {r.b: r.n for r in added.groupBy(_bucket().alias("b")).agg(F.count("*").alias("n")).collect()}  # a row for each bucket
    touched = sorted({*more, *(r[0] for r in gone.select(_bucket()).distinct().collect())})
    if not touched:
        return table
    kept = _read(spark, root, table, touched).join(change.gone.select(*change.by).distinct(), change.by, "left_anti")
    rows = located(kept, table).select(*added.columns).unionByName(added)
    deeper, children = [], {}
    for b in touched:
        depth, value = map(int, b.split("-"))
        bits = 0
        while (table["rows"][b] + more.get(b, 0)) >> bits > most:
            bits += 1
        if bits:
            deeper.append((depth, value, depth + bits))
        children[b] = [f"{depth + bits}-{value + (i << depth)}" for i in range(1 << bits)]
    if deeper:
        rows = rows.join(F.broadcast(spark.createDataFrame(deeper, "__depth int, __value bigint, __to int")), ["__depth", "__value"], "left")  # a row for each bucket
        rows = rows.withColumn("__depth", F.coalesce("__to", "__depth")).withColumn("__value", _ends(change.by, F.col("__depth")))
    rows = rows.withColumn("__bucket", _bucket()).select(*change.added.columns, "__bucket")
    rows.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{root}/{into}")
    written = {n.partition("=")[2]: f"{into}/{n}" for n in names(spark, f"{root}/{into}") if n.startswith("__bucket=")}
    counted = {r[0]: r[1] for r in spark.read.schema("__bucket string").parquet(f"{root}/{into}").groupBy("__bucket").count().collect()} if written else {}  # a row for each bucket
    own = [c for b in touched for c in children[b]]
    return table | {
        "folders": {b: f for b, f in table["folders"].items() if b not in children} | {b: written[b] for b in own if b in written},
        "rows": {b: n for b, n in table["rows"].items() if b not in children} | {b: counted.get(b, 0) for b in own},
    }
