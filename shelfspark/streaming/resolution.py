"""Books kept resolved as copies come and go: connected components that a batch changes only where it touches them.

Three tables in splitting buckets (streaming/buckets.py), changed together: places (by place and path: which copy stands there, since when, and its component),
members (by component: its copies) and keys (by content key: its component). For a batch,

- components that lose or change a copy are taken apart: their other copies are nodes again, with all of their keys;
- components that new copies only share a key with are contracted: one node each, with the shared keys, whatever their size;
- the new copies are nodes.

The components of that small graph are the new ones. A contracted node's number is its smallest copy's, so the smallest node is the smallest
copy, as in full resolution. Copies of a contracted component are rewritten only if it gets another number. All lookups read the
buckets that their keys fall into and no others.

A copy that is older (seen) than what is held at its place and path is refused; what is gone stays as a mark. A batch that is in already is left
alone, and an empty one changes nothing but the version. Copies have ids of their own; null content keys join nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import resolve as R
from shelfspark.storage import discard, materialize
from shelfspark.streaming import buckets
from shelfspark.streaming.catalogue import newest

_SPOT = ["place", "path"]


def upsert(copies: DataFrame, batch: int, root: str, most: int = buckets.MOST) -> dict[str, set[str]]:
    """Puts one batch of copies (gone or not) into the tables; the buckets that it looked into, by table."""
    spark = copies.sparkSession
    done, tables = buckets.current(spark, root)
    read: dict[str, set[str]] = {"places": set(), "members": set(), "keys": set()}
    if batch <= done:
        return read
    made: list[DataFrame] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        made.append(materialize(df, label))
        return made[-1]

    def find(table: str, keys: DataFrame, otherwise: str) -> DataFrame:
        return buckets.lookup(keys, root, tables[table], read[table]) if table in tables else spark.createDataFrame([], otherwise)

    ids = copies.schema["copy_id"].dataType.simpleString()
    columns = copies.drop("gone").columns
    member = f"component {ids}, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in copies.schema.fields if f.name != "gone")

    # What is taken, and what stood in its place.
    held = keep(find("places", copies.select(*_SPOT), f"place string, path string, copy_id {ids}, component {ids}, seen bigint, gone boolean"), "held")
    blank = [F.col(c) if c in held.columns else F.lit(None).cast(copies.schema[c].dataType).alias(c) for c in copies.columns]
    fresh = keep(newest(copies, held.select(*blank)), "fresh")
    lost = keep(held.where("NOT gone").join(fresh.select(*_SPOT), _SPOT, "left_semi").select("component").distinct(), "lost")
    apart = keep(find("members", lost, member), "apart")
    left = apart.join(fresh.select(*_SPOT), _SPOT, "left_anti").select(*columns)
    added = fresh.where("NOT gone").select(*columns)

    # The graph of what changes.
    nodes = keep(R.keys_of(left.unionByName(added)), "nodes")
    met = find("keys", R.keys_of(added).select("key").distinct(), f"key string, component {ids}").join(lost, "component", "left_anti")
    contracted = keep(met.select(F.col("component").alias("copy_id"), "key"), "contracted")
    labels = keep(R.components(nodes.unionByName(contracted)), "labels")
    renamed = contracted.select("copy_id").distinct().join(labels, "copy_id").where("component <> copy_id").select(F.col("copy_id").alias("old"), F.col("component").alias("new"))
    renamed = keep(renamed, "renamed")
    moved = find("members", renamed.select(F.col("old").alias("component")), member).join(renamed, F.col("component") == F.col("old")).select(F.col("new").alias("component"), *columns)
    own = left.unionByName(added).join(labels, "copy_id", "left").select(F.coalesce("component", "copy_id").alias("component"), *columns)
    rows = keep(own.unionByName(moved), "rows")

    keyed = R.keys_of(rows).join(rows.select("copy_id", "component"), "copy_id")
    spots = rows.select(*_SPOT, "copy_id", "component", "seen", F.lit(False).alias("gone"))
    marks = fresh.where("gone").select(*_SPOT, "copy_id", F.lit(None).cast(ids).alias("component"), "seen", "gone")
    spots = spots.unionByName(marks)
    no_longer = lost.unionByName(renamed.select(F.col("old").alias("component")))
    changes = {
        "places": buckets.Change(_SPOT, spots.select(*_SPOT), spots),
        "members": buckets.Change(["component"], no_longer, rows),
        "keys": buckets.Change(["key"], R.keys_of(apart).select("key").unionByName(keyed.select("key")), keyed.select("key", "component").distinct()),
    }
    buckets.apply(spark, root, batch, changes, most=most, depth=0)
    discard(*made)
    return read


def resolved(spark: SparkSession, root: str) -> DataFrame | None:
    """All copies that are there, with book_id."""
    rows = buckets.read(spark, root, "members")
    return None if rows is None else rows.withColumnRenamed("component", "book_id")


def books(spark: SparkSession, root: str) -> DataFrame | None:
    """The books, from what is kept: nothing is resolved anew."""
    rows = resolved(spark, root)
    return None if rows is None else R.books(rows)
