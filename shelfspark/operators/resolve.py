"""Which copies are the same book: connected components over shared content keys, and what a book takes from its copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.storage import discard, materialize


def keys_of(copies: DataFrame) -> DataFrame:
    """(copy_id, key): the content keys of each readable copy and of its device variant, by kind."""
    named = F.array(
        F.when(F.col("sha") != "", F.concat(F.lit("s:"), "sha")),
        F.when(F.col("sha") != "", F.concat(F.lit("r:"), "resources")),
        F.when(F.col("sha") != "", F.concat(F.lit("r:"), "variant_resources")),
    )
    return copies.select("copy_id", F.explode(F.array_distinct(F.array_compact(named))).alias("key"))


def components(keys: DataFrame, node: str = "copy_id") -> DataFrame:
    """(node, component): the smallest node that each is joined to by shared keys, transitively.

    Keys of a single node join nothing and are dropped first. Labels then go back and forth between nodes and keys by
    aggregation, which combines before it shuffles, and equi-joins, whose hot keys adaptive execution
    splits; each round also jumps to the label's own label, so that rounds grow with the logarithm of a chain.
    """
    shared = keys.groupBy("key").agg(F.min(node).alias("a"), F.max(node).alias("b")).where(F.col("a") < F.col("b")).select("key")
    edges = materialize(keys.join(shared, "key", "left_semi").distinct(), "edges")
    firsts = edges.groupBy("key").agg(F.min(node).alias("least"))  # before anything has spread, a node's label is itself
    labels = materialize(edges.join(firsts, "key").groupBy(node).agg(F.min("least").alias("component")), "components")
    while True:
        least = edges.join(labels, node).groupBy("key").agg(F.min("component").alias("least"))
        met = edges.join(least, "key").groupBy(node).agg(F.min("least").alias("met"))
        jump = labels.select(F.col(node).alias("met"), F.col("component").alias("further"))
        after = met.join(jump, "met", "left").select(node, F.least("met", F.coalesce("further", "met")).alias("component"))
        moved = after.join(labels.select(node, F.col("component").alias("before")), node).withColumn("moved", F.col("component") < F.col("before"))
        moved = materialize(moved.select(node, "component", "moved"), "components")
        discard(labels)
        if moved.where("moved").isEmpty():
            discard(edges)
            return moved.select(node, "component")
        labels = moved


def resolved(copies: DataFrame) -> DataFrame:
    """copies with book_id, the smallest copy_id of its book; copies without a shared key are books of their own."""
    found = components(keys_of(copies))
    return copies.join(found, "copy_id", "left").withColumn("book_id", F.coalesce("component", "copy_id")).drop("component")


def arrival(copies: DataFrame | None = None) -> Column:
    """Sorts copies in the order in which they arrive: places in turn, paths in order."""
    return F.struct("place_rank", "path")


def preference() -> Column:
    """Sorts copies by how good a source they are: originals before device copies, then by place."""
    return F.struct(F.col("optimized"), F.col("place_rank"))


def books(copies: DataFrame) -> DataFrame:
    """A row for each book of resolved copies.

    Title, author and series are those of the copy that arrived last; the preferred copy is the best
    source, the latest of equals; places are named in fixed order.
    """
    told = F.max_by(F.struct("title", "author", "series", "series_index"), arrival()).alias("told")
    latest = F.struct(-F.col("place_rank"), F.col("path"))
    best = F.max_by(F.struct("copy_id", "place", "path", "format", "sha", "size", "optimized"), F.struct(~F.col("optimized"), -F.col("place_rank"), latest)).alias("preferred")
    has = [F.bool_or(F.col("place") == p).alias(f"on_{p.lower()}") for p in ("Local", "Kobo", "CrossPoint")]
    grouped = copies.groupBy("book_id").agg(
        told,
        best,
        F.count("*").alias("n_copies"),
        F.bool_or(F.col("sha") == "").alias("any_unreadable"),
        F.bool_and(F.col("sha") == "").alias("all_unreadable"),
        *has,
    )
    places = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"on_{p.lower()}"), F.lit(p)) for p in ("Local", "Kobo", "CrossPoint")])), ",")
    return grouped.select("book_id", "told.*", "preferred", "n_copies", "any_unreadable", "all_unreadable", "on_local", "on_kobo", "on_crosspoint", places.alias("places"))
