"""Operator 4: mixing sources to target weights by capped water-filling. DataFrame functions only.

Sources are ordered by code point, nulls last, and weighed 1, 2, 3 and over again. Each gets its share of all words by
weight; sources that this would repeat more often than a number of epochs are clamped to that, and what they leave goes to
the others by weight, until none passes its cap. Each round is one aggregation over a narrow table of sources, which
is numbered by a range exchange and never gathered, so that sources may be as many as hosts. A source is then
repeated whole as often as fits, and a seeded order of its documents says which are taken once more; the last
of these is taken as far as the target reaches, so that each source gives its target to the word.

Where sources lie in seeded order is found by bucket: totals of each (source, bucket) are summed up over the
buckets of a source, and a running sum inside a bucket does the rest, so that a hot source is dealt over all tasks.

Defined results: a null or empty text has size 0 and is never taken. Null sources are one source. Equal ids
fall in the same bucket and are ordered by their text's hash; rows equal in all of it are interchangeable. An
empty table gives no rows. Very long texts are counted whole. Other columns do not matter here, whatever their names; mix() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import GAP, WORD, documents, materialize, text_or_empty

#: The cap in epochs, the weights in turn and the seed. A source's documents are dealt into 16 ** BUCKET_DIGITS buckets.
EPOCHS, WEIGHTS, SEED, BUCKET_DIGITS = 3, (1, 2, 3), 20240607, 3
MOST_SOURCES = 100_000  # up to so many rows, what is known of each source is broadcast


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def numbered(sizes: DataFrame, into: str = "nth") -> DataFrame:
    """sizes, a row for each source, with the place of the source among all, from 0: by partitions that hold a range of them each."""
    parts = materialize(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.join(F.broadcast(counts.select("part", before.alias("before"))), "part").withColumn(into, F.col("before") + within).drop("part", "before")


def targets(sizes: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target from a row (source, source_size) for each source.

    left and weight_left are the words and the weight of the sources that aren't clamped; their quotient rises from round to
    round, so that a clamped source stays so. Rounds end when they clamp no more.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    known = materialize(numbered(sizes).withColumn("weight", weight).drop("nth"), "weighed")
    wide = lambda x: x.cast("decimal(38,0)")
    whole = known.agg(F.sum("source_size").alias("left"), F.sum("weight").alias("weight")).first()
    left, weight_left = whole.left or 0, whole.weight or 0
    while True:
        clamped = wide(F.col("source_size") * epochs) * F.lit(weight_left) <= wide(F.lit(left)) * F.col("weight")
        gone = known.where(clamped).agg(F.sum(F.col("source_size") * epochs).alias("words"), F.sum("weight").alias("weight")).first()
        now = ((whole.left or 0) - (gone.words or 0), (whole.weight or 0) - (gone.weight or 0))
        if now == (left, weight_left) or not now[1]:
            break
        left, weight_left = now
    target = F.when(clamped, (F.col("source_size") * epochs).cast("double")).otherwise(F.col("weight").cast("double") * F.lit(float(left) / float(max(weight_left, 1))))
    return known.select("source", "source_size", "weight", target.alias("target"))


def _drawn(key: Column, seed: int) -> Column:
    """The seeded place of a row in its source: an MD5 sum, which sorts alike in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def _placed(df: DataFrame, key: str, epochs: int, weights: tuple[int, ...], seed: int) -> DataFrame:
    """For each row of df: key, source, size, draw, text_hash, source_size, target, and of the mix: whole (repetitions of all
    of the source), rest (words of the source to be taken besides), begins (words of the source that are drawn before)."""
    rows = df.select(F.col(key).alias("key"), "source", n_words(text_or_empty()).alias("size"), _drawn(F.col(key), seed).alias("draw"), F.md5(text_or_empty().cast("binary")).alias("text_hash"))
    rows = materialize(rows.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS)), "mix")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    goal = targets(sizes, epochs, weights)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("size_before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    known = offsets.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "bucket", "size_before", "source_size", "target")

    to_here = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("draw", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("to_here", to_here).alias("r").join(known.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.bucket") == F.col("k.bucket")))
    goal_words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = both.select("r.key", "r.source", "size", "draw", "text_hash", "source_size", "target", whole.alias("whole"), goal_words.alias("goal"), (F.col("size_before") + F.col("to_here") - F.col("size")).alias("begins"))
    return out.withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size")).drop("goal")


def _extra(size: Column, left: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size, left))


def plan(df: DataFrame, key: str = "doc_id", epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """key, source, size, source_size, target and taken, a row for each row of df."""
    rows = _placed(df, key, epochs, weights, seed)
    taken = F.col("whole") * F.col("size") + _extra(F.col("size"), F.col("rest") - F.col("begins"))
    return rows.select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mixed rows with the columns of df: each as often as the mix takes it, the last time cut to the words taken.

    Texts are not shuffled: of the plan, which is made of narrow rows, each source tells only up to which draw its
    documents are taken once more, and every row finds for itself on which side it stands.
    """
    read = df.select(F.col(key), "source", F.col(text).alias("text"))
    rows = _placed(read, key, epochs, weights, seed).where(F.col("size") > 0)
    place = F.struct("draw", "text_hash")
    last = F.max(F.when(F.col("rest") > F.col("begins"), place)).over(Window.partitionBy("source", F.substring("draw", 1, BUCKET_DIGITS)))
    edges = rows.withColumn("last", last).where(place == F.col("last"))
    edges = edges.groupBy("source", place.alias("last")).agg(F.max("whole").alias("whole"), F.max("rest").alias("rest"), F.min("begins").alias("begins"), F.count("*").alias("ties"))
    edge = edges.groupBy("source").agg(F.max(F.struct("last", "whole", "rest", "begins", "ties")).alias("e"))
    # A source from which nothing is taken besides has no edge; its whole repetitions still count.
    wholes = rows.groupBy("source").agg(F.max("whole").alias("whole"))
    cuts = materialize(wholes.alias("w").join(edge.alias("e"), F.col("w.source").eqNullSafe(F.col("e.source")), "left").select(F.col("w.source").alias("cut_source"), "w.whole", F.col("e.e.last").alias("last"), (F.col("e.e.rest") - F.col("e.e.begins")).alias("left"), F.coalesce("e.e.ties", F.lit(0)).alias("ties")), "cuts")
    known = cuts if cuts.count() > MOST_SOURCES else F.broadcast(cuts)

    spread = df.select(F.struct(*df.columns).alias("row"), F.col("source").alias("own"), n_words(F.coalesce(F.col(text), F.lit(""))).alias("size"), F.struct(_drawn(F.col(key), seed).alias("draw"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_hash")).alias("place"))
    spread = spread.where(F.col("size") > 0).join(known, F.col("own").eqNullSafe(F.col("cut_source")))
    at_edge = F.coalesce(F.col("place") == F.col("last"), F.lit(False))
    whole_rows = F.coalesce(F.col("place") < F.col("last"), F.lit(False))
    if cuts.where("ties > 1").isEmpty():
        spread = spread.withColumn("extra", F.when(at_edge, _extra(F.col("size"), F.col("left"))).when(whole_rows, F.col("size")).otherwise(F.lit(0)))
    else:  # rows with one id and text at the edge are taken one after the other
        nth = F.row_number().over(Window.partitionBy("own", "place").orderBy("size")) - 1
        tied = spread.where(at_edge).withColumn("extra", _extra(F.col("size"), F.col("left") - nth * F.col("size")))
        spread = spread.where(~at_edge).withColumn("extra", F.when(whole_rows, F.col("size")).otherwise(F.lit(0))).unionByName(tied)
    cut = F.col("extra") < F.col("size")
    times = F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)
    spread = spread.withColumn("times", times.cast("int")).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    part = F.array_join(F.slice(F.filter(F.split(F.col(f"row.{text}"), GAP), lambda w: w != ""), F.lit(1), F.col("extra").cast("int")), " ")
    said = F.when((F.col("time") > F.col("whole")) & cut, part).otherwise(F.col(f"row.{text}"))
    return spread.select(*[said.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in df.columns])


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mix": op4_mix}
ORACLE = {
    "op4_mix": f"""
    WITH d AS (
      SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw, md5(coalesce(text, '')) AS text_hash,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CAST((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
    o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
          FROM w WINDOW before AS (ORDER BY 3.0 * source_size / weight, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT left_over, weight_left FROM o WHERE 3 * source_size * weight_left > left_over * weight ORDER BY weight_left DESC LIMIT 1),
    t AS (SELECT source, source_size, CASE WHEN 3 * source_size * o.weight_left <= o.left_over * weight THEN CAST(3 * source_size AS DOUBLE)
                 ELSE CAST(weight AS DOUBLE) * (CAST(l.left_over AS DOUBLE) / CAST(l.weight_left AS DOUBLE)) END AS target FROM o LEFT JOIN l ON true),
    p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
                 sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.text_hash, d.size ROWS UNBOUNDED PRECEDING) - d.size AS begins
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM p)
    SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, goal - whole * source_size - begins)) AS BIGINT) AS taken FROM q"""
}
