"""Files dealt to tasks by bytes: no task is given more than a budget, but a file that is larger alone.

A file claims three times its listed length while it is read (its bytes, what it unpacks to and what is made of it), and a little at least. In order of paths, claims
up to half of the budget are summed up and cut at equal targets of half a budget, so that no pack goes over the budget; larger ones
are packs of their own. Sums are those of ranges first (a row for each) and then of rows within them: nothing is gathered but listed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.storage import materialize

#: Bytes that are claimed at once by a task, times the length that a file claims, and what it claims at least.
BUDGET, TIMES, LEAST = 384 << 20, 3, 64 << 10


def claim(length: str = "length"):
    return F.greatest(F.coalesce(F.col(length), F.lit(0)) * TIMES, F.lit(LEAST)).cast("bigint")


def packs(files: DataFrame, budget: int = BUDGET, path: str = "path", length: str = "length") -> DataFrame:
    """files (listed rows, no content) with pack, from 0: which of them one task reads. Null paths come first."""
    half = budget // 2
    order = [F.col(path).asc_nulls_first(), F.col(length)]
    placed = files.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    rows = materialize(placed, "listed").withColumn("__part", F.shiftright("__place", 33)).withColumn("__claim", claim(length))
    small, large = F.when(F.col("__claim") <= half, F.col("__claim")).otherwise(0), (F.col("__claim") > half).cast("bigint")
    before, whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # a row for each range
    parts = rows.groupBy("__part").agg(F.sum(small).alias("small"), F.sum(large).alias("large"))
    n_small = F.ceil(F.sum("small").over(whole) / half)
    parts = parts.select("__part", F.coalesce(F.sum("small").over(before), F.lit(0)).alias("__small"), F.coalesce(F.sum("large").over(before), F.lit(0)).alias("__large"), n_small.alias("__first"))
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(parts), "__part")
    to_here, nth = F.col("__small") + F.sum(small).over(inside), F.col("__large") + F.sum(large).over(inside)
    pack = F.when(F.col("__claim") > half, F.col("__first") + nth - 1).otherwise(F.floor((to_here - 1) / half))
    return rows.withColumn("pack", pack.cast("bigint")).select(*files.columns, "pack")


def packed(files: DataFrame, budget: int = BUDGET, path: str = "path", length: str = "length") -> DataFrame:
    """files with each pack a partition of its own; if all of them claim less than one task may, over all cores."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    total = files.agg(F.sum(claim(length))).first()[0] or 0
    if total <= budget:
        return files.repartition(cores)
    found = materialize(packs(files, min(budget, max(total // (2 * cores), 2 * LEAST)), path, length), "packs")
    last = found.agg(F.max("pack")).first()[0]
    return found.repartitionById(last + 1, F.col("pack").cast("int")).drop("pack")
