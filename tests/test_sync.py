"""Rows that are taken in order unless one of their keys is: against a plain fold, on chains and hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import sync

SCHEMA = "id bigint, order bigint, key string"


def plainly(rows):
    keys, held, out = {}, set(), []
    for i, order, key in rows:
        keys.setdefault((order, i), set()).add(key)
    for (_, i), own in sorted(keys.items()):
        if held.isdisjoint(own):
            held |= own
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize(("rounds", "most"), [(2, 200_000), (0, 20), (1, 7)])
def test_first_come_is_a_plain_fold(spark, rounds, most):
    rng = random.Random(most)
    rows = []
    for i in range(150):
        order = rng.randrange(10**6)
        rows += [(i, order, f"k{rng.randrange(140)}") for _ in range(rng.choice([1, 1, 2, 3]))]
    rows += [(1000 + i, 10**7 + (i * 37) % 50, "hot") for i in range(50)] + [(2000, 5, "alone")]
    df = spark.createDataFrame(sorted(set(rows)), SCHEMA)
    assert sorted(r.id for r in sync.first_come(df, rounds, most).collect()) == plainly(rows)


def test_a_long_chain_takes_few_jobs(spark):
    """Every second link of a chain of 100,000 rows is taken, in jobs that its length doesn't multiply."""
    n = 100_000
    ends = spark.range(n).select("id", F.col("id").alias("order"), F.explode(F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string"))).alias("key"))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = sync.first_come(ends)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    out = got.agg(F.count("*"), F.sum("id"), F.max(F.col("id") % 2)).first()
    assert tuple(out) == (n // 2, n // 2 * (n // 2 - 1), 0) and jobs < 1000
