"""Lists of pages by doubling: order, limit, loops, ends and odd links."""

import random

from pyspark.sql import functions as F

from shelfspark.sources import opds


def made(spark, links):
    return spark.createDataFrame(links, "address string, next string")


def plainly(links, start, most):
    there = {}
    for a, n in links:
        if a is not None and (a not in there or n is not None and (there[a] is None or n < there[a])):
            there[a] = n
    out, at = [], start
    while at in there and at not in out and len(out) < max(most, 1):
        out.append(at)
        at = there[at]
    return out


def test_pages_are_those_of_a_walk(spark):
    rng = random.Random(2)
    for n, most in ((1, 5), (7, 3), (40, 1000), (33, 32), (17, 16), (12, 0)):
        names = [f"p{i}" for i in range(n)]
        rng.shuffle(names)
        links = [(a, b) for a, b in zip(names, names[1:] + [rng.choice([None, "elsewhere", names[n // 3]])], strict=True)]
        links += [("other", names[0]), (None, names[-1]), (names[-1], None)]
        rng.shuffle(links)
        assert opds.pages(made(spark, links), names[0], most) == plainly(links, names[0], most)
    assert opds.pages(made(spark, [("a", "b")]), "none", 9) == [] and opds.pages(made(spark, [("a", "a")]), "a", 9) == ["a"]


def test_ten_thousand_pages_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = opds.materialize
    monkeypatch.setattr(opds, "materialize", lambda df, label: rounds.append(label) or real(df, label))
    n = 10_000
    links = spark.range(n).select(F.format_string("p%d", "id").alias("address"), F.format_string("p%d", F.col("id") + 1).alias("next")).repartition(4)
    got = opds.page_numbers(links, "p0").agg(F.count("*"), F.sum((F.concat(F.lit("p"), F.col("page").cast("string")) == F.col("address")).cast("int"))).first()
    assert tuple(got) == (n, n) and rounds.count("jumps") <= 15
