"""Held-out documents by recall, precision and rank; near copies; columns that clash."""

import os

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import toxicity


def test_held_out_recall_precision_and_rank(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    got = toxicity.op10_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("toxic", "predicted", "score").collect()
    yes, no = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert len(yes) > 50 and len(no) > 200
    caught, wrong = sum(r.predicted for r in yes), sum(r.predicted for r in no)
    assert caught / len(yes) >= 0.85 and caught / (caught + wrong) >= 0.95
    order = sorted(r.score for r in no)
    import bisect

    rank = sum(bisect.bisect_left(order, r.score) + (bisect.bisect_right(order, r.score) - bisect.bisect_left(order, r.score)) / 2 for r in yes) / len(yes) / len(no)
    assert rank >= 0.93


def test_only_near_copies_count_once(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [" ".join(base)] * 5 + [" ".join([*base[:150], *(f"x{k}.{i}" for i in range(350))]) for k in range(40)]  # the latter share a fifth or so with each other
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    known = [i for i in range(len(rows)) if __import__("zlib").crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in known], "doc_id bigint, quality int, toxic int")
    kept = [r.text for r in toxicity.training(labels, df).collect()]
    assert sum(t == rows[0] for t in kept) == 1 and len(kept) >= 0.9 * sum(i >= 5 for i in known)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some bad words", "a", 3)], "doc_id bigint, text string, passages string, score int")
    out = toxicity.score(df, toxicity.Model({"bad ": 4.0}, log_k=-5.0))
    assert sorted(out.columns) == ["doc_id", "passages", "score", "text"] and isinstance(out.first().score, float) and F is not None
