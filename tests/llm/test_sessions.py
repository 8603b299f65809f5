"""Versions of sessions against a plain loop over batches and against SQL."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import sessions
from tests.oracle import assert_same, connect

SCHEMA = "user bigint, seconds bigint, batch bigint, h bigint"


def plainly(events, gap):
    out, users = [], defaultdict(list)
    for user, *rest in events:
        users[user].append(rest)
    for user, rows in users.items():
        standing = []
        for b in sorted({r[1] for r in rows}):
            runs = []
            for r in sorted(r for r in rows if r[1] <= b):
                if runs and r[0] - runs[-1][-1][0] <= gap:
                    runs[-1].append(r)
                else:
                    runs.append([r])
            for run in runs:
                if any(r[1] == b for r in run):
                    start, end = run[0][0], run[-1][0]
                    gone = [v for v in standing if v[2] >= start and v[3] <= end]
                    for v in gone:
                        standing.remove(v)
                        v[8:] = [b, start]
                    v = [user, b, start, end, len(run), sum(r[1] == b for r in run), len(gone), sum(r[2] for r in run), None, None]
                    standing.append(v)
                    out.append(v)
    return sorted(map(tuple, out), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("gap", "width", "chunk", "late"), [(600, 900, 16, (0, 3)), (600, 900, 1, (0, 0)), (600, 900, 4, (-1, 2)), (30, 10, 3, (0, 6)), (5, 10, 2, (0, 3))])
def test_versions_are_those_of_a_loop_over_batches(spark, gap, width, chunk, late):
    rng = random.Random(gap * chunk)
    events = []
    for user in range(6):
        span, n = width * (3, 30, 120)[user % 3], rng.choice([3, 60, 400])
        for _ in range(n):
            s = rng.randrange(span) - span // 4
            events.append((user, s, s // width + rng.randint(*late), rng.randrange(1000)))
    df = spark.createDataFrame(events, SCHEMA)
    want = plainly(events, gap)
    assert rows(sessions.versions(df, gap, width, late, chunk)) == want
    assert rows(sessions.versions(df, gap, width, None, chunk)) == want  # the span is measured


def test_a_user_without_pause_is_dealt_over_chunks(spark):
    """One session over 2,000 batches: every chunk gets what stands before it as one struct."""
    df = spark.range(6000).select(F.lit(1).cast("bigint").alias("user"), (F.col("id") * 300).alias("seconds"), F.floor(F.col("id") / 3).alias("batch"), F.lit(1).cast("bigint").alias("h"))
    got = sessions.versions(df, late=(0, 0)).orderBy("batch").collect()
    assert [(r.batch, r.start_s, r.n_events, r.n_new, r.n_retracted, r.h_sum, r.retracted_batch) for r in got] == [(b, 0, 3 * b + 3, 3, int(b > 0), 3 * b + 3, b + 1 if b < 1999 else None) for b in range(2000)]
    found = sessions.pieces(df)
    widest = found.groupBy(F.floor(F.col("step") / sessions.CHUNK)).count().agg(F.max("count")).first()[0]
    assert widest <= sessions.CHUNK


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sessions.versions(empty).collect() == []
    df = spark.createDataFrame([(1, 10, 0, 5), (1, 10, 0, 5), (1, 10, 0, None), (None, 10, 0, 5), (1, None, 0, 5), (1, 10, None, 5)], SCHEMA)
    df = df.select(*df.columns, F.lit("x").alias("chunk"), F.lit(1).alias("batch_"), F.lit(2).alias("start"))
    assert rows(sessions.versions(df)) == [(1, 0, 10, 10, 3, 3, 0, 10, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, None, "user", "x"), (None, 3, None, None), (-3, 2, "", "")], "conv_id bigint, turn bigint, role string, text string")
    assert sorted(r.user // 2 for r in sessions.versions(sessions.conversation_events(turns)).collect()) == [-1, 0]


def test_it_runs_no_python(spark, small):
    plan = sessions.op12_sessions(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_conversations_against_sql(spark, small):
    assert_same(sessions.op12_sessions(spark, small), connect(small), sessions.ORACLE["op12_sessions"])
