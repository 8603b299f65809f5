"""A log in segments: every line once and in order, whatever is repeated, joined or stopped."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import segments as S


def lines(spark, start, n):
    return spark.range(start, start + n).select(F.col("id").alias("at"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title")).repartition(3)


def held(spark, log, n):
    got = S.tail(spark, log, n)
    return [] if got is None else [(r.seq, r.at) for r in got.orderBy("seq").collect()]


def test_appends_tails_and_compaction(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    assert S.segments(spark, log) == [] and held(spark, log, 5) == []
    for batch in range(6):
        assert S.append(lines(spark, 10 * batch, 10), log, batch, [F.col("at")])
    assert not S.append(lines(spark, 0, 10), log, 5, [F.col("at")]) and S.append(lines(spark, 0, 0), log, 6, [F.col("at")])
    assert held(spark, log, 25) == [(i, i) for i in range(35, 60)] and held(spark, log, 1000) == [(i, i) for i in range(60)]
    opened = S.tail(spark, log, 25).inputFiles()
    assert {f.split("/")[-2] for f in opened} == {s.name for s in S.segments(spark, log)[3:]}  # three of six
    assert [s.name for s in S.needed(S.segments(spark, log), 10)] == [S.segments(spark, log)[-1].name]

    real = S._fs
    monkeypatch.setattr(S, "_put", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        S.compact(spark, log)
    monkeypatch.undo()
    assert real is S._fs and held(spark, log, 1000) == [(i, i) for i in range(60)]
    (one,) = S.compact(spark, log)
    assert (one.first, one.last, one.batch) == (0, 59, 5) and held(spark, log, 7) == [(i, i) for i in range(53, 60)]
    assert not S.append(lines(spark, 0, 10), log, 3, [F.col("at")])
    S.append(lines(spark, 60, 3), log, 7, [F.col("at")])
    assert [(s.first, s.last) for s in S.compact(spark, log, keep=2)] == [(60, 62)]  # whole segments go; the tail is exact
    assert held(spark, log, 2) == [(61, 61), (62, 62)]


def test_a_join_that_stops_before_its_parts_are_deleted_hides_them(spark, tmp_path):
    log = str(tmp_path / "log")
    for batch in range(4):
        S.append(lines(spark, 4 * batch, 4), log, batch, [F.col("at")])
    S._put(spark.read.parquet(*[f"{log}/{s.name}" for s in S.segments(spark, log)]), log, 0, 15, 3)
    assert len(S._all(spark, log)) == 5 and len(S.segments(spark, log)) == 1 and held(spark, log, 100) == [(i, i) for i in range(16)]
    S.compact(spark, log)
    assert len(S._all(spark, log)) == 1
