import os

import pytest

from shelfspark import storage


def test_small_inputs_are_dealt_and_others_left(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one")
    spark.range(1000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    out = storage.spread(df)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and sorted(r.id for r in out.collect()) == list(range(1000))
    monkeypatch.setattr(storage, "SMALL", 0)
    assert storage.spread(df) is df


def test_discarded_files_are_gone_and_no_others(spark):
    kept, gone = storage.materialize(spark.range(3), "kept"), storage.materialize(spark.range(3), "gone")
    paths = [os.path.dirname(df.inputFiles()[0].removeprefix("file://")) for df in (kept, gone)]
    storage.discard(gone, spark.range(1), gone)
    assert os.path.isdir(paths[0]) and not os.path.exists(paths[1]) and kept.count() == 3


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, otherwise: otherwise)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)
    Session.conf.get = staticmethod(lambda name, otherwise: "hdfs:///shared/")
    assert storage.shared_dir(Session) == "hdfs:///shared"
