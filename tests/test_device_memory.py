"""Databases of devices are filled and read in parts, whatever their size, and a volume with many marks is no one device's."""

import sqlite3

import pyarrow as pa

from shelfspark import shipping
from shelfspark.plans import files
from shelfspark.sources import device_db
from tests.test_batches import Held


def test_rows_of_a_database_go_on_in_parts(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE Bookmark (VolumeID TEXT, Text TEXT)")
    db.executemany("INSERT INTO Bookmark VALUES (?, ?)", [(str(i), "x" * 100) for i in range(20_001)])
    db.commit()
    batch = pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [db.serialize()] * 2})
    got = device_db.tables(Held(spark, batch), "Bookmark")
    assert max(b.num_rows for b in got) <= shipping.MOST_ROWS and sum(b.num_rows for b in got) == 40_002
    assert got[0].column("Text")[0].as_py() == "x" * 100 and got[0].column("Hidden")[0].as_py() is None


def test_a_volume_of_many_marks_is_dealt(spark, tmp_path, small, monkeypatch):
    monkeypatch.setattr(files, "DEVICE_ROWS", 300)
    for name in ("part", "region", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    spark.range(6000).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text").write.parquet(str(tmp_path / "conversations.parquet"))
    made = files.databases(spark, str(tmp_path))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    sizes, rows = {}, []
    for r in made.collect():
        assert r.path not in sizes
        db = sqlite3.connect(":memory:")
        db.deserialize(bytes(r.content))
        own = db.execute("SELECT VolumeID, Text FROM Bookmark").fetchall()
        sizes[r.path], rows = len(own), rows + own
    assert sorted(rows) == sorted(("7", f"  t{i} ") for i in range(6000))
    assert max(sizes.values()) < 2 * 6000 / len(sizes)
