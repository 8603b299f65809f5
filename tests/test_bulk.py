"""Jobs that stop after the item in hand and go on without repeating one."""

import os
import threading
import time

from pyspark.sql import functions as F

from shelfspark.operators import bulk


def test_a_cancelled_job_goes_on_where_it_stopped(spark, tmp_path):
    ledger, traces = str(tmp_path / "ledger"), tmp_path / "traces"
    traces.mkdir()
    folder = str(traces)

    def act(row):
        with open(f"{folder}/{row['id']}", "a") as f:
            f.write("x")
        time.sleep(0.05)
        if row["id"] % 10 == 3:
            raise OSError("the card is full")
        return f"{row['size']} bytes"

    items = spark.range(120).select("id", (F.col("id") * 2).alias("size")).repartition(4)
    stopper = threading.Thread(target=lambda: (wait(traces, 10), bulk.cancel(spark, ledger)))
    stopper.start()
    assert not bulk.run(items, act, ledger, wave=60)
    stopper.join()
    done = {r.id for r in bulk.outcomes(spark, ledger).collect()}
    assert 10 <= len(done) < 120 and done == {int(n) for n in os.listdir(traces)}  # what was begun is in the ledger
    assert bulk.run(items, act, ledger, wave=60)
    got = {r.id: (r.ok, r.detail) for r in bulk.outcomes(spark, ledger).collect()}
    assert got == {i: (False, "the card is full") if i % 10 == 3 else (True, f"{2 * i} bytes") for i in range(120)}
    assert all(os.path.getsize(traces / n) == 1 for n in os.listdir(traces))  # no item twice
    assert bulk.run(items, act, ledger) and all(os.path.getsize(traces / n) == 1 for n in os.listdir(traces))


def wait(folder, n):
    until = time.monotonic() + 60
    while len(os.listdir(folder)) < n and time.monotonic() < until:
        time.sleep(0.02)


def test_refreshes_wait_and_are_merged(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    for place in ("Kobo", "Local", "Kobo"):
        bulk.wish(spark, ledger, place)
    bulk._mark(spark, f"{ledger}/running", True)
    assert bulk.due(spark, ledger) == []
    bulk._mark(spark, f"{ledger}/running", False)
    assert bulk.due(spark, ledger) == ["Kobo", "Local"] and bulk.due(spark, ledger) == []
    empty = spark.createDataFrame([], "id string")
    assert bulk.run(empty, str, ledger) and bulk.outcomes(spark, ledger, "string").count() == 0
