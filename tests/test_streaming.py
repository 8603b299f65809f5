"""What is kept by batches: buckets that split, stale rows, and books that stay resolved."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfspark.streaming import buckets, catalogue, places, resolution
from tests.test_ends import COPY, a_copy


def test_an_older_row_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(list(x), COPY)
    seen = lambda: {r.path: (r.copy_id, r.seen) for r in catalogue.copies(spark, table).collect()}
    catalogue.upsert(rows(a_copy(1, path="a", seen=9), a_copy(2, path="b", seen=5)), 0, table)
    catalogue.upsert(rows(a_copy(3, path="a", seen=2), a_copy(4, path="b", seen=5), a_copy(5, path="c", seen=1)), 1, table)
    assert seen() == {"a": (1, 9), "b": (4, 5), "c": (5, 1)}
    catalogue.upsert(rows(a_copy(1, path="a", seen=10, gone=True)), 2, table)
    catalogue.upsert(rows(a_copy(1, path="a", seen=9)), 3, table)  # older than its going
    assert seen() == {"b": (4, 5), "c": (5, 1)}
    catalogue.upsert(rows(a_copy(1, path="a", seen=11)), 4, table)
    assert seen()["a"] == (1, 11)


def test_buckets_split_and_stay_bounded(spark, tmp_path):
    root = str(tmp_path / "t")
    for version in range(5):
        rows = spark.range(version * 4000, (version + 1) * 4000).select("id", (F.col("id") * 2).alias("x"))
        gone = spark.range(version * 100).select("id")
        buckets.apply(spark, root, version, {"t": buckets.Change(["id"], gone, rows)}, most=150)
    _, tables = buckets.current(spark, root)
    assert max(tables["t"]["rows"].values()) <= 300 and len({b.split("-")[0] for b in tables["t"]["rows"]}) > 1
    got = {r.id: r.x for r in buckets.read(spark, root, "t").collect()}
    assert got == {i: 2 * i for i in range(20_000) if i >= 400}
    assert sum(tables["t"]["rows"].values()) == len(got)
    covered = sum(2.0 ** -int(b.split("-")[0]) for b in tables["t"]["rows"])
    assert covered == 1.0
    seen = set()
    found = buckets.lookup(spark.createDataFrame([(500,), (3,), (10**6,)], "id bigint"), root, tables["t"], seen)
    assert [r.id for r in found.collect()] == [500] and len(seen) <= 3
    before = buckets.current(spark, root)
    buckets.apply(spark, root, 4, {"t": buckets.Change(["id"], spark.range(10**5).select("id"), rows)})  # is there already
    assert buckets.current(spark, root) == before


def test_nothing_changes_before_the_name(spark, tmp_path):
    root = str(tmp_path / "t")
    change = lambda a, b: {"t": buckets.Change(["id"], spark.range(0), spark.range(a, b)), "u": buckets.Change(["id"], spark.range(0), spark.range(a, b))}
    buckets.apply(spark, root, 0, change(0, 5))

    def stopped(*_):
        raise OSError("stopped")

    with pytest.raises(OSError):
        buckets.apply(spark, root, 1, change(5, 9), stopped)
    assert buckets.read(spark, root, "t").count() == buckets.read(spark, root, "u").count() == 5
    buckets.apply(spark, root, 1, change(5, 9))
    assert buckets.read(spark, root, "t").count() == buckets.read(spark, root, "u").count() == 9


def copies(spark, rows):
    """rows: copy_id, path, sha, resources, seen, gone."""
    whole = [(i, "Local", 0, path, "epub", f"T{i}", "A", None, None, sha, res, None, 5, False, seen, gone) for i, path, sha, res, seen, gone in rows]
    return spark.createDataFrame(whole, COPY)


def plainly(rows):
    """The smallest copy that each is joined to by shared content, in plain loops."""
    keys = {r[0]: {("s", r[2]), ("r", r[3])} - {("r", None)} if r[2] else set() for r in rows}
    label = {i: i for i in keys}
    while True:
        new = {i: min(label[j] for j in keys if i == j or keys[i] & keys[j]) for i in keys}
        if new == label:
            return label
        label = new


def test_books_stay_resolved(spark, tmp_path):
    """Random inserts, changes, deletions and late answers: after each batch the same as full resolution of what is there."""
    rng, root, held = random.Random(8), str(tmp_path / "r"), {}
    for batch in range(20):
        rows = {}
        for _ in range(rng.choice([1, 3, 12])):
            n = rng.randrange(60)
            seen = batch + rng.choice([0, 0, 0, -3])
            rows[f"p{n}"] = (n, f"p{n}", rng.choice(["", f"s{rng.randrange(25)}", f"u{n}"]), rng.choice([None, f"r{rng.randrange(25)}"]), seen, rng.random() < 0.3)
        for path, r in rows.items():
            if path not in held or r[4] >= held[path][4]:
                held[path] = r
        resolution.upsert(copies(spark, rows.values()), batch, root, most=20)
        there = [r for r in held.values() if not r[5]]
        want = plainly(there)
        assert {r.copy_id: r.book_id for r in resolution.resolved(spark, root).collect()} == want, batch
    resolution.upsert(copies(spark, [(1, "p1", "x", None, 99, False)]), 19, root)  # that batch is in already
    assert {r.copy_id: r.book_id for r in resolution.resolved(spark, root).collect()} == want
    assert {r.book_id for r in resolution.books(spark, root).collect()} == set(want.values())


def test_a_batch_looks_only_where_it_must(spark, tmp_path):
    """600 books of two copies; a third copy of one reads a bucket of each table, and a large component that it joins is not taken apart."""
    root = str(tmp_path / "r")
    rows = [(i, f"p{i}", f"s{i // 2}", None, 1, False) for i in range(1200)] + [(5000 + i, f"q{i}", "hot", None, 1, False) for i in range(300)]
    resolution.upsert(copies(spark, rows), 0, root, most=50)
    read = resolution.upsert(copies(spark, [(9000, "new", "s7", None, 2, False)]), 1, root, most=50)
    assert {t: len(b) for t, b in read.items()} == {"places": 1, "members": 0, "keys": 1}
    read = resolution.upsert(copies(spark, [(9001, "newer", "hot", "r", 2, False), (9002, "last", "z", "r", 2, False)]), 2, root, most=50)
    assert len(read["members"]) == 0
    got = {r.copy_id: r.book_id for r in resolution.resolved(spark, root).collect()}
    assert (got[9000], got[9001], got[9002], got[5299]) == (14, 5000, 5000, 5000)
    read = resolution.upsert(copies(spark, [(9000, "new", "s7", None, 3, True)]), 3, root, most=50)
    assert len(read["members"]) == 1 and len(read["keys"]) == 0


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Handle:
    """One key's state and timers, as a stream keeps them."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_snapshots_of_a_place(spark):
    handle, place = Handle(), places.Places(200)
    place.init(handle)

    def arrive(now, *reports):
        rows = pd.DataFrame(list(reports), columns=["operation", "event", "seq"])
        return [tuple(r) for df in place.handleInputRows(("Kobo",), iter([rows, rows.iloc[:0]]), Clock(now)) for r in df[["operation", "state", "inventory", "rows", "forced"]].astype(object).where(df[["operation", "state", "inventory", "rows", "forced"]].notna(), None).values.tolist()]

    def due(now):
        handle.timers = [t for t in handle.timers if t > now]
        return [r for df in place.handleExpiredTimer(("Kobo",), Clock(now), None) for r in df["rows"].tolist()]

    assert arrive(1000, (1, "started", 1)) == [(1, "Checking", None, 0, False)]  # the first at once
    assert arrive(1050, (1, "row", 2), (1, "row", 3)) == [] and arrive(1100, (1, "row", 4)) == []
    assert handle.timers == [1200] and due(1200) == [3]  # one in 200 ms, by the timer
    assert arrive(1210, (1, "row", 5)) == [] and handle.timers == [1400]
    assert arrive(1220, (1, "finished", 6)) == [(1, "Ready", 1, 4, True)]  # the last by force
    assert due(1400) == []  # nothing waited any more
    assert arrive(1500, (2, "started", 7)) == [(2, "Checking", 1, 0, False)]  # the inventory stays
    assert arrive(1800, (1, "row", 8), (1, "unavailable", 9), (2, "row", 10)) == [(2, "Checking", 1, 1, False)]  # what is late doesn't count
    assert arrive(1850, (2, "unavailable", 12)) == [(2, "Unavailable", 1, 1, True)]
    assert arrive(1900, (2, "not connected", 11)) == []  # came later, was said earlier


def test_order_of_reports_does_not_matter():
    rng = random.Random(3)
    reports = [(rng.randrange(4), rng.choice(["row", "started", *places.ENDS]), i) for i in range(200)]
    ends = set()
    for _ in range(20):
        rng.shuffle(reports)
        state = None
        for i in range(0, 200, 17):
            state, *_ = places.merged(state, pd.DataFrame(reports[i : i + 17], columns=["operation", "event", "seq"]))
        ends.add(state)
    # Rows of the latest operation count from when it is heard of; those are all of them.
    assert len(ends) == 1 and ends.pop()[4] == sum(o == 3 and e == "row" for o, e, _ in reports)
