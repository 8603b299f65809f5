"""No task is given more bytes than the budget, or one file."""

import random

import pyarrow as pa

from shelfspark.sources import books, packing


def test_packs_stay_within_the_budget(spark):
    rng = random.Random(1)
    rows = [(f"p{i:04}", rng.choice([0, 10, 3000, 90_000, 400_000, 5_000_000])) for i in range(900)] + [(None, 5), ("p0001", None)]
    for budget in (400_000, 3_000_000, 10**9):
        got = packing.packs(spark.createDataFrame(rows, "path string, length bigint").repartition(7), budget).collect()
        claims: dict[int, list[int]] = {}
        for r in got:
            claims.setdefault(r.pack, []).append(max(3 * (r.length or 0), packing.LEAST))
        assert len(got) == len(rows) and sorted(claims) == list(range(len(claims)))
        assert all(sum(c) <= budget or len(c) == 1 for c in claims.values())
        full = [sum(c) for c in claims.values() if len(c) > 1]
        assert sum(full) >= 0.3 * budget * len(full) or len(full) < 2  # few packs, too


def test_a_skewed_folder_is_dealt_by_bytes(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i:02}.cbz").write_bytes(b"x" * (400_000 if i < 3 else 20_000))
    todo = books.book_files(books.listing(spark, str(tmp_path)))
    dealt = packing.packed(todo.select("path", "below", "length", "format"), 500_000)

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(sum(b.column("length").to_pylist()) for b in batches)])], names=["bytes"])

    held = [r.bytes for r in dealt.mapInArrow(run, "bytes bigint").collect()]
    assert sum(held) == 3 * 400_000 + 37 * 20_000 and max(held) == 400_000 and sorted(held)[-4] * 3 <= 500_000
    assert books.read(spark, str(tmp_path), todo).count() == 40
    assert packing.packed(todo.where("false"), 500_000).count() == 0
