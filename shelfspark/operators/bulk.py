"""Bulk jobs over many items that can be stopped after the item in hand and go on later, with a ledger of what became of each.

Items are dealt in waves; what a wave did is appended to the ledger when it ends, so that a job that is killed repeats one wave at most, and one that is cancelled repeats nothing:
tasks look for the mark of a cancellation in the shared folder before each item, finish the one they are at, and hand in what is done. A job only takes items that the
ledger doesn't have. While one runs, wishes for a refresh wait; they are merged, and given out once when it has ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import ranks
from shelfspark.shipping import ship
from shelfspark.sources.books import filesystem

#: Items of a wave, and outcomes that a task hands over at once.
WAVE, GATHERED = 10_000, 100


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _mark(spark: SparkSession, path: str, there: bool) -> None:
    p, fs = _fs(spark, path)
    fs.create(p, True).close() if there else fs.delete(p, False)


def _marked(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def cancel(spark: SparkSession, ledger: str) -> None:
    """Asks the job of a ledger to stop after the items that its tasks are at."""
    _mark(spark, f"{ledger}/cancelled", True)


def outcomes(spark: SparkSession, ledger: str, kind: str = "bigint") -> DataFrame:
    """id, ok and detail of the items that are done."""
    p, fs = _fs(spark, f"{ledger}/outcomes")
    waves = [x.getPath().toString() for x in fs.listStatus(p) if not x.getPath().getName().startswith("_")] if fs.exists(p) else []
    schema = f"id {kind}, ok boolean, detail string"
    return spark.read.schema(schema).parquet(*waves) if waves else spark.createDataFrame([], schema)


def run(items: DataFrame, act: Callable[[dict], str], ledger: str, wave: int = WAVE, waves: int | None = None) -> bool:
    """Does act on each item (id and what else it needs) that the ledger lacks, in order of ids; whether all are done.

    act gives the detail of what it did; what it raises as OSError or ValueError is the item's outcome and stops nothing. waves: how many at most, this time.
    """
    spark = items.sparkSession
    ship(spark)
    _mark(spark, f"{ledger}/cancelled", False)
    _mark(spark, f"{ledger}/running", True)
    kind = items.schema["id"].dataType.simpleString()
    flag = f"{ledger}/cancelled"

    def one(row: dict) -> tuple[bool, str]:
        try:
            return True, act(row)
        except (OSError, ValueError) as e:
            return False, str(e)

    def work(batches):
        source, name = filesystem(flag)
        done: list[tuple] = []
        put = lambda: pa.RecordBatch.from_arrays([pa.array([r["id"] for r, _ in done], ids), pa.array([o for _, (o, _) in done], pa.bool_()), pa.array([x for _, (_, x) in done], pa.string())], names=["id", "ok", "detail"])
        for batch in batches:
            ids = batch.schema.field("id").type
            for row in batch.to_pylist():
                if source.get_file_info(name).type.value:  # 0: not there
                    break
                done.append((row, one(row)))
                if len(done) == GATHERED:
                    yield put()
                    done = []
            if done:
                yield put()
                done = []

    try:
        todo = ranks.numbered(items.join(outcomes(spark, ledger, kind).select("id"), "id", "left_anti"), [F.col("id")], "nth")
        n = todo.count()
        many = -(-n // wave)
        for i in range(many if waves is None else min(many, waves)):
            if _marked(spark, flag):
                break
            some = todo.where(F.col("nth").between(i * wave + 1, (i + 1) * wave)).drop("nth")
            into, fs = _fs(spark, f"{ledger}/outcomes/_{uuid.uuid4().hex}")
            some.mapInArrow(work, f"id {kind}, ok boolean, detail string").write.parquet(into.toString())
            if not fs.rename(into, _fs(spark, f"{ledger}/outcomes/wave-{uuid.uuid4().hex}")[0]):
                raise RuntimeError(f"a wave can't be named in {ledger}")
        return not _marked(spark, flag) and (waves is None or waves >= many)
    finally:
        _mark(spark, f"{ledger}/running", False)


def wish(spark: SparkSession, ledger: str, place: str) -> None:
    """Asks for a refresh of a place; the same wish counts once."""
    _mark(spark, f"{ledger}/wishes/{place}", True)


def due(spark: SparkSession, ledger: str) -> list[str]:
    """The places that are to be refreshed now: those that were wished for, once, and none while a job runs."""
    if _marked(spark, f"{ledger}/running"):
        return []
    p, fs = _fs(spark, f"{ledger}/wishes")
    places = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
    for place in places:
        _mark(spark, f"{ledger}/wishes/{place}", False)
    return places
