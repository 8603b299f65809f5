"""The copy log as segments that are only ever added: an append writes its own lines, and a tail opens the newest segments that it needs.

A segment is a folder named seg-first-last-batch: the numbers of its lines, which go on from segment to segment, and the batch that brought the last of them. It is
written under another name and renamed, which is atomic. An append of a batch that is there already (or of an older one) changes nothing. Compaction joins
neighbours of one size class into one segment, whose wider range hides them until they are deleted, so that readers find every line once at any moment; and drops whole segments
that lie before the lines that are kept. One writer at a time, as a stream is.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import ranks
from shelfspark.operators.copylog import KEEP
from shelfspark.storage import discard, materialize

#: Segments of one size class that become one, and the factor from class to class.
TIER = 4


@dataclass(frozen=True, order=True)
class Segment:
    last: int
    first: int
    batch: int
    name: str

    @property
    def tier(self) -> int:
        return int(math.log(max(self.last - self.first + 1, 1), TIER))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _all(spark: SparkSession, log: str) -> list[Segment]:
    where, fs = _fs(spark, log)
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    parts = [(n, n.split("-")) for n in names if n.startswith("seg-")]
    return sorted(Segment(int(p[2]), int(p[1]), int(p[3]), n) for n, p in parts)


def segments(spark: SparkSession, log: str) -> list[Segment]:
    """The segments that count, oldest first: those that no wider one holds."""
    out: list[Segment] = []
    for s in sorted(_all(spark, log), key=lambda s: (s.first, -s.last)):
        if not out or s.last > out[-1].last:
            out.append(s)
    return out


def _put(df: DataFrame, log: str, first: int, last: int, batch: int) -> None:
    spark = df.sparkSession
    writing, fs = _fs(spark, f"{log}/_writing-{uuid.uuid4().hex}")
    df.write.parquet(writing.toString())
    if not fs.rename(writing, _fs(spark, f"{log}/seg-{first:018d}-{last:018d}-{batch:012d}")[0]):
        raise RuntimeError(f"batch {batch} can't be named in {log}")


def append(new: DataFrame, log: str, batch: int, order: list[Column]) -> bool:
    """Adds the lines of a batch in an order, numbered (seq) from where the log ends; whether it was new."""
    spark = new.sparkSession
    known = segments(spark, log)
    if known and batch <= max(s.batch for s in known):
        return False
    rows = materialize(ranks.numbered(new, order, "seq"), "lines")
    n, start = rows.count(), known[-1].last + 1 if known else 0
    if n:
        _put(rows.withColumn("seq", (F.col("seq") + (start - 1)).cast("bigint")), log, start, start + n - 1, batch)
    discard(rows)
    return True


def needed(known: list[Segment], n: int) -> list[Segment]:
    """The newest segments that hold the last n lines."""
    return [s for s in known if s.last > known[-1].last - n] if known and n > 0 else []


def tail(spark: SparkSession, log: str, n: int) -> DataFrame | None:
    """The last n lines, from the segments that hold them and no others; None if the log has none at all."""
    known = segments(spark, log)
    if not known:
        return None
    some = needed(known, n) or known[-1:]
    return spark.read.parquet(*[f"{log}/{s.name}" for s in some]).where(F.col("seq") > known[-1].last - n)


def compact(spark: SparkSession, log: str, keep: int | None = KEEP) -> list[Segment]:
    """Joins runs of TIER or more neighbours of one size class, drops segments before the last `keep` lines, deletes what nothing needs; what is left."""
    known = segments(spark, log)
    if keep is not None:
        known = needed(known, keep)
    run: list[Segment] = []
    joined: list[Segment] = []
    for s in [*known, None]:
        if run and (s is None or s.tier != run[-1].tier):
            if len(run) >= TIER:
                _put(spark.read.parquet(*[f"{log}/{x.name}" for x in run]), log, run[0].first, run[-1].last, run[-1].batch)
                joined += run
            run = []
        if s is not None:
            run.append(s)
    counts = segments(spark, log)
    if keep is not None:
        counts = needed(counts, keep)
    for s in _all(spark, log):
        if s not in counts:
            p, fs = _fs(spark, f"{log}/{s.name}")
            fs.delete(p, True)
    return segments(spark, log)
