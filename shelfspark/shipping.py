"""Brings the package to executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Bytes that an Arrow batch may have on its way to Python; rows and bytes of what is made there before it is handed on.
BATCH_BYTES, MOST_ROWS, MOST_BYTES = 8 << 20, 2000, 1 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's source to the Python workers, once for each application, and bound this session's Arrow batches."""
    bounded(spark)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="shelfspark-")) / "shelfspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"shelfspark/{p.relative_to(top)}")
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES in this session, if no smaller ones are set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    units = {"k": 10, "m": 20, "g": 30}
    size = int(now[:-1]) << units[now[-1]] if now[-1] in units else int(now)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def in_batches(rows: Iterable[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of rows (each with the bytes it came from or holds): neither one for every row nor one for all of them."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if len(held) >= MOST_ROWS or size >= MOST_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
