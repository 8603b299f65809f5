"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.shipping import ship
from shelfspark.storage import materialize, shared_dir, spread  # noqa: F401

#: One or more of the six ASCII white-space characters; words are what stands between.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Text that an Arrow batch is cut into before it is worked on, so that memory does not follow the batch.
SLICE_BYTES = 1 << 20
#: Arrow data that Spark hands over at once; rows are never cut.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with at most so many bytes of text or a single row."""
    column = batch.column(text)
    ends = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64))
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        before, start = int(ends[stop - 1]), stop


def trim() -> None:
    """Gives memory that is free back to the system: idle workers stay, and others share the executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """The function for mapInArrow, with trim() when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors and bound the size of Arrow batches in this session."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    units = {"k": 10, "m": 20, "g": 30}
    size = int(now[:-1]) << units[now[-1]] if now[-1] in units else int(now)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def with_arrow(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable], keep: list[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """Add columns that Python computes from slices of Arrow batches.

    make() runs once a task and returns compute(batch) -> one Arrow array for each of fields; if compute has a function
    close, it runs when the task ends, for workers live on and would keep what they remember.
    keep: the columns that stay (all by default); one that has the name of a new column is replaced.
    """
    new = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    names = [f.name for f in kept]
    schema = T.StructType(kept + fields)
    read = df.select(*dict.fromkeys([*names, text]))
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        try:
            for batch in batches:
                for part in slices(batch, text, most):
                    columns = [part.column(n) for n in names]
                    yield pa.RecordBatch.from_arrays(columns + list(compute(part)), names=names + new)
        finally:
            getattr(compute, "close", lambda: None)()

    return read.mapInArrow(trimmed(run), schema)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str | None]:
    return batch.column(text).to_pylist()


def bytes_of(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column and the offsets of its rows in them; null is empty."""
    column = batch.column(text)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]
