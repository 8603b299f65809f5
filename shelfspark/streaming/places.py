"""What places report while they are scanned, kept as state by place: snapshots as a person sees them.

Reports (place, operation, event, seq) arrive in any order. Operations count up, and only the reports of a place's latest one make its state, so that the late
answer of an older one never does. A snapshot of a place is emitted at once when an operation is first heard of and when it ends (finished, unavailable or not connected),
and otherwise at most once in `every` milliseconds: what changes in the meantime waits for a timer in processing time. The last snapshot of each
place is what catalogue.states() says of all reports.

The state of a place is one row of fixed size, whatever its reports are; a report that comes twice with the same batch is Spark's to drop (by the checkpoint). Reports
without a place, operation or event are left out.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

EVERY = 200
ENDS = {"finished": "Ready", "unavailable": "Unavailable", "not connected": "Not connected"}
SNAPSHOT = "place string, operation bigint, state string, inventory bigint, rows bigint, version bigint, forced boolean"
_STATE = "operation bigint, end_seq bigint, end_event string, inventory bigint, rows bigint, version bigint, emitted bigint, waiting boolean"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged(state: tuple | None, reports: pd.DataFrame) -> tuple[tuple, bool, bool]:
    """The state with reports taken in, whether an operation is first heard of, and whether one has ended; the order of reports doesn't matter."""
    operation, end_seq, end_event, inventory, rows, version, emitted, waiting = state or (None, None, None, None, 0, 0, None, False)
    latest = int(reports.operation.max())
    first, ended = operation is None or latest > operation, False
    if first:
        operation, end_seq, end_event, rows = latest, None, None, 0
    own = reports[reports.operation == operation]
    rows += int((own.event == "row").sum())
    ends = own[own.event.isin(list(ENDS))]
    if len(ends):
        last = ends.loc[ends.seq.idxmax()]
        if end_seq is None or last.seq > end_seq:
            end_seq, end_event, ended = int(last.seq), str(last.event), True
    whole = reports.operation[reports.event == "finished"]
    if len(whole) and (inventory is None or whole.max() > inventory):
        inventory, ended = int(whole.max()), True
    return (operation, end_seq, end_event, inventory, rows, version, emitted, waiting), first, ended


class Places(StatefulProcessor):
    def __init__(self, every: int = EVERY):
        self.every = every

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("place", _STATE)

    def _emit(self, key: tuple, state: tuple, now: int, forced: bool) -> pd.DataFrame:
        operation, _, end_event, inventory, rows, version, *_ = state
        self.state.update((*state[:5], version + 1, now, False))
        row = {"place": [key[0]], "operation": [operation], "state": [ENDS.get(end_event, "Checking")], "inventory": pd.array([inventory], dtype="Int64"), "rows": [rows], "version": [version + 1], "forced": [forced]}
        return pd.DataFrame(row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        first = ended = False
        for reports in rows:
            if len(reports):
                state, new, end = merged(state, reports)
                first, ended = first or new, ended or end
        if state is None:
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        if first or ended or state[6] is None or now - state[6] >= self.every:
            yield self._emit(key, state, now, ended)
        else:
            if not state[7]:
                self.handle.registerTimer(state[6] + self.every)
            self.state.update((*state[:7], True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        if state is not None and state[7]:  # else something was emitted meanwhile
            yield self._emit(key, state, timerValues.getCurrentProcessingTimeInMs(), False)

    def close(self) -> None:
        pass


def snapshots(reports: DataFrame, every: int = EVERY) -> DataFrame:
    """A stream of snapshots from a stream of reports."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # a stream's first worker has no shipped source
    known = reports.where("place IS NOT NULL AND operation IS NOT NULL AND event IS NOT NULL")
    rows = known.select("place", F.col("operation").cast("bigint").alias("operation"), "event", F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("seq"))
    return rows.groupBy("place").transformWithStateInPandas(Places(every), SNAPSHOT, "Append", "ProcessingTime")


def follow(reports: DataFrame, into: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Writes the snapshots of a stream of reports as Parquet; it goes on until it is stopped."""
    spark = reports.sparkSession
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)  # the store that this kind of state needs; a query keeps the one it started with
    try:
        writer = snapshots(reports, every).writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint)
        return writer.trigger(processingTime="0 seconds").start()
    finally:
        spark.conf.set(_ROCKS[0], before) if before else spark.conf.unset(_ROCKS[0])


def stopped(query: StreamingQuery, rows: int, every: int = EVERY, most: float = 600) -> None:
    """Waits until a query has taken so many rows and all of its timers are due, and stops it."""
    taken, due, until = {}, None, time.monotonic() + most
    while time.monotonic() < until:
        if query.exception() is not None:
            raise query.exception()
        for p in query.recentProgress:
            taken[p["batchId"]] = max(taken.get(p["batchId"], 0), p["numInputRows"])
        if sum(taken.values()) >= rows:
            due = due or (time.time() * 1000 + every, max(taken))
            # Two batches that began after the last timer was due.
            if time.time() * 1000 > due[0] and max(taken) >= due[1] + 3:
                break
        time.sleep(0.1)
    else:
        raise TimeoutError(f"{sum(taken.values())} of {rows} reports were taken")
    query.stop()


def latest(written: DataFrame) -> DataFrame:
    """The last snapshot of each place."""
    order = Window.partitionBy("place").orderBy(F.col("version").desc())
    return written.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
