"""The catalogue kept up to date from a stream of listed copies.

Batches of copies arrive as files. Each is upserted by (place, path) into a versioned table of copies in buckets (streaming/buckets.py): only the buckets that
a batch touches are written anew. A row is taken unless what is held was seen later, so that a late answer changes nothing; copies that are gone
stay as marks of when they were seen last. Places are independent: what one reports does not touch the rows of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators import resolve as R
from shelfspark.streaming import buckets

manifests = buckets.manifests
_name = buckets.name


def current(spark: SparkSession, table: str) -> tuple[int, dict | None]:
    """The last batch that is in the table, and what its manifest says (folders and rows by bucket, schema); -1 and None before the first."""
    batch, tables = buckets.current(spark, table)
    return batch, tables.get("copies")


def newest(copies: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """One row for each (place, path): the one seen last, of equals the one of copies. With what is held, only rows of copies that are not older."""
    rows = copies.withColumn("__held", F.lit(False))
    if held is not None:
        rows = rows.unionByName(held.withColumn("__held", F.lit(True)))
    order = Window.partitionBy("place", "path").orderBy(F.col("seen").desc_nulls_last(), "__held", "copy_id")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1 AND NOT __held").drop("__n", "__held")


def upsert(copies: DataFrame, batch: int, table: str) -> None:
    """Puts one batch into the table, but for rows that are older than what is held; a batch that is in it already is left alone."""
    spark = copies.sparkSession
    done, known = current(spark, table)
    if batch <= done:
        return
    held = None if known is None else buckets.lookup(copies.select("place", "path"), table, known).select(*copies.columns)
    rows = newest(copies, held)
    buckets.apply(spark, table, batch, {"copies": buckets.Change(["place", "path"], rows.select("place", "path"), rows)}, _name)


def copies(spark: SparkSession, table: str) -> DataFrame | None:
    rows = buckets.read(spark, table, "copies")
    return None if rows is None else rows.where(~F.col("gone"))


def books(spark: SparkSession, table: str) -> DataFrame | None:
    rows = copies(spark, table)
    return None if rows is None else R.books(R.resolved(rows))


def follow(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Upserts what arrives in source; all that is there and then stops, or on and on every so often.

    With `every` ("200 milliseconds", say), what arrives in the meantime is one batch, and so one new version for readers.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: upsert(df, batch, table))
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def states(reports: DataFrame) -> DataFrame:
    """place, operation, state and inventory of each place, from its scans' reports (place, operation, event, seq).

    event: started, row, finished, unavailable or not connected. Operations count up; only reports of a place's latest one say how it
    is, so that a late answer of an older one never does. The inventory is that of the latest operation that finished (null
    before the first): it stays while another one runs, and if that fails.
    """
    latest = reports.groupBy("place").agg(F.max("operation").alias("operation"))
    ends = F.max(F.when(F.col("event").isin("finished", "unavailable", "not connected"), F.struct("seq", "event")))["event"]
    told = reports.join(latest, ["place", "operation"]).groupBy("place", "operation").agg(ends.alias("end"))
    state = F.when(F.col("end") == "finished", "Ready").when(F.col("end") == "unavailable", "Unavailable").when(F.col("end") == "not connected", "Not connected").otherwise("Checking")
    whole = reports.where("event = 'finished'").groupBy("place").agg(F.max("operation").alias("inventory"))
    return told.join(whole, "place", "left").select("place", "operation", state.alias("state"), "inventory")


def inventory(reports: DataFrame) -> DataFrame:
    """The rows that count: those of each place's inventory."""
    held = states(reports).where("inventory IS NOT NULL").select("place", F.col("inventory").alias("operation"))
    return reports.where("event = 'row'").join(held, ["place", "operation"], "left_semi")


def counts_by_window(events: DataFrame, minutes: int = 10, late: str = "30 minutes") -> DataFrame:
    """Copies logged in each window of time and how many failed; what is later than `late` is left out."""
    timed = events.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{minutes} minutes")).agg(F.count("*").alias("copies"), F.sum((~F.col("ok")).cast("bigint")).alias("failed")).select(F.col("window.start").alias("start"), "copies", "failed")
