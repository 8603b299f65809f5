"""Places of rows in an order over all of them, without one task that has them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.storage import materialize


def numbered(df: DataFrame, order: list[Column], into: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the order: ranges are sorted by themselves and begin after the rows of those before. Rows that are equal in the order come in any."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = materialize(placed, "numbered").withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__id"))
    return rows.join(F.broadcast(offsets), "__part").withColumn(into, F.col("__before") + nth).select(*df.columns, into)
