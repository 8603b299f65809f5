"""Operator 3: contiguous shards of nearly equal bytes, from global prefix sums. DataFrame functions only.

Rows are put in order of (id, text checksum, size) by a range exchange of narrow rows, which are written
once to the shared folder with their place in that order. Each partition's totals become prefix sums (one row
for each partition), and a running sum inside each partition completes them: every row knows the bytes and the
rows before it. A row goes to the shard in which the middle of its bytes falls.

Defined results: a null text has no bytes, so the size of its overhead and the checksum of nothing, 0. Null ids
come first. Equal ids are ordered by checksum and size; rows equal in all three are interchangeable. An empty
table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import documents, materialize, text_or_empty


def shard(df: DataFrame, n: int, overhead: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard (0 to n - 1) and slot (0, 1, ... in each shard, in order)."""
    rows = df.select(
        F.col(key),
        (F.octet_length(text_or_empty(text)) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty(text), "UTF-8")).alias("text_crc32"),
    )
    order = [F.col(key).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = materialize(placed, "shards").withColumn("part", F.shiftright("place", 33))

    totals = rows.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    whole = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("place")
    summed = rows.withColumns({"to_here": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(inside)})
    # Twice the middle of the row's bytes, so that all stays in whole numbers.
    middle = 2 * (F.col("bytes_before") + F.col("to_here")) - F.col("size")
    cut = summed.join(F.broadcast(offsets), "part").select(
        key,
        "size",
        "text_crc32",
        F.least(F.lit(n - 1), F.floor(middle.cast("decimal(38,0)") * n / (2 * F.col("all_bytes"))).cast("int")).alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("rank"),
    )
    cut = materialize(cut, "cut")
    starts = cut.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # n rows at most
    return cut.join(F.broadcast(starts), "shard").select(key, "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_shards": op3_shards}
#: CRC-32 goes byte by byte through the table of its polynomial, 0xEDB88320.
ORACLE = {
    "op3_shards": """
    WITH t AS (SELECT list_transform(range(256), lambda i : list_reduce(list_prepend(i, list_transform(range(8), lambda z : 0::BIGINT)), lambda a, z : CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab),
    b AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h : CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
    d AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x : xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) AS text_crc32 FROM b, t),
    p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS to_here, sum(size) OVER () AS total FROM d),
    s AS (SELECT *, CAST(least(39, (2 * to_here - size) * 40 // (2 * total)) AS INT) AS shard FROM p)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""
}
