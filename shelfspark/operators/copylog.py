"""The log of copies: one JSON object on each line, newest last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as X

#: Lines that the log keeps.
KEEP = 5000


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines by line_no; a top-n, so no task sorts the whole log."""
    return lines.orderBy(F.col("line_no").desc()).limit(n)


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The readable ones among the last n lines; so there may be fewer than n."""
    return last_lines(lines, n).where(~F.col("malformed"))


def failed(lines: DataFrame, n: int) -> DataFrame:
    """The last n failures among the readable ones of the last 50 n lines."""
    return last_lines(tail(lines, n * 50).where(~F.col("ok")), n)


def shown(entries: DataFrame) -> DataFrame:
    return entries.select("line_no", X.stamp(F.col("at")).alias("when"), "title", "from_place", "to_place", X.human_size(F.col("bytes")).alias("size"), "ok")


def by_route(lines: DataFrame) -> DataFrame:
    kept = lines.where(~F.col("malformed"))
    return kept.groupBy("from_place", "to_place").agg(F.count("*").alias("copies"), F.sum((~F.col("ok")).cast("bigint")).alias("failed"), F.sum("bytes").alias("bytes"))


def compacted(lines: DataFrame, new: DataFrame) -> DataFrame:
    """What the log holds after new lines were added: the newest KEEP."""
    return last_lines(lines.unionByName(new), KEEP)


def summary(outcomes: DataFrame) -> DataFrame:
    """Copied of how many, failures, and the first two messages, with an ellipsis if there are more."""
    counts = outcomes.agg(F.sum(F.col("ok").cast("bigint")).alias("copied"), F.count("*").alias("total"), F.sum((~F.col("ok")).cast("bigint")).alias("failures"))
    first = outcomes.where(~F.col("ok")).orderBy("line_no").limit(3).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "detail"))), lambda x: x["detail"]).alias("m"))
    rows = counts.withColumn("one", F.lit(1)).join(first.withColumn("one", F.lit(1)), "one")  # a row each
    return rows.select("copied", "total", "failures", F.concat(F.array_join(F.slice("m", 1, 2), "; "), F.when(F.size("m") > 2, "; …").otherwise("")).alias("messages"))


def lines_of(path_text: DataFrame) -> DataFrame:
    """line_no, the fields and whether a line is malformed, from whole files (column value, in file order; path, if there, stays)."""
    kept = [c for c in path_text.columns if c == "path"]
    rows = path_text.select(*kept, F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    fields = "at BIGINT, title STRING, author STRING, from STRING, to STRING, bytes BIGINT, ok BOOLEAN, detail STRING"
    parsed = rows.withColumn("e", F.from_json("line", fields, {"mode": "PERMISSIVE"}))
    bad = F.col("e").isNull() | F.col("e.at").isNull() | F.col("e.title").isNull() | F.col("e.ok").isNull()
    return parsed.select(
        *kept, F.col("line_no").cast("bigint").alias("line_no"), F.col("e.at").alias("at"), F.col("e.title").alias("title"), F.coalesce("e.author", F.lit("")).alias("author"), F.col("e.from").alias("from_place"), F.col("e.to").alias("to_place"),
        F.coalesce("e.bytes", F.lit(0)).alias("bytes"), F.col("e.ok").alias("ok"), F.coalesce("e.detail", F.lit("")).alias("detail"), bad.alias("malformed"),
    )
