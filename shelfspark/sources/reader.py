"""A reader's own listing of its files, as captured from its interface: one JSON array for each folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A folder's entries, and what a path component may not be.
ENTRY = "array<struct<name:string,size:bigint,isDirectory:boolean>>"
DEEP, MANY = 32, 20_000


def valid_component(name):
    """Whether a name can be one component of a path."""
    return (name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\\p{Cc}]") & (F.octet_length(name) <= 255)


def files(captured: DataFrame) -> DataFrame:
    """path, size, directory, in order of path, from captured listings (folder, json) of one reader, or of many (reader, folder, json): then with reader, in no order.

    Hidden names are left out with all below them; a listing that is no array, a name that is no component, or more depth or
    entries than a reader has, is an error: at once of one reader, and of many when their rows are read.
    """
    many = "reader" in captured.columns
    who = ["reader"] if many else []
    rows = captured.select(*who, F.regexp_replace("folder", "^/+|/+$", "").alias("folder"), F.from_json("json", ENTRY, {"mode": "FAILFAST"}).alias("e")).select(*who, "folder", F.explode("e").alias("e"))
    rows = rows.select(*who, F.concat_ws("/", F.nullif("folder", F.lit("")), "e.name").alias("path"), F.col("e.name").alias("name"), F.when(F.col("e.isDirectory"), 0).otherwise(F.col("e.size")).cast("bigint").alias("size"), F.col("e.isDirectory").alias("directory"))
    kept = rows.where(~F.col("path").rlike(r"(^|/)\.") & ~F.lower("path").rlike(r"(^|/)(xtcache|system volume information)(/|$)"))
    wrong = ~valid_component(F.col("name")) | (F.size(F.split("path", "/")) > DEEP)
    if not many:
        bad = kept.where(wrong).limit(1).collect()
        if bad or kept.limit(MANY + 1).count() > MANY:
            raise ValueError(f"not a listing of a reader: {bad[0].path if bad else 'too many entries'}")
        return kept.select("path", "size", "directory").orderBy("path")
    counts = kept.groupBy("reader").agg(F.count("*").alias("n"))
    said = lambda x: F.raise_error(F.concat(F.lit("not a listing of a reader: "), "reader", F.lit(": "), x))
    checked = F.when(wrong, said(F.col("path"))).when(F.col("n") > MANY, said(F.lit("too many entries"))).otherwise(F.col("path"))
    return kept.join(counts, "reader").select("reader", checked.alias("path"), "size", "directory")


def shown_on_reader(rows: DataFrame) -> DataFrame:
    """Files that a reader lists as books: EPUB only."""
    return rows.where(~F.col("directory") & F.lower("path").endswith(".epub"))


def incomplete(sent: DataFrame, there: DataFrame) -> DataFrame:
    """Paths whose content on the reader is a strictly shorter byte prefix of what was to be sent (both: path, content)."""
    a, b = F.col("s.content"), F.col("t.content")
    both = sent.alias("s").join(there.alias("t"), "path")
    return both.where((F.octet_length(b) < F.octet_length(a)) & (F.substring(a, F.lit(1), F.octet_length(b)) == b)).select("path")
