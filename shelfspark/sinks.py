"""Where results go: tables for people, JSON, Markdown, corrected and converted books; nothing is ever overwritten unasked."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as X

#: Names that a correction tries before it gives up.
TRIES = 100


def tsv(df: DataFrame, path: str) -> None:
    """A header and one line for each row; control characters in texts become spaces."""
    clean = [X.printable(F.col(c)).alias(c) if t == "string" else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("error").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path, ignoreNullFields=False)


def pretty_json(df: DataFrame) -> DataFrame:
    """One column, json: each row as an indented object."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def documents(df: DataFrame, path: str, name: str = "title", body: str = "document") -> None:
    """A folder for each name with its document as text; fails if path is there."""
    df.select(X.component(F.col(name), "Untitled").alias("name"), F.col(body).alias("value")).write.mode("error").partitionBy("name").text(path)


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name if nothing has it, ASCII case or not; else with (corrected), (corrected 2), ... before the extension."""
    there = {t.lower() for t in taken}
    stem, dot, extension = name.rpartition(".")
    stem, extension = (stem, dot + extension) if dot else (name, "")
    for i in range(TRIES + 1):
        tried = name if i == 0 else f"{stem} (corrected{f' {i}' if i > 1 else ''}){extension}"
        if tried.lower() not in there:
            return tried
    raise FileExistsError(f"{TRIES} corrections of {name} are there already")


def _halves(name: str) -> tuple[F.Column, F.Column]:
    """A name before its last dot, and from there on."""
    parts = r"(?s)^(.*?)(\.[^.]*)?$"
    return F.regexp_extract(name, parts, 1), F.regexp_extract(name, parts, 2)


def free_names(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """id, folder, free: for each file (id, folder, name) a name of its folder that no file of `there` (folder, name) has, ASCII case or not.

    Files that want one name take it and its numbered forms in the order of their ids, which are each one's own; a numbered form
    that another file wants by itself is left to that one. Null beyond TRIES forms. Only the first TRIES + 1 files of a name are
    ranked, before the shuffle, so that thousands of one name are no one task's.
    """
    low = F.lower("name")
    numbered = r"(?s)^(?:([^.]*)|(.*)) \(corrected(?: ([0-9]{1,3}))?\)(\.[^.]*)?$"
    part = lambda i: F.regexp_extract(low, numbered, i)
    number = F.when(part(3) == "", 1).otherwise(part(3).cast("int"))
    forms = there.select("folder", "name").unionByName(wanted.select("folder", "name")).where(low.rlike(numbered) & ((part(2) == "") | (part(4) != "")))
    forms = forms.select("folder", F.concat(part(1), part(2), part(4)).alias("base"), number.alias("number"), part(3).alias("digits")).where(f"number <= {TRIES} AND (digits = '' OR number > 1 AND digits = string(number))").drop("digits")
    taken = there.select("folder", low.alias("base"), F.lit(0).alias("number")).unionByName(forms).groupBy("folder", "base").agg(F.collect_set("number").alias("taken"))
    order = Window.partitionBy("folder", "base").orderBy("id")
    ranked = wanted.select("id", "folder", "name", low.alias("base")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TRIES + 1)
    numbers = F.array_except(F.sequence(F.lit(0), F.lit(TRIES)), F.coalesce("taken", F.array().cast("array<int>")))
    stem, extension = _halves("name")
    n = F.get(numbers, F.col("rank") - 1)
    form = F.when(n == 0, F.col("name")).when(n == 1, F.concat(stem, F.lit(" (corrected)"), extension)).when(n > 1, F.concat(stem, F.lit(" (corrected "), n.cast("string"), F.lit(")"), extension))
    named = ranked.join(taken, ["folder", "base"], "left").select("id", form.alias("free"))
    return wanted.select("id", "folder").join(named, "id", "left")
