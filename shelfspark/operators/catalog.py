"""Questions about the merged catalogue: filters, search, orders, what is missing where, what may be copied or removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as X

PLACES = ("Local", "Kobo", "CrossPoint")


def has(place: str) -> Column:
    return F.col(f"on_{place.lower()}")


def missing(books: DataFrame, place: str) -> DataFrame:
    return books.where(~has(place))


def only(books: DataFrame, place: str) -> DataFrame:
    """Books all of whose copies are there."""
    return books.where(~F.greatest(*[has(p) for p in PLACES if p != place]))


def unreadable(books: DataFrame) -> DataFrame:
    return books.where("any_unreadable")


def keyed(books: DataFrame) -> DataFrame:
    """With what books are searched and sorted by."""
    return books.withColumns({
        "title_key": F.lower("title"),
        "author_key": F.lower("author"),
        "series_key": X.series_key(F.col("series"), F.col("series_index")),
        "search": F.lower(F.concat_ws(" ", "title", "author", F.coalesce("series", F.lit("")))),
    })


def search(books: DataFrame, query: str) -> DataFrame:
    """Books that contain the query; `author:`, `title:` and `series:` in front search that field only."""
    field, colon, term = query.lower().partition(":")
    if colon and field in ("author", "title", "series"):
        return keyed(books).where(F.contains(F.col(f"{field}_key"), F.lit(term.lstrip())))
    return keyed(books).where(F.contains(F.col("search"), F.lit(query.lower())))


def ordered(books: DataFrame, by: str = "title") -> DataFrame:
    """By title, author or series, then title; book_id makes the order total."""
    return keyed(books).orderBy(f"{by}_key", "title_key", "author", "book_id")


def to_transfer(books: DataFrame, source: str, target: str) -> DataFrame:
    """Books at source and not at target that have a readable best copy."""
    if source == target:
        raise ValueError("source and target are the same place")
    return books.where(has(source) & ~has(target) & (F.col("preferred.sha") != ""))


def required_space(books: DataFrame, free: DataFrame | None = None, request: Column | None = None) -> DataFrame:
    """For each place: the books it misses, what their best copies take, and whether that fits (null if free space is unknown). Requests take none."""
    books = books if request is None else books.where(~F.coalesce(request, F.lit(False)))
    asked = books.select(F.explode(F.array(*[F.struct(F.lit(p).alias("place"), (~has(p)).alias("misses"), F.col("preferred.size").alias("size")) for p in PLACES])).alias("x"))
    out = asked.select("x.*").groupBy("place").agg(F.sum(F.col("misses").cast("bigint")).alias("books"), F.sum(F.when(F.col("misses"), F.col("size")).otherwise(0)).alias("bytes"))
    out = out.withColumn("shown", X.human_size(F.col("bytes")))
    return out if free is None else out.join(F.broadcast(free), "place", "left").withColumn("fits", F.col("bytes") <= F.col("free"))


def entry_counts(copies: DataFrame) -> DataFrame:
    """Entries and unreadable entries of each place, as seen while scanning: before merging."""
    return copies.groupBy("place").agg(F.count("*").alias("entries"), F.sum((F.col("sha") == "").cast("bigint")).alias("unreadable"))


def book_counts(books: DataFrame) -> DataFrame:
    """Merged books of each place."""
    rows = books.select(F.explode(F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in PLACES]))).alias("place"))
    return rows.groupBy("place").agg(F.count("*").alias("books"))


def status_text(counts: DataFrame) -> DataFrame:
    """`Ready (3 books, 0 unreadable)` of entry counts."""
    return counts.select("place", F.concat(F.lit("Ready ("), X.counted(F.col("entries")), F.lit(", "), F.col("unreadable").cast("string"), F.lit(" unreadable)")).alias("status"))


def presence(copies: DataFrame) -> DataFrame:
    """How each book shows at each place, from its first copy there: unreadable, device copy, original, or absent."""
    state = F.when(F.col("sha") == "", "unreadable").when(F.col("optimized"), "device copy").otherwise("original")
    rows = copies.withColumn("state", state).groupBy("book_id").pivot("place", list(PLACES)).agg(F.min_by("state", F.struct("place_rank", "path")))
    return rows.select("book_id", *[F.coalesce(F.col(p), F.lit("absent")).alias(p.lower()) for p in PLACES])


def source_label() -> Column:
    kind = F.when(F.col("preferred.sha") == "", "unreadable").when(F.col("preferred.optimized"), "device copy").otherwise("original")
    return F.concat("preferred.place", F.lit(" ("), kind, F.lit(")"))


def listing(books: DataFrame) -> DataFrame:
    """The printed catalogue: title, author, places, source, bytes; one line for each book."""
    return books.select(*[X.printable(F.col(c)).alias(c) for c in ("title", "author")], "places", source_label().alias("source"), F.col("preferred.size").alias("bytes"), "book_id")


def destination(books: DataFrame, target: str, verdict: Column | None = None, ready: bool = True, connected: bool = True, busy: bool = False, refreshing: bool = False, loading: bool = False, request: Column | None = None) -> DataFrame:
    """book_id, decision (ready, ask or blocked) and why, of copying each book to target; the first rule that holds decides.

    request: whether the entry is no book yet but a request for one, which is fulfilled locally. verdict: how well a book's PDF converts, one of good, poor, impossible, or null if it has not been read.
    """
    verdict = F.lit(None).cast("string") if verdict is None else verdict
    rule = F.when(F.lit(busy), "blocked: busy").when(F.lit(refreshing), "blocked: refreshing").when(F.lit(not connected), "blocked: not connected")
    rule = rule.when(F.lit(target != "Local" and not ready), "blocked: unavailable")
    if request is not None:
        rule = rule.when(request, "ready: fulfil ACSM" if target == "Local" else "blocked: local first")
    rule = rule.when(has(target), "blocked: already here")
    rule = rule.when(F.lit(loading) & (F.col("preferred.optimized") | (F.col("preferred.place") == "CrossPoint")), "blocked: wait for discovery")
    if target == "CrossPoint":
        kind = F.col("preferred.format")
        rule = rule.when((kind == "pdf") & (verdict == "good"), "ready: convert to EPUB, copy").when((kind == "pdf") & (verdict == "poor"), "ask: converts poorly")
        rule = rule.when((kind == "pdf") & verdict.isNotNull(), "blocked: cannot be converted").when(kind == "pdf", "blocked: not read yet")
        rule = rule.when(kind != "epub", "blocked: reader shows only EPUB").otherwise("ready: copy, optimized")
    else:
        rule = rule.otherwise("ready: copy")
    out = books.select("book_id", F.split(rule, ": ").alias("rule"))
    return out.select("book_id", F.lit(target).alias("target"), out["rule"][0].alias("decision"), out["rule"][1].alias("why"))


def destination_counts(decisions: DataFrame) -> DataFrame:
    """For each target: how many are ready or to be asked about, and the first reason (by book) that blocks."""
    first = F.min_by("why", F.when(F.col("decision") == "blocked", F.col("book_id")))
    counts = [F.sum((F.col("decision") == d).cast("bigint")).alias(d) for d in ("ready", "ask", "blocked")]
    return decisions.groupBy("target").agg(*counts, F.when(F.sum((F.col("decision") == "blocked").cast("bigint")) > 0, first).alias("first_blocked"))


def removal(copies: DataFrame, card: bool = True, busy: bool = False, scanning: bool = False) -> DataFrame:
    """copy_id and why the copy may not be removed (`ready` if it may); the first rule that holds decides."""
    alone = copies.groupBy("book_id").agg((F.count("*") < 2).alias("alone"))
    rule = F.when(F.lit(busy), "busy").when(F.lit(scanning), "scanning").when(F.col("alone"), "only copy").when(F.col("locked"), "Kobo library").when(F.col("sha") == "", "unreadable")
    rule = rule.when((F.col("place") == "CrossPoint") & F.lit(not card), "needs the card").when(F.col("place") != "CrossPoint", "add only").otherwise("ready")
    return copies.join(alone, "book_id").select("copy_id", "book_id", rule.alias("removal"))


def several_at_one_place(copies: DataFrame) -> DataFrame:
    """Books with more than one copy at a place."""
    return copies.groupBy("book_id", "place").agg(F.count("*").alias("n_copies")).where("n_copies > 1")


def scroll(current: int, selected: int, rows: int, visible: int) -> int:
    """The first row to show, so that the selected one is in sight with two rows around it where there is room, and nothing moves needlessly."""
    if visible <= 0 or rows <= visible:
        return 0
    margin = min((visible - 1) // 2, 2)
    lowest, highest = selected + margin + 1 - visible, selected - margin
    at = min(current, rows - visible)
    at = max(highest, 0) if at > highest else at
    return min(max(at, lowest), rows - visible)


def viewport(shown: DataFrame, order: list, current: int, selected: int, visible: int) -> DataFrame:
    """The rows of an ordered list that are in sight; a top-n and an offset."""
    first = scroll(current, selected, shown.count(), visible)
    return shown.orderBy(*order).offset(first).limit(visible)


def marked(books: DataFrame, marks: DataFrame, copies: DataFrame) -> DataFrame:
    """Books any of whose copies is marked by (place, path)."""
    return books.join(copies.join(marks, ["place", "path"], "left_semi").select("book_id"), "book_id", "left_semi")


def toggled(shown: DataFrame, marks: DataFrame) -> DataFrame:
    """Mark all that are shown, or clear them if all are marked already."""
    missing_marks = shown.join(marks, shown.columns, "left_anti")
    return marks.join(shown, shown.columns, "left_anti") if missing_marks.isEmpty() else marks.unionByName(missing_marks)


def located(names: DataFrame, roots: DataFrame) -> DataFrame:
    """Each source with the root that is its longest prefix, and the path below it: the folders above it are joined by equality."""
    parts = F.split("source", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    pair = names.select("source", F.explode(above).alias("root")).join(roots.select("root", F.col("root").alias("is_root")), "root", "left").drop("root").withColumnRenamed("is_root", "root")
    best = pair.groupBy("source").agg(F.max_by("root", F.length("root")).alias("root"))
    return best.withColumn("below", F.when(F.col("root").isNotNull(), F.expr("substring(source, length(root) + 2)")))
