"""What a reading device's database knows: store books, annotations and shelves, as joins over its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as X


def _present(df: DataFrame, name: str, otherwise: Column) -> Column:
    """A column that older databases lack."""
    return F.col(name) if name.lower() in {c.lower() for c in df.columns} else otherwise


def store_books(content: DataFrame, keys: DataFrame, downloaded: DataFrame) -> DataFrame:
    """id, title, author, encrypted and preview of the store's books whose file is there, by title.

    content: ContentID, Title, Attribution and, on newer devices, Accessibility. keys: volumeid. downloaded: id.
    """
    preview = X.integer_prefix(_present(content, "Accessibility", F.lit(None)).cast("string")) == 6
    rows = content.select(
        F.col("ContentID").alias("id"),
        F.coalesce(F.nullif("Title", F.lit("")), "ContentID").alias("title"),
        F.coalesce("Attribution", F.lit("")).alias("author"),
        F.coalesce(preview, F.lit(False)).alias("preview"),
    )
    locked = keys.select(F.col("volumeid").alias("id")).distinct().withColumn("encrypted", F.lit(True))
    return rows.join(downloaded, "id", "left_semi").join(locked, "id", "left").withColumn("encrypted", F.coalesce("encrypted", F.lit(False)))


def device_list(store: DataFrame, sideloads: DataFrame | None = None, previews: bool = False) -> DataFrame:
    rows = store if sideloads is None else store.unionByName(sideloads)
    return rows if previews else rows.where(~F.col("preview"))


def list_footer(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("entries"), F.sum((~F.col("preview")).cast("bigint")).alias("books"), F.sum(F.col("preview").cast("bigint")).alias("previews"))


def encrypted_twin(files: DataFrame, store: DataFrame) -> DataFrame:
    """Files that are a store book's encrypted copy: same identifier (without urn:uuid:), length and digest."""
    own = files.withColumn("id", F.regexp_replace("identifier", "^urn:uuid:", ""))
    return own.join(store.where("encrypted").select("id", "length", "sha"), ["id", "length", "sha"], "left_semi").select("path", "id")


def annotations(marks: DataFrame, content: DataFrame) -> DataFrame:
    """Highlights and notes with the title of their book; hidden marks and those without words are left out."""
    shown = ~F.coalesce("Hidden", F.lit("false")).isin("true", "1")
    words = lambda c: X.trimmed(F.coalesce(F.col(c), F.lit("")))
    rows = marks.where(shown).withColumns({"text": words("Text"), "note": words("Annotation")}).where((F.col("text") != "") | (F.col("note") != ""))
    both = rows.join(content, F.col("VolumeID") == F.col("ContentID"), "left")
    return both.select(
        F.coalesce("Title", "VolumeID").alias("title"), F.coalesce("Attribution", F.lit("")).alias("author"), "text", "note", F.coalesce("DateCreated", F.lit("")).alias("created"), F.coalesce(F.col("ChapterProgress"), F.lit(0.0)).alias("progress")
    )


def notes_by_book(notes: DataFrame) -> DataFrame:
    """How much there is on each (title, author), which is what one document is written for."""
    return notes.groupBy("title", "author").agg(F.count("*").alias("n_notes"), F.sum((F.col("note") != "").cast("bigint")).alias("n_commented"), F.min("progress").alias("first_at"))


def markdown(notes: DataFrame) -> DataFrame:
    """title, author and a Markdown document of the book's notes, in the order of where they stand."""
    quote = F.when(F.col("text") != "", F.concat(F.array_join(F.transform(F.split("text", "\r?\n"), lambda x: F.concat(F.lit("> "), X.trimmed(x))), "\n"), F.lit("\n"))).otherwise("")
    said = F.when(F.col("note") != "", F.concat(F.when(F.col("text") != "", "\n").otherwise(""), F.col("note"), F.lit("\n"))).otherwise("")
    day, at = X.day_of(F.col("created")), X.percent(F.col("progress")).cast("string")
    foot = F.concat(F.lit("\n— "), at, F.lit("% in"), F.when(day != "", F.concat(F.lit(", "), day)).otherwise(""), F.lit("\n"))
    rows = notes.withColumn("part", F.concat(F.lit("\n"), quote, said, foot))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("progress", "created", "part"))), lambda x: x["part"]), "")
    by = F.when(F.col("author") != "", F.concat(F.lit("\n*"), F.col("author"), F.lit("*\n"))).otherwise("")
    return rows.groupBy("title", "author").agg(parts.alias("parts")).select("title", "author", F.concat(F.lit("# "), F.col("title"), F.lit("\n"), by, F.col("parts")).alias("document"))


def shelved(shelf: DataFrame, items: DataFrame, titles: DataFrame) -> DataFrame:
    """(shelf, id, title): the books of each shelf; a shelf without books has one row with a null id.

    A shelf's items name it by its internal name or the one it shows; both become rows of one equi-join.
    """
    live = lambda c: F.coalesce(F.col(c), F.lit("false")).isin("true", "1")
    inner = _present(shelf, "InternalName", F.col("Name"))
    names = shelf.where(~live("_IsDeleted")).select(F.col("Name").alias("shelf"), F.explode(F.array_distinct(F.array(inner, F.col("Name")))).alias("ShelfName"))
    kept = items.where(~live("_IsDeleted")).select("ShelfName", F.col("ContentId").alias("id"))
    rows = names.join(kept, "ShelfName", "left").select("shelf", "id").distinct()
    rows = rows.join(titles.select(F.col("ContentID").alias("id"), F.col("Title").alias("t")), "id", "left")
    rows = rows.withColumn("title", F.when(F.col("id").isNotNull(), F.coalesce(F.nullif("t", F.lit("")), "id"))).select("shelf", "id", "title").distinct()
    # A blank row only says that the shelf exists.
    whole = rows.groupBy("shelf").agg(F.count("id").alias("n"))
    return rows.join(whole, "shelf").where(F.col("id").isNotNull() | (F.col("n") == 0)).drop("n")


def shelf_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shelf").agg(F.count("id").alias("n_books"))


def shelf_totals(rows: DataFrame) -> DataFrame:
    return shelf_counts(rows).agg(F.count("*").alias("shelves"), F.sum("n_books").alias("books"))


def nested_shelves(rows: DataFrame) -> DataFrame:
    book = F.when(F.col("id").isNotNull(), F.struct(X.fold_ascii(F.col("title")).alias("key"), "id", "title"))
    listed = F.transform(F.array_sort(F.array_compact(F.collect_list(book))), lambda b: F.struct(b["id"].alias("id"), b["title"].alias("title")))
    return rows.groupBy("shelf").agg(listed.alias("books"))


def shelf_table(rows: DataFrame) -> DataFrame:
    """Shelves in order with their name on the first row only."""
    order = Window.partitionBy("shelf").orderBy(X.fold_ascii(F.col("title")), "id")
    return rows.withColumn("n", F.row_number().over(order)).select("shelf", F.when(F.col("n") == 1, F.col("shelf")).otherwise("").alias("shown"), "n", "id", "title")


def on_shelf(books: DataFrame, rows: DataFrame, shelf: str) -> DataFrame:
    """Books of the shelf with that name, ASCII case aside; an unknown name is an error that lists the shelves."""
    known = [r.shelf for r in rows.select("shelf").distinct().orderBy("shelf").collect()]  # a person's shelves
    fold = str.maketrans(X.UPPER, X.LOWER)
    match = next((s for s in known if s.translate(fold) == shelf.translate(fold)), None)
    if match is None:
        raise ValueError(f"no shelf {shelf!r}; there are {', '.join(known)}")
    return books.join(rows.where(F.col("shelf") == match).select("id"), "id", "left_semi")
