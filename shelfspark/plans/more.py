"""Queries over what surrounds the catalogue: plans of copying, marks, the cache, places that report, uploads, texts; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import config, sinks
from shelfspark.functions import text as X
from shelfspark.operators import bulk as Q
from shelfspark.operators import cache as C
from shelfspark.operators import catalog as K
from shelfspark.operators import convert as V
from shelfspark.operators import layout as Y
from shelfspark.operators import ranks
from shelfspark.operators import sync as S
from shelfspark.plans.device import _STORE, store
from shelfspark.plans.library import _BOOKS, _COPIES, _KEYS, _PLACES, books, copies, resolved, sync_plan
from shelfspark.plans.names import _NAME, _PART
from shelfspark.plans.text import _LINES, lines
from shelfspark.sources import books as B
from shelfspark.sources import reader as N
from shelfspark.sources.adapters import view
from shelfspark.storage import fresh, spread
from shelfspark.streaming import catalogue as W
from shelfspark.streaming import places as P
from shelfspark.streaming import resolution as I

# Planning -------------------------------------------------------------------------------------------------------------------------------

_PLAN = _COPIES + f""", named AS (SELECT *, {_PART.format("author")} AS folder, {_PART.format("title")} AS stem FROM copies),
  wanted AS (SELECT copy_id AS id, list_distinct(list_filter([CASE WHEN sha <> '' THEN sha END, resources], lambda x : x IS NOT NULL)) AS own, {_NAME.format("folder", "Unknown author")} || '/' || {_NAME.format("stem", "Untitled")} || '.' || format AS target,
    sha = '' AS bad, row_number() OVER (ORDER BY lower(title), copy_id) AS n FROM named WHERE place = 'Kobo'),
  there AS (SELECT path, unnest(list_filter([CASE WHEN sha <> '' THEN sha END, resources], lambda x : x IS NOT NULL)) AS identity FROM copies WHERE place = 'CrossPoint'),
  found AS (SELECT w.id, min(t.path) AS here FROM (SELECT id, unnest(own) AS identity FROM wanted) w JOIN there t ON t.identity = w.identity GROUP BY w.id),
  rows AS (SELECT w.*, f.here, EXISTS (SELECT 1 FROM copies c WHERE c.place = 'CrossPoint' AND lower(c.path) = lower(w.target)) AS occupied FROM wanted w LEFT JOIN found f ON f.id = w.id),
  fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS sent, CAST([] AS VARCHAR[]) AS names, CAST(NULL AS BIGINT) AS id, CAST('' AS VARCHAR) AS status, CAST('' AS VARCHAR) AS detail
    UNION ALL SELECT n, CASE WHEN status = 'transfer' THEN list_concat(sent, own) ELSE sent END, CASE WHEN status = 'transfer' THEN list_append(names, lower(target)) ELSE names END, id, status,
      CASE status WHEN 'present' THEN here WHEN 'duplicate' THEN 'the same book is sent already' WHEN 'transfer' THEN target ELSE CASE WHEN bad THEN 'unreadable' WHEN list_contains(names, lower(target)) THEN 'another book has this name' ELSE 'a different file is there' END END
    FROM (SELECT r.n, r.id, r.own, r.target, r.here, r.bad, f.sent, f.names, CASE WHEN r.bad THEN 'failed' WHEN r.here IS NOT NULL THEN 'present' WHEN list_has_any(f.sent, r.own) THEN 'duplicate' WHEN list_contains(f.names, lower(r.target)) THEN 'failed' WHEN r.occupied THEN 'failed' ELSE 'transfer' END AS status
      FROM fold f JOIN rows r ON r.n = f.n + 1)),
  planned AS (SELECT id, status, detail FROM fold WHERE n > 0) """


def targets(spark: SparkSession, d: str, organised: bool) -> DataFrame:
    c = copies(spark, d).select(F.col("copy_id").alias("id"), "author", "title", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("format").alias("extension"))
    folders = spark.createDataFrame([("SRC1",), ("Src2",), ("other",)], "name string")
    return S.targets(c, folders, organised).select("id", "target")


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    planned = sync_plan(spark, d)
    return S.applied(planned, planned.where("id % 5 = 0 AND status = 'transfer'").select("id", F.lit("the card is full").alias("error")))


def copied(spark: SparkSession, d: str) -> DataFrame:
    """Kobo's copies on their way to a card that has some of their names already."""
    odd = F.when(F.col("copy_id") % 31 == 0, F.lit("a:b.epub")).when(F.col("copy_id") % 37 == 0, F.lit(".hidden.epub")).when(F.col("copy_id") % 41 == 0, F.lit("notes.txt"))
    name = F.coalesce(odd, F.concat(F.lit("n"), F.col("copy_id").cast("string"), F.lit("."), F.col("format")))
    rows = copies(spark, d).where("place = 'Kobo'").select(F.col("copy_id").alias("id"), F.lit("Books").alias("folder"), name.alias("name"), "sha", "size", odd.isNull().alias("plain"))
    there = rows.where("plain AND id % 4 < 2").select("folder", F.when(F.col("id") % 4 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 4 == 0, F.col("sha")).otherwise(F.lit("other")).alias("sha"), (F.col("id") % 43 == 0).alias("directory"))
    return S.copy_check(rows, there, 600_000)


def bulk_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of copying all books, in a job that stops after its first wave and another that goes on."""

    def act(row: dict) -> str:
        if row["id"] % 13 == 0:
            raise OSError("the card is full")
        return f"{row['path']}: {row['size']}"

    items, ledger = copies(spark, d).select(F.col("copy_id").alias("id"), "path", "size"), fresh(spark, "ledger")
    wave = max(50, items.count() // 3)
    Q.run(items, act, ledger, wave, waves=1)
    Q.run(items, act, ledger, wave)
    return Q.outcomes(spark, ledger)


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Decisions where every eleventh book is a request for one."""
    b = books(spark, d)
    rows = [K.destination(b, p, request=F.col("book_id") % 11 == 0) for p in K.PLACES]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def space(spark: SparkSession, d: str) -> DataFrame:
    free = spark.createDataFrame([("Local", 10**15), ("Kobo", 1000)], "place string, free bigint")
    return K.required_space(books(spark, d), free, F.col("book_id") % 11 == 0).select("place", "books", "bytes", "fits")


# Marks and the cache ------------------------------------------------------------------------------------------------------------------------


def marks(spark: SparkSession, d: str) -> DataFrame:
    return copies(spark, d).where("copy_id % 10 = 3").select("place", "path")


def marked(spark: SparkSession, d: str) -> DataFrame:
    c = resolved(spark, d)
    return K.marked(c.groupBy("book_id").agg(F.count("*").alias("n_copies")), marks(spark, d), c)


def toggled(spark: SparkSession, d: str) -> DataFrame:
    shown = copies(spark, d).where("place = 'Kobo'").select("place", "path")
    once = K.toggled(shown, marks(spark, d))
    return once.withColumn("times", F.lit(1)).unionByName(K.toggled(shown, once).withColumn("times", F.lit(2)))


def scan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A listing of all copies, and a cache that knows two thirds of them and some files that are gone."""
    c = copies(spark, d)
    key = X.cache_key(F.col("place"), F.col("path"), F.when(F.col("copy_id") % 50 > 0, X.fingerprint(F.col("size"), F.timestamp_micros(F.col("copy_id") * 1_000_003))))
    listing = c.select("copy_id", "place", "path", F.when(F.col("copy_id") % 50 > 0, key).alias("key"))
    cache = listing.where("copy_id % 3 > 0 AND key IS NOT NULL").select("key", F.col("copy_id").alias("seen")).unionByName(c.where("copy_id % 7 = 0").select(F.concat(F.lit("gone"), F.col("path")).alias("key"), F.col("copy_id").alias("seen")))
    return listing, cache


def cache_after(spark: SparkSession, d: str) -> DataFrame:
    listing, cache = scan(spark, d)
    used, read = C.known(listing, cache), C.todo(listing, cache).where("key IS NOT NULL").select("key")
    path = fresh(spark, "cache")
    C.scanned(cache, used, read, path, C.TTL + 500)
    again = C.load(spark, path, "key string, seen bigint")
    C.save(again, path, C.TTL + 500)  # over what it came from, as scan after scan does
    return C.load(spark, path, "key string, seen bigint")


_SCAN = _COPIES + """, listing AS (SELECT *, CASE WHEN copy_id % 50 > 0 THEN place || chr(1) || path || chr(1) || size || '.' || (copy_id * 1000003 // 1000000) || '.' || lpad(CAST(copy_id * 1000003 % 1000000 * 1000 AS VARCHAR), 9, '0') END AS key FROM copies),
  cache AS (SELECT key, copy_id AS seen FROM listing WHERE copy_id % 3 > 0 AND key IS NOT NULL UNION ALL SELECT 'gone' || path, copy_id FROM copies WHERE copy_id % 7 = 0) """


# Places, uploads, requests ------------------------------------------------------------------------------------------------------------------


def reports(spark: SparkSession, d: str) -> DataFrame:
    """What scans of seven places report, an operation for each 400 events; answers of older ones come late."""
    e = spark.read.parquet(f"{d}/events.parquet")
    operation = F.expr("event_id div 400") - F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)
    event = F.expr("CASE WHEN event_id % 17 = 0 THEN 'finished' WHEN event_id % 19 = 0 THEN 'unavailable' WHEN event_id % 23 = 0 THEN 'not connected' WHEN event_id % 29 = 0 THEN 'started' ELSE 'row' END")
    return e.select(F.concat(F.lit("place"), (F.col("user_id") % 7).cast("string")).alias("place"), operation.alias("operation"), event.alias("event"), F.col("event_id").alias("seq"))


_REPORTS = """WITH r AS (SELECT 'place' || (user_id % 7) AS place, event_id // 400 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS operation, event_id AS seq,
    CASE WHEN event_id % 17 = 0 THEN 'finished' WHEN event_id % 19 = 0 THEN 'unavailable' WHEN event_id % 23 = 0 THEN 'not connected' WHEN event_id % 29 = 0 THEN 'started' ELSE 'row' END AS event FROM events),
  l AS (SELECT place, max(operation) AS operation FROM r GROUP BY place), i AS (SELECT place, max(operation) AS inventory FROM r WHERE event = 'finished' GROUP BY place),
  s AS (SELECT l.place, l.operation, coalesce((SELECT CASE max_by(event, seq) WHEN 'finished' THEN 'Ready' WHEN 'unavailable' THEN 'Unavailable' WHEN 'not connected' THEN 'Not connected' END FROM r WHERE r.place = l.place AND r.operation = l.operation AND event NOT IN ('row', 'started')), 'Checking') AS state, inventory FROM l LEFT JOIN i ON i.place = l.place) """


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of each place after its reports came as a stream, in files of some hundred events."""
    arrived = fresh(spark, "reports")
    rows = reports(spark, d)
    rows.repartitionByRange(8, "seq").write.parquet(arrived)
    into = fresh(spark, "snapshots")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(arrived)
    query = P.follow(stream, into, fresh(spark, "places"))
    P.stopped(query, spark.read.parquet(arrived).count())
    return P.latest(spark.read.parquet(into)).select("place", "operation", "state", "inventory", "rows")


def kept_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Which book each copy belongs to, after copies came, changed, went and came again in four batches, of which one holds late answers."""
    root = fresh(spark, "resolved")
    c = copies(spark, d).withColumns({"series_index": F.col("series_index").cast("double"), "seen": F.lit(1).cast("bigint"), "gone": F.lit(False)})
    I.upsert(c.where("copy_id % 3 > 0"), 0, root)
    I.upsert(c.withColumns({"seen": F.lit(3).cast("bigint"), "gone": F.col("copy_id") % 5 == 0}).where("copy_id % 3 = 0 OR copy_id % 5 = 0"), 1, root)
    I.upsert(c.withColumns({"seen": F.lit(2).cast("bigint"), "gone": F.col("copy_id") % 2 == 0}).where("copy_id % 3 = 0 OR copy_id % 5 = 0"), 2, root)  # late
    I.upsert(c.withColumns({"seen": F.lit(4).cast("bigint"), "sha": F.concat("sha", F.when(F.col("sha") != "", F.lit("x")).otherwise("")), "resources": F.lit(None).cast("string"), "variant_resources": F.lit(None).cast("string")}).where("copy_id % 35 = 0 OR copy_id % 11 = 0"), 3, root)
    return I.resolved(spark, root).select("copy_id", "book_id")


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after its copies came in two batches, of which the second renames some and takes some away."""
    table = fresh(spark, "catalogue")
    c = copies(spark, d).withColumns({"series_index": F.col("series_index").cast("double"), "locked": F.lit(False), "seen": F.lit(1).cast("bigint"), "gone": F.lit(False)})
    W.upsert(c.withColumn("title", F.concat(F.lit("old "), "title")), 0, table)
    W.upsert(c.withColumns({"seen": F.lit(2).cast("bigint"), "gone": F.col("copy_id") % 13 == 0}).where("copy_id % 2 = 0 OR copy_id % 13 = 0"), 1, table)
    W.upsert(c.withColumn("gone", F.lit(True)), 1, table)  # comes again, and is in already
    return W.copies(spark, table).select("copy_id", "place", "path", "title", "seen")


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were sent to a reader and what arrived: all, the beginning, something else of that length, or more."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("text").cast("binary").alias("content"))
    half = F.substring("content", F.lit(1), F.expr("octet_length(content) div 2"))
    way = F.col("doc_id") % 4
    arrived = F.when(way == 0, F.col("content")).when(way == 1, half).when(way == 2, F.concat(F.lit("#").cast("binary"), half)).otherwise(F.concat("content", F.lit("!").cast("binary")))
    return N.incomplete(t.select("path", "content"), t.select("path", arrived.alias("content")))


def spent(spark: SparkSession, d: str) -> DataFrame:
    """Requests of which some lie, byte for byte, in the archive beside them."""
    c = copies(spark, d).select("copy_id", F.concat(F.lit("d"), (F.col("copy_id") % 9).cast("string"), F.when(F.col("copy_id") % 4 == 0, F.lit("/archive/")).otherwise("/"), F.col("copy_id").cast("string"), F.when(F.col("copy_id") % 2 == 0, F.lit(".acsm")).otherwise(".ASCM")).alias("below"), F.concat(F.lit("h"), (F.col("copy_id") % 40).cast("string")).alias("sha"))
    asked = B.requests(c)
    return B.spent(asked, asked.where("below LIKE '%archive/%'")).select("below")


# Tables for people and settings ---------------------------------------------------------------------------------------------------------------


def tsv_lines(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "tsv")
    sinks.tsv(K.listing(books(spark, d)).select("title", "author", "places", "source", "bytes"), path)
    return spark.read.text(path).where("value <> 'title\tauthor\tplaces\tsource\tbytes'").select(F.col("value").alias("line"))


def pretty(spark: SparkSession, d: str) -> DataFrame:
    return sinks.pretty_json(K.entry_counts(copies(spark, d)))


def settings(spark: SparkSession, d: str) -> DataFrame:
    """Each client's settings over those of its nation, both as JSON; nothing where one can't hold."""
    c, n = F.col, spark.read.parquet(f"{d}/nation.parquet")
    mail = F.substring_index("email", "@", -1)
    own = {
        "books": F.when(c("client_id") % 2 == 0, F.concat(F.when(c("client_id") % 14 == 0, F.lit("")).otherwise("/"), "city")), "screen": F.when(c("segment") == "retail", F.lit("x4-PRO")).when(c("balance") < -500, F.lit("typewriter")),
        "reader": F.when(c("client_id") % 3 == 0, F.concat(F.when(c("client_id") % 33 == 0, F.lit("http://u@")).when(c("client_id") % 5 == 0, F.lit("http://")).otherwise(""), F.lit("10.0.0."), c("nation_id").cast("string"), F.lit(":80"))),
        "catalogue": F.when(c("client_id") % 5 > 1, F.concat(F.when(c("client_id") % 65 == 2, F.lit("ftp")).otherwise("https"), F.lit("://"), mail, F.lit("/feed"))), "show_previews": c("balance") > 2500, "colour": F.when(c("client_id") % 17 == 0, c("segment")),
    }
    theirs = {"books": F.concat(F.lit("/"), "n_name"), "kobo": F.lit("/mnt"), "show_previews": F.lit(True), "card": F.when(c("n_nationkey") % 9 == 4, F.lit("card")), "reader": F.lit("[::1]")}
    said = lambda v: F.to_json(F.struct(*[x.alias(k) for k, x in v.items()]))
    rows = spark.read.parquet(f"{d}/clients.parquet").select("client_id", "nation_id", F.when(c("client_id") % 19 > 0, said(own)).alias("own"))
    return rows.join(n.select(c("n_nationkey").alias("nation_id"), said(theirs).alias("theirs")), "nation_id", "left").select("client_id", config.layered(c("own"), c("theirs")).alias("settings"))


# Texts --------------------------------------------------------------------------------------------------------------------------------------


def forms(spark: SparkSession, d: str) -> DataFrame:
    c = copies(spark, d)
    t = F.col("title")
    return c.select(
        "copy_id", X.fold_ascii(t).alias("folded"), X.same_ascii(F.upper(t), t).alias("same"), X.trimmed(t).alias("trimmed"), X.printable(t).alias("printable"), X.xml_escaped(t).alias("escaped"), X.series_label(F.col("series"), F.col("series_index")).alias("label"),
        X.output_name(t, F.col("path"), F.col("format")).alias("output_name"), X.day_of(F.concat(F.lit(" 2025-09-0"), (F.col("copy_id") % 9 + 1).cast("string"), F.lit("T07:43"))).alias("day"), X.form_encoded(F.col("path")).alias("encoded"),
    )


def web_pages(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet")
    way, html = F.col("page_id") % 4, F.col("html")
    text = F.when(way == 0, html).when(way == 1, F.concat(F.lit("\ufeff \n<HTML>"), html)).when(way == 2, F.concat(F.lit("<feed>"), html)).otherwise(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1))
    return p.select("page_id", X.looks_like_web_page(text).alias("web_page"))


def stamps(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", X.fingerprint(F.col("event_id"), F.when(F.col("event_id") % 10 > 0, F.col("ts").cast("timestamp_ntz").cast("timestamp"))).alias("fingerprint"))


def numbers_of_text(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "store")
    x = F.when(F.length("Title") % 4 == 0, F.concat("Accessibility", F.lit("abc"))).when(F.length("Title") % 4 == 1, F.concat(F.lit("  -"), "Accessibility")).when(F.length("Title") % 4 == 2, F.lit("x")).otherwise(F.col("Accessibility"))
    return p.select("ContentID", X.integer_prefix(x).alias("number"))


def leaders(spark: SparkSession, d: str) -> DataFrame:
    """Whole lines with dots that lead to a page's number, tidied."""
    return lines(spark, d).select("doc_id", "page", X.leaders_collapsed(F.concat("text", F.lit("......"), F.col("page").cast("string"))).alias("tidy"))


def drawings(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return Y.worth_carrying(p.select("p_partkey", (F.col("p_size") * 12.0).alias("width"), (F.col("p_retailprice") % 900 - 30).alias("height"))).select("p_partkey")


def placed_figures(spark: SparkSession, d: str) -> DataFrame:
    """Where a figure a third of the way down each page stands among its lines."""
    rows = lines(spark, d).select("doc_id", "page", "y", "line", "text")
    figures = rows.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0).alias("figure"), F.lit(580.0).cast("float").alias("top"))
    both = V.interleaved(rows, figures)
    return both.groupBy("doc_id", "page").agg(F.sum(F.when(F.col("line").isNotNull() & (F.col("at") >= 580), 1).otherwise(0)).alias("above"), F.count("line").alias("lines"), F.count("figure").alias("figures"))


def archived(spark: SparkSession, d: str) -> DataFrame:
    c = copies(spark, d).select(F.concat(F.lit("in"), (F.col("copy_id") % 5).cast("string"), F.lit("/r"), (F.col("copy_id") % 30).cast("string"), F.lit(".acsm")).alias("below"), F.concat(F.lit("h"), (F.col("copy_id") % 420 % 97).cast("string")).alias("sha"), F.col("copy_id").alias("seq"))
    return B.archive_names(c)


def cells(spark: SparkSession, d: str) -> DataFrame:
    t = copies(spark, d)
    return t.select("copy_id", X.shortened(F.col("title"), 12).alias("short"), X.ending(F.col("path"), 9).alias("ending"), X.cells(F.concat("title", F.lit("日本"))).alias("cells"))


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    """What is said in each turn, in lines of 40 cells."""
    t = spread(spark.read.parquet(f"{d}/conversations.parquet"))
    return t.select("conv_id", "turn", F.array_join(X.wrapped(F.col("text"), 40), "|").alias("lines"))


def in_sight(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d).select("book_id", "title")
    return K.viewport(b, [F.lower("title"), "book_id"], 0, 40, 20)


QUERIES = {
    "archive_names": archived,
    "cells": cells,
    "wrapped_words": wrapped,
    "viewport": in_sight,
    "organised_targets": lambda s, d: targets(s, d, True),
    "flat_targets": lambda s, d: targets(s, d, False),
    "sync_outcomes": outcomes,
    "plan_rows": lambda s, d: S.plan_table(sync_plan(s, d)),
    "plan_summary": lambda s, d: S.plan_summary(sync_plan(s, d), "CrossPoint"),
    "copy_outcomes": copied,
    "bulk_outcomes": bulk_outcomes,
    "request_rules": requests,
    "free_space": space,
    "marked_books": marked,
    "toggled_marks": toggled,
    "cache_todo": lambda s, d: C.todo(*scan(s, d)).select("copy_id"),
    "cache_known": lambda s, d: C.known(*scan(s, d)).select("copy_id", "seen"),
    "cache_after": cache_after,
    "place_states": lambda s, d: W.states(reports(s, d)),
    "place_inventory": lambda s, d: W.inventory(reports(s, d)),
    "place_snapshots": snapshots,
    "kept_resolved": kept_resolved,
    "streamed_copies": streamed,
    "incomplete_uploads": uploads,
    "spent_requests": spent,
    "tsv_lines": tsv_lines,
    "pretty_json": pretty,
    "settings_layers": settings,
    "text_forms": forms,
    "web_pages": web_pages,
    "fingerprints": stamps,
    "integer_prefixes": numbers_of_text,
    "leaders": leaders,
    "drawings_worth": drawings,
    "placed_figures": placed_figures,
    "device_order": lambda s, d: ranks.numbered(store(s, d).select("id", X.fold_ascii(F.col("title")).alias("folded")), [F.col("folded"), F.col("id")]).select("id", F.col("place").cast("int").alias("place")),
}
_TITLE_NAME = "regexp_replace(regexp_replace(title, '[\\p{Cc}<>:\"/\\\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g')"
_SOURCE = "best_place || ' (' || CASE WHEN best_sha = '' THEN 'unreadable' WHEN best_optimized THEN 'device copy' ELSE 'original' END || ')'"


def _request_sql() -> str:
    parts = []
    for p in K.PLACES:
        read = "WHEN best_format = 'pdf' THEN 'blocked: not read yet' WHEN best_format <> 'epub' THEN 'blocked: reader shows only EPUB' ELSE 'ready: copy, optimized'" if p == "CrossPoint" else "ELSE 'ready: copy'"
        asked = "ready: fulfil ACSM" if p == "Local" else "blocked: local first"
        parts.append(f"SELECT book_id, '{p}' AS target, CASE WHEN book_id % 11 = 0 THEN '{asked}' WHEN on_{p.lower()} THEN 'blocked: already here' {read} END AS rule FROM books")
    return f"SELECT book_id, target, split_part(rule, ': ', 1) AS decision, split_part(rule, ': ', 2) AS why FROM ({' UNION ALL '.join(parts)})"


ORACLE = {
    "archive_names": _COPIES + """, r AS (SELECT 'in' || (copy_id % 5) || '/' AS folder, 'r' || (copy_id % 30) AS stem, 'h' || (copy_id % 420 % 97) AS sha, copy_id AS seq FROM copies),
        f AS (SELECT folder, stem, sha, row_number() OVER (PARTITION BY folder, stem ORDER BY min(seq)) - 1 AS nth FROM r GROUP BY folder, stem, sha)
        SELECT r.folder || r.stem || '.acsm' AS below, r.sha, seq, r.folder || 'archive/' || r.stem || CASE WHEN nth > 0 THEN '-' || nth ELSE '' END || '.acsm' AS archived FROM r JOIN f ON f.folder = r.folder AND f.stem = r.stem AND f.sha = r.sha""",
    "cells": _COPIES + """, t AS (SELECT copy_id, regexp_replace(title, '\\p{Cc}', ' ', 'g') AS title, path FROM copies) SELECT copy_id, CASE WHEN length(title) <= 12 THEN title ELSE substr(title, 1, 11) || '…' END AS short,
        CASE WHEN length(path) <= 9 THEN path ELSE '…' || right(path, 8) END AS ending, CAST(length(title) + 4 AS INT) AS cells FROM t""",
    "wrapped_words": r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda w : w <> '') AS words FROM conversations)
        SELECT conv_id, turn, CASE WHEN len(words) = 0 THEN '' ELSE list_reduce(words, lambda a, w : CASE WHEN length(split_part(a, '|', -1)) + 1 + length(w) > 40 THEN a || '|' || w ELSE a || ' ' || w END) END AS lines FROM t""",
    "viewport": _BOOKS + "SELECT book_id, title FROM books ORDER BY lower(title), book_id LIMIT 20 OFFSET 23",
    "sync_plan": _PLAN + "SELECT id, status, detail FROM planned",
    "sync_report": _PLAN + "SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE status = '{s}') AS BIGINT) AS {s}" for s in ("present", "duplicate", "failed", "repair", "transfer")) + " FROM planned",
    "sync_outcomes": _PLAN + "SELECT id, CASE WHEN status = 'transfer' AND id % 5 = 0 THEN 'failed' WHEN status = 'transfer' THEN 'sent' ELSE status END AS status, CASE WHEN status = 'transfer' AND id % 5 = 0 THEN 'the card is full' ELSE detail END AS detail FROM planned",
    "plan_rows": _PLAN + "SELECT id, CASE status WHEN 'failed' THEN 'failed: ' || detail WHEN 'transfer' THEN 'planned' ELSE status END AS outcome FROM planned",
    "plan_summary": _PLAN + """SELECT CASE WHEN count(*) = 0 THEN 'Nothing to copy: every book is already at CrossPoint.' ELSE (count(*) - count(*) FILTER (WHERE status = 'failed')) || ' book(s) would be copied to CrossPoint'
        || CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN '; ' || count(*) FILTER (WHERE status = 'failed') || ' failed' ELSE '' END || chr(10) || 'This was a dry run. Add --apply to copy them.' END AS summary FROM planned""",
    "organised_targets": _COPIES + f""", named AS (SELECT *, {_PART.format("author")} AS folder, {_PART.format("title")} AS stem FROM copies)
        SELECT copy_id AS id, CASE lower(folder) WHEN 'src1' THEN 'SRC1' WHEN 'src2' THEN 'Src2' WHEN 'other' THEN 'other' ELSE {_NAME.format("folder", "Unknown author")} END || '/' || {_NAME.format("stem", "Untitled")} || '.' || format AS target FROM named""",
    "flat_targets": _COPIES + " SELECT copy_id AS id, copy_id || '.' || format AS target FROM copies",
    "copy_outcomes": _COPIES + """, w AS (SELECT copy_id AS id, copy_id % 31 = 0 OR copy_id % 37 = 0 OR copy_id % 41 = 0 AS odd, 'n' || copy_id || '.' || format AS name, size FROM copies WHERE place = 'Kobo'),
        o AS (SELECT *, CASE WHEN odd THEN 'not a suitable name' WHEN id % 4 < 2 AND id % 43 = 0 THEN 'the name is taken by a folder' WHEN id % 4 = 0 THEN 'already there' WHEN id % 4 = 1 THEN 'a different file is there' WHEN size > 600000 THEN 'not enough space' ELSE 'copied' END AS outcome FROM w)
        SELECT id, outcome, CASE outcome WHEN 'copied' THEN 'Books/' || name WHEN 'already there' THEN 'Books/' || upper(name) END AS path FROM o""",
    "bulk_outcomes": _COPIES + "SELECT copy_id AS id, copy_id % 13 <> 0 AS ok, CASE WHEN copy_id % 13 = 0 THEN 'the card is full' ELSE path || ': ' || size END AS detail FROM copies",
    "request_rules": _BOOKS + _request_sql(),
    "free_space": _BOOKS + f""", asked AS ({' UNION ALL '.join(f"SELECT '{p}' AS place, NOT on_{p.lower()} AS misses, best_size FROM books WHERE book_id % 11 <> 0" for p in K.PLACES)}),
        summed AS (SELECT place, CAST(sum(CASE WHEN misses THEN 1 ELSE 0 END) AS BIGINT) AS books, CAST(sum(CASE WHEN misses THEN best_size ELSE 0 END) AS BIGINT) AS bytes FROM asked GROUP BY place)
        SELECT place, books, bytes, bytes <= CASE place WHEN 'Local' THEN 1000000000000000 WHEN 'Kobo' THEN 1000 END AS fits FROM summed""",
    "marked_books": _BOOKS + "SELECT book_id, count(*) AS n_copies FROM resolved GROUP BY book_id HAVING bool_or(copy_id % 10 = 3)",
    "toggled_marks": _COPIES + """, m AS (SELECT place, path FROM copies WHERE copy_id % 10 = 3), k AS (SELECT place, path FROM copies WHERE place = 'Kobo')
        SELECT place, path, 1 AS times FROM (SELECT * FROM m UNION SELECT * FROM k) UNION ALL SELECT place, path, 2 FROM (SELECT * FROM m EXCEPT SELECT * FROM k)""",
    "cache_todo": _SCAN + "SELECT copy_id FROM listing WHERE copy_id % 3 = 0 OR copy_id % 50 = 0",
    "cache_known": _SCAN + "SELECT copy_id, copy_id AS seen FROM listing WHERE copy_id % 3 > 0 AND copy_id % 50 > 0",
    "cache_after": _SCAN + """, after AS (SELECT key, 7776500 AS seen FROM listing WHERE key IS NOT NULL UNION ALL SELECT key, seen FROM cache WHERE starts_with(key, 'gone'))
        SELECT key, CAST(seen AS BIGINT) AS seen FROM after WHERE seen >= 500 ORDER BY seen DESC, key LIMIT 20000""",
    "place_states": _REPORTS + "SELECT place, operation, state, inventory FROM s",
    "place_snapshots": _REPORTS + "SELECT s.place, s.operation, state, inventory, (SELECT count(*) FROM r WHERE r.place = s.place AND r.operation = s.operation AND event = 'row') AS rows FROM s",
    "kept_resolved": _COPIES.rstrip() + """, changed AS (SELECT * REPLACE (CASE WHEN copy_id % 35 = 0 OR copy_id % 11 = 0 THEN CASE WHEN sha = '' THEN '' ELSE sha || 'x' END ELSE sha END AS sha, CASE WHEN copy_id % 35 > 0 AND copy_id % 11 > 0 THEN resources END AS resources,
        CASE WHEN copy_id % 35 > 0 AND copy_id % 11 > 0 THEN variant_resources END AS variant_resources) FROM copies WHERE copy_id % 5 > 0 OR copy_id % 35 = 0 OR copy_id % 11 = 0), """ + _KEYS.replace("FROM copies", "FROM changed").replace("copies.*", "changed.*").replace("JOIN (SELECT a", "JOIN (SELECT a").replace("ON r.a = copies.copy_id", "ON r.a = changed.copy_id") + " SELECT copy_id, book_id FROM resolved",
    "place_inventory": _REPORTS + "SELECT r.place, r.operation, r.event, r.seq FROM r JOIN s ON s.place = r.place AND s.inventory = r.operation WHERE event = 'row'",
    "streamed_copies": _COPIES + "SELECT copy_id, place, path, CASE WHEN copy_id % 2 = 0 THEN title ELSE 'old ' || title END AS title, CAST(CASE WHEN copy_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS seen FROM copies WHERE copy_id % 13 <> 0",
    "incomplete_uploads": "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 4 = 1 AND octet_length(encode(text)) > 0 OR doc_id % 4 = 2 AND octet_length(encode(text)) > 2 AND regexp_matches(text, '^#+$')",
    "spent_requests": _COPIES + """, r AS (SELECT 'd' || (copy_id % 9) AS folder, copy_id % 4 = 0 AS archived, 'h' || (copy_id % 40) AS sha, 'd' || (copy_id % 9) || '/' || copy_id || CASE WHEN copy_id % 2 = 0 THEN '.acsm' ELSE '.ASCM' END AS below FROM copies)
        SELECT below FROM r WHERE NOT archived AND NOT EXISTS (SELECT 1 FROM r a WHERE a.archived AND a.folder = r.folder AND a.sha = r.sha)""",
    "tsv_lines": _BOOKS + f"""SELECT regexp_replace(title, '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g') || chr(9) || author || chr(9) || {_PLACES} || chr(9) || {_SOURCE} || chr(9) || best_size AS line FROM books""",
    "pretty_json": _COPIES + """, c AS (SELECT place, count(*) AS n, sum(CASE WHEN sha = '' THEN 1 ELSE 0 END) AS u FROM copies GROUP BY place) SELECT '{' || chr(10) || '  "place" : "' || place || '",' || chr(10) || '  "entries" : ' || n || ',' || chr(10) || '  "unreadable" : ' || u || chr(10) || '}' AS json FROM c""",
    "settings_layers": """WITH c AS (SELECT client_id, nation_id, client_id % 19 > 0 AS own, CASE WHEN client_id % 2 = 0 THEN CASE WHEN client_id % 14 = 0 THEN '' ELSE '/' END || city END AS books, CASE WHEN segment = 'retail' THEN 'x4-PRO' WHEN balance < -500 THEN 'typewriter' END AS screen,
          CASE WHEN client_id % 3 = 0 THEN CASE WHEN client_id % 33 = 0 THEN 'http://u@' WHEN client_id % 5 = 0 THEN 'http://' ELSE '' END || '10.0.0.' || nation_id || ':80' END AS reader, CASE WHEN client_id % 5 > 1 THEN CASE WHEN client_id % 65 = 2 THEN 'ftp' ELSE 'https' END || '://' || split_part(email, '@', -1) || '/feed' END AS catalogue,
          balance > 2500 AS previews, client_id % 17 = 0 AND segment IS NOT NULL AS unknown FROM clients),
        j AS (SELECT client_id, nation_id, n_nationkey, n_name, own, CASE WHEN own THEN books END AS books, CASE WHEN own THEN screen END AS screen, CASE WHEN own THEN reader END AS reader, CASE WHEN own THEN catalogue END AS catalogue, CASE WHEN own THEN previews END AS previews, own AND unknown AS unknown FROM c LEFT JOIN nation ON n_nationkey = nation_id)
        SELECT client_id, CASE WHEN NOT coalesce(unknown, false) AND coalesce(starts_with(books, '/'), true) AND coalesce(screen, '') <> 'typewriter' AND NOT coalesce(contains(reader, '@'), false) AND NOT coalesce(starts_with(catalogue, 'ftp'), false) AND coalesce(n_nationkey % 9, 0) <> 4 THEN '{' || concat_ws(',', '"books":"' || coalesce(books, '/' || n_name) || '"',
          '"catalogue":"' || catalogue || '"', CASE WHEN n_name IS NOT NULL THEN '"kobo":"/mnt"' END, '"reader":"' || coalesce(reader, CASE WHEN n_name IS NOT NULL THEN '[::1]' END) || '"', '"screen":"' || screen || '"', '"show_previews":' || CAST(coalesce(previews, n_name IS NOT NULL OR NULL) AS VARCHAR)) || '}' END AS settings FROM j""",
    "text_forms": _COPIES + f"""SELECT copy_id, translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded, translate(upper(title), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS same,
        regexp_replace(title, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS trimmed, regexp_replace(title, '\\p{{Cc}}', ' ', 'g') AS printable,
        replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
        CASE WHEN series IS NOT NULL THEN series || ' ' || CASE WHEN series_index = floor(series_index) THEN CAST(CAST(series_index AS BIGINT) AS VARCHAR) ELSE CAST(series_index AS VARCHAR) END END AS label,
        CASE WHEN {_TITLE_NAME} = '' THEN 'Book' ELSE {_TITLE_NAME} END || ' [' || substr(sha256(path), 1, 12) || '].' || format AS output_name, '2025-09-0' || (copy_id % 9 + 1) AS day, replace(path, '/', '%2F') AS encoded FROM copies""",
    "web_pages": r"""SELECT page_id, regexp_matches(regexp_replace(CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN chr(65279) || ' ' || chr(10) || '<HTML>' || html WHEN 2 THEN '<feed>' || html ELSE regexp_extract(html, '(?s)<article>(.*)</article>', 1) END, '^[\s\p{Z}\x{FEFF}]+', ''), '^(?i)(<!doctype html|<html)') AS web_page FROM pages""",
    "fingerprints": "SELECT event_id, CASE WHEN event_id % 10 > 0 THEN event_id || '.' || (epoch_us(ts) // 1000000) || '.' || lpad(CAST(epoch_us(ts) % 1000000 * 1000 AS VARCHAR), 9, '0') END AS fingerprint FROM events",
    "integer_prefixes": _STORE.replace("device AS", "d0 AS") + "SELECT ContentID, CASE length(Title) % 4 WHEN 1 THEN -CAST(Accessibility AS BIGINT) WHEN 2 THEN 0 ELSE CAST(Accessibility AS BIGINT) END AS number FROM store",
    "leaders": _LINES + """, t AS (SELECT doc_id, page, text || '......' || page AS t FROM lines) SELECT doc_id, page, regexp_replace(regexp_replace(regexp_replace(t, '\\.{4,}$', ' …'), '\\.{4,}', ' … ', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS tidy FROM t""",
    "drawings_worth": "SELECT p_partkey FROM (SELECT p_partkey, p_size * 12.0 AS w, abs(p_retailprice % 900 - 30) AS h FROM part) WHERE w >= 24 AND h >= 24 AND NOT (w >= 0.9 * 595 AND h >= 0.9 * 842)",
    "placed_figures": _LINES + "SELECT doc_id, page, CAST(sum(CASE WHEN y >= 580 THEN 1 ELSE 0 END) AS BIGINT) AS above, count(*) AS lines, CAST(1 AS BIGINT) AS figures FROM lines GROUP BY doc_id, page",
    "device_order": _STORE + "SELECT id, CAST(row_number() OVER (ORDER BY translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id) AS INT) AS place FROM device",
}
