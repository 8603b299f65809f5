"""Queries over a device's database, the copy log and catalogue feeds, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import media as M
from shelfspark.operators import copylog as L
from shelfspark.operators import device as D
from shelfspark.operators import feed as E
from shelfspark.operators import segments as G
from shelfspark.plans.library import _size
from shelfspark.sources.adapters import view, with_views
from shelfspark.storage import fresh
from shelfspark.streaming import catalogue as W


def notes(spark: SparkSession, d: str) -> DataFrame:
    return D.annotations(view(spark, d, "marks"), view(spark, d, "content"))


def shelves(spark: SparkSession, d: str) -> DataFrame:
    return D.shelved(view(spark, d, "shelf"), view(spark, d, "shelf_content"), view(spark, d, "shelf_titles"))


def store(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "store")
    return D.store_books(s, s.where("has_keys").select(F.col("ContentID").alias("volumeid")), s.where("downloaded").select(F.col("ContentID").alias("id")))


def encrypted_twin(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "store").select(F.col("ContentID").alias("id"), F.col("has_keys").alias("encrypted"), F.length("Title").cast("bigint").alias("length"), F.sha2("Title", 256).alias("sha"))
    wrong = F.when(F.col("id").cast("bigint") % 3 == 0, F.col("length") + 1).otherwise(F.col("length"))
    files = s.select(F.concat(F.lit("/side/"), "id").alias("path"), F.concat(F.lit("urn:uuid:"), "id").alias("identifier"), wrong.alias("length"), "sha")
    return D.encrypted_twin(files, s)


def log(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "log")


def segmented(spark: SparkSession, d: str) -> DataFrame:
    """The last readable lines of the log after it came in ten appends, of which one came twice, and was compacted on the way."""
    lines, path = log(spark, d), fresh(spark, "log")
    width = lines.agg(F.max("line_no")).first()[0] // 10 + 1
    for batch in range(10):
        G.append(lines.where(F.expr(f"line_no div {width}") == batch), path, batch, [F.col("line_no")])
        if batch in (4, 8):
            G.compact(spark, path)
            G.append(lines, path, batch, [F.col("line_no")])  # comes again
    return L.tail(G.tail(spark, path, 1000).drop("seq"), 1000)


def offers(spark: SparkSession, d: str) -> DataFrame:
    return E.offers(view(spark, d, "offers"))


def best(spark: SparkSession, d: str) -> DataFrame:
    return E.best_offers(offers(spark, d))


QUERIES = {
    "notes": notes,
    "notes_by_book": lambda s, d: D.notes_by_book(notes(s, d)),
    "notes_markdown": lambda s, d: D.markdown(notes(s, d)),
    "shelves": shelves,
    "shelf_counts": lambda s, d: D.shelf_counts(shelves(s, d)),
    "shelf_totals": lambda s, d: D.shelf_totals(shelves(s, d)),
    "shelf_table": lambda s, d: D.shelf_table(shelves(s, d)),
    "shelf_list": lambda s, d: D.on_shelf(view(s, d, "shelf_titles").select(F.col("ContentID").alias("id"), "Title"), shelves(s, d), "asia"),
    "device_list": lambda s, d: D.device_list(store(s, d)),
    "device_footer": lambda s, d: D.list_footer(store(s, d)),
    "encrypted_twin": encrypted_twin,
    "log_tail": lambda s, d: L.tail(log(s, d), 20),
    "log_segments": segmented,
    "log_failed": lambda s, d: L.failed(log(s, d), 20),
    "log_by_route": lambda s, d: L.by_route(log(s, d)),
    "log_shown": lambda s, d: L.shown(L.tail(log(s, d), 200)),
    "log_compacted": lambda s, d: L.compacted(log(s, d).where("line_no % 2 = 0"), log(s, d).where("line_no % 2 = 1")),
    "log_windows": lambda s, d: W.counts_by_window(log(s, d)).select(F.unix_seconds("start").alias("start"), "copies", "failed"),
    "best_offer": best,
    "feed_counts": lambda s, d: E.feed_counts(best(s, d)),
    "feed_hidden": lambda s, d: E.hidden(best(s, d)),
    "shown_media": lambda s, d: E.media_counts(offers(s, d)),
}

_NOTES = with_views("marks", "content") + """, notes AS (SELECT coalesce(c.Title, m.VolumeID) AS title, coalesce(c.Attribution, '') AS author, regexp_replace(coalesce(m.Text, ''), '^\\s+|\\s+$', '', 'g') AS text,
  regexp_replace(coalesce(m.Annotation, ''), '^\\s+|\\s+$', '', 'g') AS note, coalesce(m.DateCreated, '') AS created, coalesce(m.ChapterProgress, 0) AS progress
  FROM marks m LEFT JOIN content c ON c.ContentID = m.VolumeID WHERE coalesce(m.Hidden, 'false') NOT IN ('true', '1')), kept AS (SELECT * FROM notes WHERE text <> '' OR note <> '') """
_SHELVES = with_views("shelf", "shelf_content", "shelf_titles") + """, live AS (SELECT * FROM shelf WHERE coalesce(_IsDeleted, 'false') NOT IN ('true', '1')), items AS (SELECT * FROM shelf_content WHERE coalesce(_IsDeleted, 'false') NOT IN ('true', '1')),
  shelves AS (SELECT DISTINCT s.Name AS shelf, i.ContentId AS id, CASE WHEN i.ContentId IS NOT NULL THEN coalesce(nullif(t.Title, ''), i.ContentId) END AS title
  FROM live s LEFT JOIN items i ON i.ShelfName IN (s.InternalName, s.Name) LEFT JOIN shelf_titles t ON t.ContentID = i.ContentId) """
_STORE = with_views("store") + """, device AS (SELECT ContentID AS id, coalesce(nullif(Title, ''), ContentID) AS title, coalesce(Attribution, '') AS author, coalesce(TRY_CAST(Accessibility AS BIGINT) = 6, false) AS preview, has_keys AS encrypted FROM store WHERE downloaded) """
_LOG = with_views("log") + " "
_TYPE = "regexp_replace(trim(split_part(media_type, ';', 1)), '/+$', '')"
_OFFERS = with_views("offers") + f""", made AS (SELECT *, CASE rel WHEN '{M.ACQUISITION}' THEN 'direct' ELSE substr(rel, {len(M.ACQUISITION) + 2}) END AS kind, {_TYPE} AS media,
  CASE {_TYPE} WHEN 'application/epub+zip' THEN 'book' WHEN 'application/pdf' THEN 'book' WHEN '{M.ADEPT}' THEN 'acsm' ELSE 'unsupported' END AS delivery,
  CASE {_TYPE} WHEN 'application/epub+zip' THEN 'epub' WHEN 'application/pdf' THEN 'pdf' WHEN '{M.ADEPT}' THEN 'epub' END AS format,
  CASE {_TYPE} WHEN 'application/epub+zip' THEN 'EPUB' WHEN 'application/pdf' THEN 'PDF' WHEN '{M.ADEPT}' THEN 'EPUB via Adobe DRM' WHEN 'text/html' THEN 'a reader in a browser, not a file' WHEN 'application/audiobook+json' THEN 'an audiobook' ELSE '{M.OTHER_REFUSAL}' END AS shown FROM offers),
  best AS (SELECT entry_id, ord, kind, delivery, format, shown, count(*) OVER (PARTITION BY entry_id) AS n_offers, row_number() OVER (PARTITION BY entry_id ORDER BY CASE delivery WHEN 'book' THEN 0 WHEN 'acsm' THEN 1 ELSE 2 END,
  CASE kind WHEN 'direct' THEN 0 WHEN 'open-access' THEN 0 WHEN 'borrow' THEN 1 WHEN 'sample' THEN 2 ELSE 3 END, ord, media_type) AS n FROM made) """
_BEST = "SELECT entry_id, ord, kind, delivery, format, shown, n_offers FROM best WHERE n = 1"

ORACLE = {
    "notes": _NOTES + "SELECT * FROM kept",
    "notes_by_book": _NOTES + "SELECT title, author, count(*) AS n_notes, CAST(sum(CASE WHEN note <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_commented, min(progress) AS first_at FROM kept GROUP BY title, author",
    "notes_markdown": _NOTES + """, parts AS (SELECT title, author, progress, created, chr(10) || CASE WHEN text <> '' THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x : '> ' || trim(x)), chr(10)) || chr(10) ELSE '' END
        || CASE WHEN note <> '' THEN CASE WHEN text <> '' THEN chr(10) ELSE '' END || note || chr(10) ELSE '' END || chr(10) || '— ' || CAST(CAST(round(progress * 100) AS BIGINT) AS VARCHAR) || '% in, ' || split_part(created, 'T', 1) || chr(10) AS part FROM kept)
        SELECT title, author, '# ' || title || chr(10) || CASE WHEN author <> '' THEN chr(10) || '*' || author || '*' || chr(10) ELSE '' END || string_agg(part, '' ORDER BY progress, created, part COLLATE "C") AS document FROM parts GROUP BY title, author""",
    "shelves": _SHELVES + "SELECT shelf, id, title FROM shelves s WHERE id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM shelves o WHERE o.shelf = s.shelf AND o.id IS NOT NULL)",
    "shelf_counts": _SHELVES + "SELECT shelf, count(id) AS n_books FROM shelves GROUP BY shelf",
    "shelf_totals": _SHELVES + "SELECT count(DISTINCT shelf) AS shelves, count(id) AS books FROM shelves",
    "shelf_table": _SHELVES + """, kept AS (SELECT shelf, id, title FROM shelves s WHERE id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM shelves o WHERE o.shelf = s.shelf AND o.id IS NOT NULL)),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY shelf ORDER BY lower(title) NULLS FIRST, id NULLS FIRST) AS INT) AS n FROM kept) SELECT shelf, CASE WHEN n = 1 THEN shelf ELSE '' END AS shown, n, id, title FROM n""",
    "shelf_list": _SHELVES + "SELECT ContentID AS id, Title FROM shelf_titles WHERE ContentID IN (SELECT id FROM shelves WHERE lower(shelf) = 'asia')",
    "device_list": _STORE + "SELECT * FROM device WHERE NOT preview",
    "device_footer": _STORE + "SELECT count(*) AS entries, CAST(sum(CASE WHEN preview THEN 0 ELSE 1 END) AS BIGINT) AS books, CAST(sum(CASE WHEN preview THEN 1 ELSE 0 END) AS BIGINT) AS previews FROM device",
    "encrypted_twin": with_views("store") + " SELECT '/side/' || ContentID AS path, ContentID AS id FROM store WHERE has_keys AND CAST(ContentID AS BIGINT) % 3 <> 0",
    "log_tail": _LOG + "SELECT * FROM (SELECT * FROM log ORDER BY line_no DESC LIMIT 20) WHERE NOT malformed",
    "log_segments": _LOG + "SELECT * FROM (SELECT * FROM log ORDER BY line_no DESC LIMIT 1000) WHERE NOT malformed",
    "log_failed": _LOG + "SELECT * FROM (SELECT * FROM (SELECT * FROM log ORDER BY line_no DESC LIMIT 1000) WHERE NOT malformed AND NOT ok ORDER BY line_no DESC LIMIT 20)",
    "log_by_route": _LOG + "SELECT from_place, to_place, count(*) AS copies, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed, CAST(sum(bytes) AS BIGINT) AS bytes FROM log WHERE NOT malformed GROUP BY from_place, to_place",
    "log_shown": _LOG + f"""SELECT line_no, strftime(make_timestamp("at" * 1000000), '%Y-%m-%d %H:%M') AS "when", title, from_place, to_place, {_size('bytes')} AS size, ok FROM (SELECT * FROM log ORDER BY line_no DESC LIMIT 200) WHERE NOT malformed""",
    "log_compacted": _LOG + "SELECT * FROM log ORDER BY line_no DESC LIMIT 5000",
    "log_windows": _LOG + """SELECT "at" // 600 * 600 AS start, count(*) AS copies, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM log GROUP BY "at" // 600""",
    "best_offer": _OFFERS + _BEST,
    "feed_counts": _OFFERS + f", b AS ({_BEST}) SELECT count(*) AS entries, CAST(sum(CASE WHEN delivery <> 'unsupported' THEN 1 ELSE 0 END) AS BIGINT) AS shown, CAST(sum(CASE WHEN delivery = 'unsupported' THEN 1 ELSE 0 END) AS BIGINT) AS hidden FROM b",
    "feed_hidden": _OFFERS + _BEST + " AND delivery = 'unsupported'",
    "shown_media": _OFFERS + "SELECT media, shown, count(*) AS n_offers FROM made GROUP BY media, shown",
}
