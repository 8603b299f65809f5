"""Queries over the catalogue, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.operators import cache as C
from shelfspark.operators import catalog as K
from shelfspark.operators import resolve as R
from shelfspark.operators import sync as S
from shelfspark.sources.adapters import view, with_views
from shelfspark.storage import materialize


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "copies")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolved(copies(spark, sf_dir))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.books(resolved(spark, sf_dir))


def of_books(f):
    return lambda spark, sf_dir: f(books(spark, sf_dir))


def of_copies(f):
    return lambda spark, sf_dir: f(resolved(spark, sf_dir))


_KEYS = """keys AS (SELECT copy_id, 's:' || sha AS key FROM copies WHERE sha <> '' UNION SELECT copy_id, 'r:' || resources FROM copies WHERE resources IS NOT NULL AND sha <> ''
  UNION SELECT copy_id, 'r:' || variant_resources FROM copies WHERE variant_resources IS NOT NULL AND sha <> ''),
edges AS (SELECT DISTINCT a.copy_id AS a, b.copy_id AS b FROM keys a JOIN keys b ON a.key = b.key),
reach AS (SELECT copy_id AS a, copy_id AS b FROM copies UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
resolved AS (SELECT copies.*, r.book_id FROM copies JOIN (SELECT a, min(b) AS book_id FROM reach GROUP BY a) r ON r.a = copies.copy_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY place_rank DESC, path DESC) AS last_arrived,
  row_number() OVER (PARTITION BY book_id ORDER BY optimized, place_rank, path DESC) AS best FROM resolved),
books AS (SELECT book_id, max(CASE WHEN last_arrived = 1 THEN title END) AS title, max(CASE WHEN last_arrived = 1 THEN author END) AS author, max(CASE WHEN last_arrived = 1 THEN series END) AS series,
  max(CASE WHEN last_arrived = 1 THEN series_index END) AS series_index, max(CASE WHEN best = 1 THEN copy_id END) AS best_id, max(CASE WHEN best = 1 THEN place END) AS best_place,
  max(CASE WHEN best = 1 THEN path END) AS best_path, max(CASE WHEN best = 1 THEN format END) AS best_format, max(CASE WHEN best = 1 THEN sha END) AS best_sha, max(CASE WHEN best = 1 THEN size END) AS best_size,
  bool_or(best = 1 AND optimized) AS best_optimized, count(*) AS n_copies, bool_or(sha = '') AS any_unreadable, bool_or(place = 'Local') AS on_local, bool_or(place = 'Kobo') AS on_kobo,
  bool_or(place = 'CrossPoint') AS on_crosspoint FROM ranked GROUP BY book_id)"""
_BOOKS = with_views("copies") + ", " + _KEYS + " "
_COPIES = with_views("copies") + " "
_PLACES = "rtrim(CASE WHEN on_local THEN 'Local,' ELSE '' END || CASE WHEN on_kobo THEN 'Kobo,' ELSE '' END || CASE WHEN on_crosspoint THEN 'CrossPoint,' ELSE '' END, ',')"


def _size(n: str) -> str:
    """As printed: one decimal, halves to the even digit, by whole-number arithmetic."""
    tenths = lambda unit: f"CASE WHEN ({n} * 10) % {unit} * 2 > {unit} OR (({n} * 10) % {unit} * 2 = {unit} AND ({n} * 10) // {unit} % 2 = 1) THEN ({n} * 10) // {unit} + 1 ELSE ({n} * 10) // {unit} END"
    part = lambda unit, name: f"CAST(({tenths(unit)}) // 10 AS VARCHAR) || '.' || CAST(({tenths(unit)}) % 10 AS VARCHAR) || ' {name}'"
    return f"CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B' WHEN {n} < 1048576 THEN {part(1024, 'KiB')} WHEN {n} < 1073741824 THEN {part(1048576, 'MiB')} ELSE {part(1073741824, 'GiB')} END"


_SERIES = "CASE WHEN series IS NULL THEN '1' ELSE '0' || lower(series) || chr(1) || lpad(printf('%.3f', coalesce(series_index, 0)), 9, '0') END"
_SEARCH = "lower(title || ' ' || author || ' ' || coalesce(series, ''))"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = books(spark, sf_dir)
    return b.select("book_id", "title", "author", "series", "places", "n_copies", F.col("preferred.path").alias("path"), F.col("preferred.size").alias("bytes"), K.source_label().alias("source")).orderBy(F.lower("title"), "author", "book_id")


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = copies(spark, sf_dir).where("format = 'epub'")
    return c.select("copy_id", X.component(X.fold_ascii(F.regexp_replace("title", "[^ -~]", "x")), "Untitled").alias("name"))


def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = resolved(spark, sf_dir)
    own = F.array_distinct(F.array_compact(F.array(F.when(F.col("sha") != "", F.col("sha")), F.col("resources"))))
    target = S.target_path(F.col("author"), F.col("title"), F.col("format"))
    rows = c.select("place", F.col("copy_id").alias("id"), "title", own.alias("identities"), target.alias("target"), F.col("size").alias("length"), F.when(F.col("sha") == "", "unreadable").alias("error"), "path")
    there = rows.where("place = 'CrossPoint'").select("path", "identities", "length")
    return S.plan(rows.where("place = 'Kobo'").drop("place", "path"), there)


def inventory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = copies(spark, sf_dir).withColumn("identities", F.array_distinct(F.array_compact(F.array(F.when(F.col("sha") != "", F.col("sha")), F.col("resources")))))
    return S.inventory_match(c.where("place = 'Local'").select(F.col("copy_id").alias("id"), "identities"), c.where("place = 'CrossPoint'").select("path", "identities"))


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = copies(spark, sf_dir)
    size = lambda stale: F.when(F.lit(stale) & (F.col("copy_id") % 20 == 0), F.col("size") + 1).otherwise(F.col("size")).cast("string")
    key = lambda stale: X.cache_key(F.col("place"), F.col("path"), size(stale))
    return c.select("place", "path", key(False).alias("key")), c.where("copy_id % 2 = 0").select(key(True).alias("key"), (F.col("copy_id") * 1000).alias("seen"))


def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = _cache(spark, sf_dir)
    return C.kept(cache, now=C.TTL + 100_000, most=300)


_CACHE = """cache AS (SELECT place || chr(1) || path || chr(1) || CAST(CASE WHEN copy_id % 20 = 0 THEN size + 1 ELSE size END AS VARCHAR) AS key, copy_id * 1000 AS seen FROM copies WHERE copy_id % 2 = 0),
listing AS (SELECT place, place || chr(1) || path || chr(1) || CAST(size AS VARCHAR) AS key FROM copies) """

_DEVICES = [("Xteink X4", 1), (" x4 ", 2), ("X4 Pro", 3), ("xteink_x4_pro", 4), ("m5paper_v11", 5), ("m5stack_papercolor", 6), ("Seeed Sticky", 7), ("PICCO", 8), ("nothing", 9)]
# Screens by device, with the other names a device goes by.
PROFILES = {
    "X4": ("xteink_x4", "Xteink X4"), "X4 Pro": ("x4pro", "xteink_x4_pro", "Xteink X4 Pro"), "X4 Classic": ("x4c", "xteink_x4_classic", "Xteink X4C"), "X3": ("xteink_x3", "xteink_x3_uc8279", "Xteink X3"),
    "Sticky": ("Seeed Sticky", "reTerminal Sticky"), "M5Paper": ("m5paper_v11", "M5Paper v1.1"), "M5Paper S3": ("m5papers3", "m5paper_s3"), "Paper Mono": ("m5stack_paper_mono", "M5PaperMono"),
    "LilyGo T5": ("lilygo", "lilygo_t5s3"), "Metalio": ("metalio", "metalio_eink4"), "EEGO A4": ("eego_a4", "EEGO Reader A4"), "Picco": ("picco",),
}


def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each device name, by squashed name or alias; a dozen profiles."""
    names = spark.createDataFrame(_DEVICES, "name string, id int")
    known = spark.createDataFrame([(d, n) for d, aliases in PROFILES.items() for n in (d, *aliases)], "device string, alias string").select("device", X.squashed(F.col("alias")).alias("k")).distinct()
    return names.join(F.broadcast(known), X.squashed(F.col("name")) == F.col("k"), "left").select("id", "name", "device")


_PROFILE_VALUES = ", ".join(f"('{d}', '{n}')" for d, aliases in PROFILES.items() for n in (d, *aliases))
_NAME_VALUES = ", ".join(f"('{n}', {i})" for n, i in _DEVICES)


def locate_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("/src1",), ("/src1/1",), ("/src2",)], "root string")
    names = copies(spark, sf_dir).select(F.regexp_replace("path", "^/(src1)/1", "/$1/1/").alias("source"))
    return K.located(names, roots)


def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report(sync_plan(spark, sf_dir))


_DEST_RULE = """CASE WHEN {has} THEN 'blocked: already here' {reader} ELSE 'ready: copy{more}' END"""
_READER = "WHEN best_format = 'pdf' THEN 'blocked: not read yet' WHEN best_format <> 'epub' THEN 'blocked: reader shows only EPUB'"


def _destination_sql() -> str:
    parts = []
    for p in K.PLACES:
        rule = _DEST_RULE.format(has=f"on_{p.lower()}", reader=_READER if p == "CrossPoint" else "", more=", optimized" if p == "CrossPoint" else "")
        parts.append(f"SELECT book_id, '{p}' AS target, {rule} AS rule FROM books")
    return f"decisions AS (SELECT book_id, target, split_part(rule, ': ', 1) AS decision, split_part(rule, ': ', 2) AS why FROM ({' UNION ALL '.join(parts)})) "


def _destinations(b: DataFrame) -> DataFrame:
    b = materialize(b, "books")
    out = K.destination(b, "Local")
    return out.unionByName(K.destination(b, "Kobo")).unionByName(K.destination(b, "CrossPoint"))


def _listed(b: DataFrame) -> DataFrame:
    return b.select("book_id", "title")


QUERIES = {
    "catalog": catalog,
    "catalog_components": of_copies(lambda c: c.select("copy_id", "book_id")),
    "preferred_copy": of_books(lambda b: b.select("book_id", F.col("preferred.copy_id").alias("copy_id"), "preferred.place", "preferred.path", "preferred.format", "preferred.sha")),
    "listing": of_books(K.listing),
    "place_entry_counts": lambda spark, d: K.entry_counts(copies(spark, d)),
    "place_status_text": lambda spark, d: K.status_text(K.entry_counts(copies(spark, d))),
    "place_book_counts": of_books(K.book_counts),
    "presence": of_copies(K.presence),
    **{f"filter_missing_{p.lower()}": of_books(lambda b, p=p: _listed(K.missing(b, p))) for p in K.PLACES},
    "filter_only_crosspoint": of_books(lambda b: _listed(K.only(b, "CrossPoint"))),
    "filter_unreadable": of_books(lambda b: _listed(K.unreadable(b))),
    "search_plain": of_books(lambda b: _listed(K.search(b, "The Th"))),
    "search_author": of_books(lambda b: _listed(K.search(b, "author: SRC1"))),
    "search_title": of_books(lambda b: _listed(K.search(b, "title:th"))),
    "search_series": of_books(lambda b: _listed(K.search(b, "series:fr"))),
    "sort_series": of_books(lambda b: K.ordered(b, "series").select("book_id", "series_key", "title_key")),
    "sync_diff": of_books(lambda b: K.to_transfer(b, "Local", "CrossPoint").select("book_id", "title", F.col("preferred.place").alias("place"), F.col("preferred.size").alias("size"))),
    "required_space": of_books(K.required_space),
    "destination_rules": of_books(_destinations),
    "destination_counts": of_books(lambda b: K.destination_counts(_destinations(b))),
    "removal_rules": of_copies(K.removal),
    "transfer_check": of_books(lambda b: S.transfer_check(b, "CrossPoint")),
    "duplicates_within_book": of_copies(K.several_at_one_place),
    "case_collisions": lambda spark, d: S.case_collisions(copies(spark, d).select(S.target_path(F.col("author"), F.regexp_replace("title", "[^A-Za-z ]", ""), F.col("format")).alias("path"))),
    "inventory_match": inventory_match,
    "sync_plan": sync_plan,
    "sync_report": sync_report,
    "cache_split": lambda spark, d: C.split_counts(*_cache(spark, d)),
    "cache_evict": cache_evict,
    "profile_lookup": profile_lookup,
    "locate_root": locate_root,
    "safe_names": safe_names,
    "file_ids": lambda spark, d: copies(spark, d).select("copy_id", X.file_id(F.col("path")).alias("file_id"), X.output_name(F.lit("A Book: One?"), F.col("path"), F.col("format")).alias("output_name")),
    "name_titles": lambda spark, d: copies(spark, d).select("copy_id", X.title_of_path(F.col("path")).alias("name_title"), X.format_of(F.upper("path")).alias("format")),
}

ORACLE = {
    "catalog": _BOOKS + f"""SELECT book_id, title, author, series, {_PLACES} AS places, n_copies, best_path AS path, best_size AS bytes,
        best_place || ' (' || CASE WHEN best_sha = '' THEN 'unreadable' WHEN best_optimized THEN 'device copy' ELSE 'original' END || ')' AS source FROM books""",
    "catalog_components": _BOOKS + "SELECT copy_id, book_id FROM resolved",
    "preferred_copy": _BOOKS + "SELECT book_id, best_id AS copy_id, best_place AS place, best_path AS path, best_format AS format, best_sha AS sha FROM books",
    "listing": _BOOKS + f"""SELECT regexp_replace(title, '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g') AS title, author, {_PLACES} AS places,
        best_place || ' (' || CASE WHEN best_sha = '' THEN 'unreadable' WHEN best_optimized THEN 'device copy' ELSE 'original' END || ')' AS source, best_size AS bytes, book_id FROM books""",
    "place_entry_counts": _COPIES + "SELECT place, count(*) AS entries, CAST(sum(CASE WHEN sha = '' THEN 1 ELSE 0 END) AS BIGINT) AS unreadable FROM copies GROUP BY place",
    "place_status_text": _COPIES + "SELECT place, 'Ready (' || count(*) || ' book' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ', ' || sum(CASE WHEN sha = '' THEN 1 ELSE 0 END) || ' unreadable)' AS status FROM copies GROUP BY place",
    "place_book_counts": _BOOKS + "SELECT place, count(DISTINCT book_id) AS books FROM resolved GROUP BY place",
    "presence": _BOOKS + """, firsts AS (SELECT book_id, place, CASE WHEN sha = '' THEN 'unreadable' WHEN optimized THEN 'device copy' ELSE 'original' END AS state, row_number() OVER (PARTITION BY book_id, place ORDER BY place_rank, path) AS n FROM resolved)
        SELECT book_id, coalesce(max(CASE WHEN place = 'Local' THEN state END), 'absent') AS local, coalesce(max(CASE WHEN place = 'Kobo' THEN state END), 'absent') AS kobo,
        coalesce(max(CASE WHEN place = 'CrossPoint' THEN state END), 'absent') AS crosspoint FROM firsts WHERE n = 1 GROUP BY book_id""",
    **{f"filter_missing_{p.lower()}": _BOOKS + f"SELECT book_id, title FROM books WHERE NOT on_{p.lower()}" for p in K.PLACES},
    "filter_only_crosspoint": _BOOKS + "SELECT book_id, title FROM books WHERE NOT on_local AND NOT on_kobo",
    "filter_unreadable": _BOOKS + "SELECT book_id, title FROM books WHERE any_unreadable",
    "search_plain": _BOOKS + f"SELECT book_id, title FROM books WHERE contains({_SEARCH}, 'the th')",
    "search_author": _BOOKS + "SELECT book_id, title FROM books WHERE contains(lower(author), 'src1')",
    "search_title": _BOOKS + "SELECT book_id, title FROM books WHERE contains(lower(title), 'th')",
    "search_series": _BOOKS + f"SELECT book_id, title FROM books WHERE contains({_SERIES}, 'fr')",
    "sort_series": _BOOKS + f"SELECT book_id, {_SERIES} AS series_key, lower(title) AS title_key FROM books",
    "sync_diff": _BOOKS + "SELECT book_id, title, best_place AS place, best_size AS size FROM books WHERE on_local AND NOT on_crosspoint AND best_sha <> ''",
    "required_space": _BOOKS + f""", asked AS ({' UNION ALL '.join(f"SELECT '{p}' AS place, NOT on_{p.lower()} AS misses, best_size FROM books" for p in K.PLACES)}),
        summed AS (SELECT place, CAST(sum(CASE WHEN misses THEN 1 ELSE 0 END) AS BIGINT) AS books, CAST(sum(CASE WHEN misses THEN best_size ELSE 0 END) AS BIGINT) AS bytes FROM asked GROUP BY place) SELECT place, books, bytes, {_size('bytes')} AS shown FROM summed""",
    "destination_rules": _BOOKS + ", " + _destination_sql() + "SELECT * FROM decisions",
    "destination_counts": _BOOKS + ", " + _destination_sql() + """SELECT target, CAST(sum(CASE WHEN decision = 'ready' THEN 1 ELSE 0 END) AS BIGINT) AS ready, CAST(sum(CASE WHEN decision = 'ask' THEN 1 ELSE 0 END) AS BIGINT) AS ask,
        CAST(sum(CASE WHEN decision = 'blocked' THEN 1 ELSE 0 END) AS BIGINT) AS blocked, min_by(why, book_id) FILTER (WHERE decision = 'blocked') AS first_blocked FROM decisions GROUP BY target""",
    "removal_rules": _BOOKS + """SELECT copy_id, r.book_id, CASE WHEN n_copies < 2 THEN 'only copy' WHEN locked THEN 'Kobo library' WHEN sha = '' THEN 'unreadable' WHEN place <> 'CrossPoint' THEN 'add only' ELSE 'ready' END AS removal
        FROM resolved r JOIN books b ON r.book_id = b.book_id""",
    "transfer_check": _BOOKS + """SELECT book_id, CASE WHEN best_sha = '' THEN 'unreadable' WHEN best_place = 'CrossPoint' THEN 'source is the target' WHEN best_format NOT IN ('epub', 'pdf') THEN 'reader shows only EPUB' ELSE 'ready' END AS "check" FROM books""",
    "duplicates_within_book": _BOOKS + "SELECT book_id, place, count(*) AS n_copies FROM resolved GROUP BY book_id, place HAVING count(*) > 1",
    "case_collisions": _COPIES + """, p AS (SELECT author || '/' || coalesce(nullif(regexp_replace(regexp_replace(title, '[^A-Za-z ]', '', 'g'), '^ +| +$', '', 'g'), ''), 'Untitled') || '.' || format AS path FROM copies)
        SELECT lower(path) AS folded, count(*) AS n_paths FROM p GROUP BY lower(path) HAVING count(*) > 1""",
    "inventory_match": _COPIES + """, i AS (SELECT copy_id, place, path, sha AS identity FROM copies WHERE sha <> '' UNION SELECT copy_id, place, path, resources FROM copies WHERE resources IS NOT NULL)
        SELECT a.copy_id AS id, min(b.path) AS path FROM i a JOIN i b ON a.identity = b.identity WHERE a.place = 'Local' AND b.place = 'CrossPoint' GROUP BY a.copy_id""",
    "cache_split": _COPIES + ", " + _CACHE + "SELECT place, count(cache.key) AS known, count(*) - count(cache.key) AS todo FROM listing LEFT JOIN cache ON listing.key = cache.key GROUP BY place",
    "cache_evict": _COPIES + ", " + _CACHE + "SELECT key, seen FROM cache WHERE seen >= 100000 ORDER BY seen DESC, key LIMIT 300",
    "profile_lookup": f"""WITH p(device, alias) AS (VALUES {_PROFILE_VALUES}), n(name, id) AS (VALUES {_NAME_VALUES}), k AS (SELECT DISTINCT device, lower(regexp_replace(alias, '[^A-Za-z0-9]', '', 'g')) AS k FROM p)
        SELECT id, name, device FROM n LEFT JOIN k ON lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) = k""",
    "locate_root": _COPIES + """, s AS (SELECT DISTINCT regexp_replace(path, '^/(src1)/1', '/\\1/1/') AS source FROM copies), r(root) AS (VALUES ('/src1'), ('/src1/1'), ('/src2')),
        m AS (SELECT source, max_by(root, length(root)) AS root FROM s LEFT JOIN r ON starts_with(source, root || '/') GROUP BY source) SELECT source, root, CASE WHEN root IS NOT NULL THEN substr(source, length(root) + 2) END AS below FROM m""",
    "safe_names": _COPIES + """, t AS (SELECT copy_id, regexp_replace(regexp_replace(lower(regexp_replace(title, '[^ -~]', 'x', 'g')), '[<>:"/\\\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS name FROM copies WHERE format = 'epub')
        SELECT copy_id, CASE WHEN name = '' THEN 'Untitled' ELSE name END AS name FROM t""",
    "file_ids": _COPIES + "SELECT copy_id, 'file:' || substr(sha256(path), 1, 24) AS file_id, 'A Book_ One_ [' || substr(sha256(path), 1, 12) || '].' || format AS output_name FROM copies",
    "name_titles": _COPIES + "SELECT copy_id, CAST(copy_id AS VARCHAR) AS name_title, format FROM copies",
}
