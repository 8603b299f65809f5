"""Views that give the generated tables the shapes of a library.

Each view is a SQL query in the dialect that both engines read; `spark_sql` puts in what only one spells otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.storage import spread

# {sha}: hexadecimal SHA-256 of a text; {seconds}: whole seconds of a timestamp.
_DIALECTS = {
    "spark": {"sha": lambda x: f"sha2({x}, 256)", "seconds": lambda x: f"unix_seconds(CAST({x} AS TIMESTAMP))", "text": "STRING", "right": lambda x, n: f"right({x}, {n})"},
    "duckdb": {"sha": lambda x: f"sha256({x})", "seconds": lambda x: f"CAST(floor(epoch({x})) AS BIGINT)", "text": "VARCHAR", "right": lambda x, n: f"right({x}, {n})"},
}


def _views(d: dict) -> dict[str, tuple[str, tuple[str, ...]]]:
    sha, seconds, text = d["sha"], d["seconds"], d["text"]
    format_ = "CASE doc_id % 10 WHEN 9 THEN 'pdf' WHEN 8 THEN 'cbz' ELSE 'epub' END"
    return {
        "copies": (
            f"""SELECT doc_id AS copy_id, CASE doc_id % 3 WHEN 0 THEN 'Local' WHEN 1 THEN 'Kobo' ELSE 'CrossPoint' END AS place, CAST(doc_id % 3 AS INT) AS place_rank,
            {format_} AS format, '/' || source || '/' || CAST(doc_id AS {text}) || '.' || {format_} AS path, substr(text, 1, 24) AS title, source AS author,
            CASE WHEN doc_id % 4 = 0 THEN lang END AS series, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 25 AS DOUBLE) / 2 END AS series_index, n_chars * 1000 AS size,
            CASE WHEN doc_id % 97 = 0 THEN '' ELSE {sha("text")} END AS sha,
            CASE WHEN doc_id % 97 <> 0 AND doc_id % 10 < 8 THEN {sha("substr(text, 1, 64)")} END AS resources,
            CASE WHEN doc_id % 97 <> 0 AND doc_id % 10 < 8 AND doc_id % 3 <> 2 THEN {sha(d["right"]("text", 64))} END AS variant_resources,
            doc_id % 3 = 2 AND doc_id % 10 < 8 AS optimized, doc_id % 3 = 1 AND doc_id % 5 = 0 AS locked FROM documents""",
            ("documents",),
        ),
        "content": (
            f"""SELECT DISTINCT CAST(conv_id AS {text}) AS ContentID, 'Conversation ' || CAST(conv_id % 40 AS {text}) AS Title,
            CASE WHEN conv_id % 5 <> 0 THEN 'Author ' || CAST(conv_id % 7 AS {text}) END AS Attribution FROM conversations WHERE conv_id % 6 <> 0""",
            ("conversations",),
        ),
        "marks": (
            f"""SELECT CAST(conv_id AS {text}) AS VolumeID, CASE WHEN role = 'user' THEN '  ' || text || ' ' END AS Text, CASE WHEN role = 'assistant' AND turn % 4 <> 3 THEN text END AS Annotation,
            '2025-09-02T07:43:13.000' AS DateCreated, CAST(turn AS DOUBLE) / 8 AS ChapterProgress, CASE turn WHEN 6 THEN 'true' WHEN 5 THEN '1' WHEN 4 THEN NULL ELSE 'false' END AS Hidden FROM conversations""",
            ("conversations",),
        ),
        "shelf": (f"SELECT 'int-' || CAST(r_regionkey AS {text}) AS InternalName, r_name AS Name, CASE WHEN r_regionkey = 3 THEN 'true' END AS _IsDeleted FROM region", ("region",)),
        "shelf_content": (
            f"""SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'int-' || CAST(r_regionkey AS {text}) ELSE r_name END AS ShelfName, CAST(n_nationkey AS {text}) AS ContentId,
            CASE WHEN n_nationkey % 5 = 0 THEN 'true' END AS _IsDeleted FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4""",
            ("nation", "region"),
        ),
        "shelf_titles": (f"SELECT CAST(n_nationkey AS {text}) AS ContentID, CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE n_name END AS Title FROM nation WHERE n_nationkey % 4 <> 0", ("nation",)),
        "log": (
            f"""SELECT event_id AS line_no, {seconds("ts")} AS at, 'Book ' || CAST(user_id AS {text}) AS title, CASE user_id % 3 WHEN 0 THEN 'Local' WHEN 1 THEN 'Kobo' ELSE 'CrossPoint' END AS from_place,
            CASE event_id % 3 WHEN 0 THEN 'Local' WHEN 1 THEN 'Kobo' ELSE 'CrossPoint' END AS to_place, CAST(floor(abs(value) * 1000) AS BIGINT) AS bytes, event_type <> 'error' AS ok, event_id % 50 = 0 AS malformed FROM events""",
            ("events",),
        ),
        "offers": (
            """SELECT l_orderkey AS entry_id, l_linenumber AS ord,
            'http://opds-spec.org/acquisition' || CASE l_linenumber % 6 WHEN 0 THEN '' WHEN 1 THEN '/borrow' WHEN 2 THEN '/open-access' WHEN 3 THEN '/sample' WHEN 4 THEN '/buy' ELSE '/subscribe' END AS rel,
            CASE l_suppkey % 6 WHEN 0 THEN 'application/epub+zip; profile=x' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'application/vnd.adobe.adept+xml' WHEN 3 THEN 'text/html' WHEN 4 THEN 'application/audiobook+json' ELSE 'application/x-mobi/' END AS media_type FROM lineitem""",
            ("lineitem",),
        ),
        "store": (
            f"SELECT CAST(p_partkey AS {text}) AS ContentID, p_name AS Title, p_brand AS Attribution, CAST(p_size AS {text}) AS Accessibility, p_size % 7 = 0 AS has_keys, p_partkey % 2 = 0 AS downloaded FROM part",
            ("part",),
        ),
    }


TABLES = ("region", "nation", "part", "lineitem", "events", "documents", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of sf_dir."""
    sql, tables = _views(_DIALECTS["spark"])[name]
    return spark.sql(_in_braces(sql, tables), **{t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in tables})


def _in_braces(sql: str, tables: tuple[str, ...]) -> str:
    out = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        out = out.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return out


def with_views(*names: str) -> str:
    """`WITH RECURSIVE` and the views for DuckDB, to be followed by more of them or by a query."""
    made = _views(_DIALECTS["duckdb"])
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({made[n][0]})" for n in names)
