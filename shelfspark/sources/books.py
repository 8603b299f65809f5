"""Folders of book files as DataFrames."""

from __future__ import annotations

import os
import re
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfspark.functions import text as X
from shelfspark.shipping import ship
from shelfspark.sources import epub, packing, pdf
from shelfspark.storage import materialize

BOOK = T.StructType([T.StructField(n, t) for n, t in (
    ("title", T.StringType()), ("author", T.StringType()), ("series", T.StringType()), ("series_index", T.FloatType()), ("identifiers", T.ArrayType(T.StringType())), ("sha", T.StringType()),
    ("resources", T.StringType()), ("optimized", T.BooleanType()), ("unreadable", T.StringType()),
)])


#: Described rows that make one batch.
GATHERED = 256


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, below (the path under root), length, modified and fingerprint of the files under root, without reading any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    top = root.rstrip("/").rpartition(":")[2]
    behind = F.locate(top, F.col("path")) + F.char_length(F.lit(top))
    below = F.regexp_replace(F.substring(F.col("path"), behind, F.char_length("path")), "^/+", "")
    return files.select("path", below.alias("below"), "length", F.col("modificationTime").alias("modified"), X.fingerprint(F.col("length"), F.col("modificationTime")).alias("fingerprint"))


def book_files(files: DataFrame) -> DataFrame:
    """Files with a book's extension that no dot hides, and their format; requests for books go to requests()."""
    return files.where(~F.col("below").rlike(r"(^|/)\.")).withColumn("format", X.format_of(F.col("below"))).where(F.col("format").isNotNull())


def requests(files: DataFrame) -> DataFrame:
    return files.where(~F.col("below").rlike(r"(^|/)\.") & F.lower("below").rlike(r"\.(acsm|ascm)$"))


def spent(open_requests: DataFrame, archived: DataFrame) -> DataFrame:
    """Requests without those whose bytes (sha) lie in the archive folder beside them, and without that folder."""
    folder = F.regexp_extract("below", r"^(.*?)[^/]*$", 1)
    done = archived.withColumn("folder", F.regexp_extract("below", r"^(.*?)archive/[^/]*$", 1)).select("folder", "sha")
    return open_requests.where(~F.col("below").rlike("(^|/)archive/")).withColumn("folder", folder).join(done, ["folder", "sha"], "left_anti").drop("folder")


def archive_names(done: DataFrame) -> DataFrame:
    """done (below, sha, seq) with archived: where each fulfilled request goes. A name that another one has taken before gets a number; the same bytes go to one place."""
    folder, name = F.regexp_extract("below", r"^(.*?)[^/]*$", 1), F.regexp_extract("below", r"([^/]*)$", 1)
    rows = done.withColumns({"folder": folder, "name": name})
    first = rows.groupBy("folder", "name", "sha").agg(F.min("seq").alias("first"))
    nth = F.row_number().over(Window.partitionBy("folder", "name").orderBy("first")) - 1
    stem, extension = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    numbered = first.withColumn("nth", nth).withColumn("archived", F.concat("folder", F.lit("archive/"), stem, F.when(F.col("nth") > 0, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise(""), extension))
    return rows.join(numbered.select("folder", "name", "sha", "archived"), ["folder", "name", "sha"]).select("below", "sha", "seq", "archived")


def card_files(spark: SparkSession, root: str) -> DataFrame:
    """What a mounted card holds, folders (size 0) included, in order of path; system folders are left out."""
    kept = listing(spark, root).where(~F.lower("below").rlike(r"(^|/)(\.|xtcache(/|$)|system volume information(/|$))"))
    parts = F.split("below", "/")
    folders = kept.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).where(F.size(F.split("path", "/")) > 0).distinct()
    rows = kept.select(F.col("below").alias("path"), F.col("length").alias("size"), F.lit(False).alias("directory"))
    return rows.unionByName(folders.select("path", F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("directory"))).orderBy("path")


def read(spark: SparkSession, root: str, todo: DataFrame) -> DataFrame:
    """todo (path, below, length, format) with what each file says and is; one that can't be read says why and has an empty sha.

    Only the files of todo are opened, by tasks that are given so many bytes at most or one file that is larger (packing.py), and no more of one is read than was listed.
    """
    return _described(packing.packed(todo.select("path", "below", "length", "format")))


def described(files: DataFrame) -> DataFrame:
    """The same of files whose content is at hand: path, below, length (as listed), format, content."""
    return _described(files.select("path", "below", "length", "format", "content"))


def _described(rows: DataFrame) -> DataFrame:
    ship(rows.sparkSession)
    names = ["path", "below", "length", "format"]

    def run(batches):
        done = []
        for batch in batches:
            for i in range(batch.num_rows):  # the content of one row at a time
                (row,) = batch.slice(i, 1).to_pylist()
                content = row["content"] if "content" in row else opened(row["path"], row["length"])
                done.append({n: row[n] for n in names} | describe(content, row["format"], row["below"], row["length"]))
                if len(done) == GATHERED:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done = []
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    kinds = {"title": pa.string(), "author": pa.string(), "series": pa.string(), "series_index": pa.float32(), "identifiers": pa.list_(pa.string()), "sha": pa.string(), "resources": pa.string(), "optimized": pa.bool_(), "unreadable": pa.string()}
    schema = pa.schema([("path", pa.string()), ("below", pa.string()), ("length", pa.int64()), ("format", pa.string()), *kinds.items()])
    return rows.mapInArrow(run, T.StructType([f for f in rows.schema.fields if f.name in names] + BOOK.fields))


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Where a path leads, and its name there."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def opened(path: str, length: int) -> bytes | str:
    """The bytes of a file, one more than listed at most, or why it can't be opened."""
    try:
        source, name = filesystem(path)
        with source.open_input_stream(name) as f:
            return f.read(length + 1)
    except (OSError, ValueError) as e:
        return str(e).partition("'")[0].strip() or type(e).__name__


def existing_roots(spark: SparkSession, roots: list[str]) -> tuple[list[str], list[str]]:
    """The roots that can be listed, and a warning for each that can't; an error if there is none."""
    kept, warnings = [], []
    for root in roots:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        try:
            where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
            kept.append(root)
        except Py4JJavaError as e:
            warnings.append(f"{root}: {e.java_exception.getClass().getSimpleName()}")
    if not kept:
        raise FileNotFoundError("; ".join(warnings) or "no folder of books is set")
    return kept, warnings


WALKED = "root string, path string, below string, length bigint, modified timestamp, warning string"
#: Folders that a task lists before it hands what is left back, to be dealt anew.
LISTED = 1000


def walked(spark: SparkSession, roots: list[str], most: int = LISTED) -> DataFrame:
    """The files of folders (root, path, below, length, modified) and, with nothing but path, a warning for each folder that can't be listed.

    Unlike listing() it doesn't fail for one such folder. Hidden names are left out with all below them, and so are links that lead
    out of their root or back to a folder that they stand in; a folder that several links lead to is walked by one of its names, the first of those that are met in the same round. The walk goes by rounds: in each,
    the open folders are dealt over all tasks, and a task lists up to `most` of them and what is below, last in, first out.
    """
    ship(spark)
    kept, refused = existing_roots(spark, roots)
    schema = T._parse_datatype_string(_VISITED)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                source, top = filesystem(r["root"])
                rows = [{"root": r["root"], "length": None, "modified": None, "below": None, "warning": None, "via": None, "crossed": None, **x} for x in visited(source, top, r["path"], r["crossed"] or [], most)]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=arrow)

    frontier = spark.createDataFrame([(root, filesystem(root)[1], []) for root in kept], "root string, path string, crossed array<string>")
    seen, out = None, None
    tasks = max(1, spark.sparkContext.defaultParallelism)
    while True:
        round_ = materialize(frontier.repartition(tasks).mapInArrow(run, schema), "walk")
        # Each real folder is walked once: by the one that came in an earlier round, or else has the first path.
        folders = round_.where("kind = 'folder'").groupBy("root", "via").agg(F.min("path").alias("path"))
        if seen is not None:
            folders = folders.join(seen, ["root", "via"], "left_anti")
        folders = materialize(folders, "folders")
        own = folders.select("root", F.col("path").alias("within"))
        found = round_.where("kind IN ('file', 'warning')").join(own, ["root", "within"], "left_semi").select("root", "path", "below", "length", "modified", "warning")
        out = found if out is None else out.unionByName(found)
        seen = folders.select("root", "via") if seen is None else seen.unionByName(folders.select("root", "via"))
        frontier = round_.where("kind = 'open'").join(own, ["root", "within"], "left_semi").join(seen, ["root", "via"], "left_anti")
        frontier = materialize(frontier.groupBy("root", "via").agg(F.min(F.struct("path", "crossed")).alias("x")).select("root", "x.path", "x.crossed"), "frontier")
        if frontier.isEmpty():
            break
    if not refused:
        return out
    return out.unionByName(spark.createDataFrame([(w.partition(": ")[0], w.partition(": ")[0], None, None, None, w.partition(": ")[2]) for w in refused], WALKED))


#: kind: folder (walked; via: its real path), open (a folder still to be walked), file or warning; within: the folder it stands in; crossed: the real folders whose links led here.
_VISITED = "root string, kind string, path string, within string, via string, crossed array<string>, below string, length bigint, modified timestamp, warning string"


def visited(source: fs.FileSystem, top: str, start: str, crossed: list[str], most: int):
    """What stands at start and below it, folders last in, first out; after so many folders the rest of them as open."""
    local = isinstance(source, fs.LocalFileSystem) or not isinstance(source, fs.FileSystem)
    real = (lambda p: os.path.realpath(p)) if local else (lambda p: p)
    under = lambda p, q: p == q or p.startswith(q.rstrip("/") + "/")
    own_top, stack, done, n = real(top), [(start, start.rpartition("/")[0], list(crossed))], set(), 0
    while stack:
        path, within, links = stack.pop()
        where = real(path)
        if where in done:
            continue
        if n >= most:
            yield {"kind": "open", "path": path, "within": within, "via": where, "crossed": links}
            continue
        done.add(where)
        n += 1
        yield {"kind": "folder", "path": path, "within": within, "via": where}
        try:
            found = source.get_file_info(fs.FileSelector(path))
        except OSError as e:
            yield {"kind": "warning", "path": path, "within": path, "warning": str(e).partition(".")[0]}
            continue
        for info in sorted((x for x in found if not x.base_name.startswith(".")), key=lambda x: x.path, reverse=True):
            to = real(info.path)
            if not under(to, own_top):
                continue  # a link out of the root
            if info.type == fs.FileType.File:
                yield {"kind": "file", "path": info.path, "within": path, "below": info.path[len(top.rstrip("/")) + 1 :], "length": info.size, "modified": info.mtime}
            elif info.type == fs.FileType.Directory:
                crossing = to != f"{where.rstrip('/')}/{info.base_name}"
                if not crossing or not any(under(q, to) for q in (*links, where)):
                    stack.append((info.path, path, [*links, where] if crossing else links))


def walk(source: fs.FileSystem, top: str, start: str):
    """What stands at start and below it, all at once."""
    for x in visited(source, top, start, [], 1 << 62):
        if x["kind"] in ("file", "warning"):
            yield {k: v for k, v in x.items() if k not in ("kind", "within")}


def name_title(path: str) -> str:
    name = re.split(r"[/\\]", path)[-1].rstrip().rstrip(".").rstrip()
    return (name.rpartition(".")[0] if "." in name else name).strip() or "Untitled"


def describe(content: bytes | str, format_: str, below: str, length: int) -> dict:
    """Title, author, series, identities of a file; or why it can't be read."""
    out = dict.fromkeys((f.name for f in BOOK.fields)) | {"identifiers": [], "sha": "", "optimized": False}
    try:
        if isinstance(content, str):
            raise epub.BadBook(content)
        if len(content) != length:
            raise epub.BadBook("it changed while it was read")
        epub.validate_as(format_, content)
        said = epub.metadata(content) if format_ == "epub" else None
        if said is not None:
            out |= {"title": said.title, "author": said.author, "series": said.series, "series_index": said.series_index, "identifiers": said.identifiers, "optimized": epub.is_device_copy(content)}
        elif format_ == "pdf":
            info = pdf.information(content)
            out |= {"title": info.get("Title"), "author": info.get("Author")}
        sha, resources = epub.identity(content)
        return out | {"title": out["title"] or name_title(below), "author": out["author"] or "", "sha": sha, "resources": resources}
    except ValueError as e:
        return out | {"title": name_title(below), "author": f"Unreadable: {e}", "unreadable": str(e)}


def sideloads(read_books: DataFrame) -> DataFrame:
    """Files that a person put on a device, in the shape of its book list."""
    return read_books.where("unreadable IS NULL").select(X.file_id(F.col("below")).alias("id"), "title", "author", F.lit(False).alias("preview"), F.lit(False).alias("encrypted"))
