"""A reading device's SQLite database as a data source: `spark.read.format("devicedb").option("path", ...).option("table", ...)`."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfspark.shipping import in_batches, ship
from shelfspark.storage import fresh

#: Rows of a table that one task reads.
PART = 50_000

# The columns that are read of each table.
TABLES = {
    "content": "ContentID STRING, Title STRING, Attribution STRING, Accessibility STRING, IsDownloaded STRING",
    "content_keys": "volumeid STRING, elementid STRING",
    "Bookmark": "VolumeID STRING, Text STRING, Annotation STRING, DateCreated STRING, ChapterProgress DOUBLE, Hidden STRING",
    "Shelf": "InternalName STRING, Name STRING, _IsDeleted STRING",
    "ShelfContent": "ShelfName STRING, ContentId STRING, _IsDeleted STRING",
}


class Changed(RuntimeError):
    """The database was written to while it was copied."""


def stamp(path: str) -> tuple:
    """Size and time of a database and of its write-ahead log."""
    out = []
    for p in (path, f"{path}-wal"):
        s = os.stat(p) if os.path.exists(p) else None
        out.append(None if s is None else (s.st_size, s.st_mtime_ns))
    return tuple(out)


def snapshot(path: str, into: str) -> str:
    """A consistent copy, with what the write-ahead log holds; Changed if the files moved meanwhile."""
    before = stamp(path)
    copy = os.path.join(into, "copy.sqlite")
    shutil.copyfile(path, copy)
    if before[1] is not None:
        shutil.copyfile(f"{path}-wal", f"{copy}-wal")
    if stamp(path) != before:
        raise Changed(path)
    whole = os.path.join(into, "whole.sqlite")
    with sqlite3.connect(copy) as a, sqlite3.connect(whole) as b:
        a.backup(b)
    a.close()
    b.close()
    return whole


class DeviceDatabase(DataSource):
    """One table of the database; a column that the device's version lacks is null, a table it lacks is empty.

    Options: path; table; whole ("true" if path is a finished copy that every executor reaches, which may be read in parts); rows (of a part);
    where (filters, as encoded() gives them). They are not left to Catalyst: in Spark 4.1 a filter that was pushed into a Python source
    stays with the DataFrame it was read from, and later queries on it lose rows.
    """

    @classmethod
    def name(cls) -> str:
        return "devicedb"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], self.options["table"], schema, self.options.get("whole") == "true", int(self.options.get("rows", PART)), self.options.get("where", "[]"))


@dataclass
class Rows(InputPartition):
    """Rows from one number on, and before another; all without."""

    start: int | None
    stop: int | None


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, whole: bool = False, rows: int = PART, where: str = "[]"):
        if table not in TABLES:
            raise ValueError(f"no table {table}")
        self.path, self.table, self.whole, self.rows = path, table, whole, rows
        self.names, self.kinds = schema.names, [f.dataType.typeName() for f in schema.fields]
        self.filters = [KINDS[kind]((column,), *value) for kind, column, *value in json.loads(where)]

    def partitions(self) -> list[InputPartition]:
        if not self.whole:
            return [Rows(None, None)]  # each task would copy another state of it
        with reachable(self.path) as path:
            db = sqlite3.connect(path)
            try:
                every = f'SELECT r FROM (SELECT rowid AS r, row_number() OVER (ORDER BY rowid) - 1 AS n FROM "{self.table}") WHERE n % ? = 0 ORDER BY r'
                starts = [r[0] for r in db.execute(every, (self.rows,))]
            except sqlite3.OperationalError:  # no such table, or one without row numbers
                starts = []
            db.close()
        return [Rows(a, b) for a, b in zip([None, *starts[1:]], [*starts[1:], None], strict=True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tests = [condition(f) for f in self.filters]
        at = [self.names.index(f.attribute[0]) for f in self.filters]
        with tempfile.TemporaryDirectory() as folder, reachable(self.path) if self.whole else nullcontext(snapshot(self.path, folder)) as path:  # a copy is this task's own and gone with it
            db = sqlite3.connect(path)
            for row in columns_of(db, self.table, self.names, self.kinds, self.filters, partition):
                if all(holds(row[i]) for (_, _, holds), i in zip(tests, at, strict=True)):
                    yield row
            db.close()


KINDS = {k.__name__: k for k in (EqualTo, In, IsNull, IsNotNull, StringStartsWith)}


def encoded(filters: Sequence[Filter]) -> str:
    """Filters as an option; a value of In is a list."""
    for f in filters:
        if condition(f) is None:
            raise ValueError(f"SQLite isn't asked for {f}")
    return json.dumps([[type(f).__name__, f.attribute[0], *([f.value] if hasattr(f, "value") else [])] for f in filters])


def condition(f: Filter) -> tuple[str, list, Callable] | None:
    """SQL that is true at least where a filter is ({} is the column), its values, and the filter itself on a value as it is read; None for filters that aren't taken.

    SQLite's columns hold what was put in, whatever their type: numbers in columns that are read as text are compared as text, and what has no plain text is left to the last test.
    """
    if len(getattr(f, "attribute", ())) != 1:
        return None
    if isinstance(f, IsNull):
        return "{} IS NULL", [], lambda x: x is None
    if isinstance(f, IsNotNull):
        return "{} IS NOT NULL", [], lambda x: x is not None
    values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
    if not all(isinstance(v, str) for v in values):
        return None
    odd = " OR typeof({}) IN ('real', 'blob')"
    if isinstance(f, EqualTo | In):
        return "(CAST({} AS TEXT) IN (" + ", ".join("?" * len(values)) + ")" + odd + ")", values, lambda x: x in values
    if isinstance(f, StringStartsWith):
        return "(substr(CAST({} AS TEXT), 1, ?) = ?" + odd + ")", [len(values[0]), values[0]], lambda x: x is not None and x.startswith(values[0])
    return None


@contextmanager
def reachable(path: str) -> Iterator[str]:
    """A finished database as a file of this machine: where it is, or a copy for as long as it is needed."""
    from shelfspark.sources.books import filesystem

    source, name = filesystem(path)
    if isinstance(source, fs.LocalFileSystem):
        yield name
        return
    with tempfile.TemporaryDirectory() as folder:
        own = os.path.join(folder, "whole.sqlite")
        with source.open_input_stream(name) as a, open(own, "wb") as b:
            shutil.copyfileobj(a, b)
        yield own


def columns_of(db: sqlite3.Connection, name: str, columns: list[str], kinds: list[str], filters: Sequence[Filter] = (), rows: Rows | None = None) -> Iterator[tuple]:
    """The rows of a table that filters can hold for; a column that the device's version lacks is null, a table it lacks is empty."""
    there = {r[1].lower() for r in db.execute(f'PRAGMA table_info("{name}")')}
    if there:
        own = lambda n: f'"{n}"' if n.lower() in there else "NULL"
        where, values = [], []
        for f in filters:
            sql, some, _ = condition(f)
            where.append(sql.format(*[own(f.attribute[0])] * sql.count("{}")))
            values += some
        for sql, limit in (("rowid >= ?", rows and rows.start), ("rowid < ?", rows and rows.stop)):
            if limit is not None:
                where.append(sql)
                values.append(limit)
        for row in db.execute(f'SELECT {", ".join(map(own, columns))} FROM "{name}"' + (f" WHERE {' AND '.join(where)}" if where else ""), values):
            yield tuple(None if x is None else float(x) if k == "double" else str(x) for x, k in zip(row, kinds, strict=True))


def tables(files: DataFrame, name: str) -> DataFrame:
    """The rows of a table of many databases at once, whose bytes are at hand: path, content."""
    ship(files.sparkSession)
    schema = T._parse_datatype_string("path STRING, " + TABLES[name])
    kinds = [f.dataType.typeName() for f in schema.fields[1:]]

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(content.as_buffer())
                for r in columns_of(db, name, schema.names[1:], kinds):
                    yield dict(zip(schema.names, (path.as_py(), *r), strict=True)), sum(len(x) for x in r if isinstance(x, str))
                db.close()

    arrow = to_arrow_schema(schema)
    return files.select("path", "content").mapInArrow(lambda batches: in_batches(read(batches), arrow), schema)


def copied(spark: SparkSession, path: str) -> str:
    """A consistent copy of a device's database, which this machine reaches, in the shared folder."""
    with tempfile.TemporaryDirectory() as folder:
        whole = snapshot(path, folder)
        into = fresh(spark, "device")
        where = spark._jvm.org.apache.hadoop.fs.Path(into)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(whole), where)
    return into


def table(spark: SparkSession, path: str, name: str, where: Sequence[Filter] = (), rows: int = PART) -> DataFrame:
    """A table of the database as it is now, read in parts of so many rows, each a task; only rows that meet all filters leave SQLite."""
    ship(spark)
    spark.dataSource.register(DeviceDatabase)
    return spark.read.format("devicedb").option("path", copied(spark, path)).option("table", name).option("whole", "true").option("rows", rows).option("where", encoded(where)).load()
