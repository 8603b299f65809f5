import random

import pytest
from pyspark.sql import functions as F

from shelfspark import config, sinks
from shelfspark.operators import cache, convert
from shelfspark.sources import books, epub, reader
from shelfspark.streaming import catalogue
from tests.test_sources import make_pdf


def test_tables_for_people(spark, tmp_path):
    df = spark.createDataFrame([("Du\tne", "Frank\nHerbert", 843), ("B", None, None)], "title string, author string, bytes bigint").coalesce(1)
    sinks.tsv(df, str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv")) == "title\tauthor\tbytes\nDu ne\tFrank Herbert\t843\nB\t\t\n"
    with pytest.raises(Exception, match="exists"):
        sinks.tsv(df, str(tmp_path / "t"))
    assert '"title" : "B"' in sinks.pretty_json(df).where("json LIKE '%B%'").first().json
    sinks.documents(df.select("title", F.lit("text").alias("document")), str(tmp_path / "d"))
    assert (tmp_path / "d" / "name=B").is_dir()


def test_names_of_corrections():
    assert sinks.free_name("a.epub", []) == "a.epub" and sinks.free_name("a.epub", ["A.EPUB"]) == "a (corrected).epub" and sinks.free_name("a.epub", ["a.epub", "a (corrected).epub"]) == "a (corrected 2).epub"
    with pytest.raises(FileExistsError):
        sinks.free_name("a", ["a", "a (corrected)", *(f"a (corrected {i})" for i in range(2, 101))])


def test_many_names_at_once(spark):
    pick = random.Random(7)
    said = ["a.epub", "A.epub", "a (corrected).epub", "a (corrected 2).EPUB", "a (corrected 02).epub", "a (corrected 1).epub", "a", "a (corrected)", "a.b (corrected)", "a (corrected 100).epub", "a (corrected 101).epub", ".epub", "", "a (corrected) (corrected).epub", "\na.epub"]
    there = [(f, n) for f in "xy" for n in said if pick.random() < 0.5]
    wanted = [(i, pick.choice("xy"), pick.choice(said)) for i in range(400)] + [(i, "z", "same.pdf") for i in range(400, 530)]
    asked = {(f, n.lower()) for _, f, n in wanted}
    taken, want = {(f, n.lower()) for f, n in there}, {}
    for i, folder, name in wanted:
        stem, dot, end = name.rpartition(".")
        stem, end = (stem, dot + end) if dot else (name, "")
        forms = [name, f"{stem} (corrected){end}", *(f"{stem} (corrected {k}){end}" for k in range(2, 101))]
        free = [f for k, f in enumerate(forms) if (folder, f.lower()) not in taken and (k == 0 or (folder, f.lower()) not in asked)]
        want[i] = free[0] if free else None
        taken.add((folder, (want[i] or "").lower() if free else "/"))
    w, t = spark.createDataFrame(wanted, "id int, folder string, name string"), spark.createDataFrame(there, "folder string, name string")
    assert {r.id: r.free for r in sinks.free_names(w, t).collect()} == want and list(want.values()).count(None) >= 29
    assert {r.free for r in sinks.free_names(w.where("id < 3"), t.limit(0)).collect()} and sinks.free_names(w.limit(0), t).count() == 0


def test_layers_of_settings(spark):
    layers = [
        None, "", " ", "{}", '{"books": "/b", "screen": "x4pro"}', '{"books": "b"}', '{"books": "s3://b"}', '{"screen": "none"}', '{"screen": "Paper-Mono"}', '{"catalogue": "ftp://x"}', '{"catalogue": "HTTPS://x/y?z"}', '{"catalogue": "http://"}', '{"other": 1}',
        '{"reader": "http://h/path"}', '{"reader": "h:80"}', '{"reader": "http://[::1]:80/"}', '{"reader": "u@h"}', '{"reader": "https://h"}', '{"show_previews": false}', '{"show_previews": null, "card": "/c"}', "{", '{"kobo": ""}',
    ]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in layers for b in layers)]

    def said(a, b):
        try:
            return config.load(a).over(config.load(b))
        except ValueError:
            return None

    got = spark.createDataFrame(pairs, "i int, a string, b string").select("i", config.layered(F.col("a"), F.col("b")).alias("s")).collect()
    assert {r.i: None if r.s is None else config.load(r.s) for r in got} == {i: said(a, b) for i, a, b in pairs}


def test_settings():
    low, high = config.load('{"books": "/b", "screen": "x4pro"}'), config.load('{"books": "/c"}')
    assert high.over(low) == config.Settings(books="/c", screen="x4pro") and config.load(config.dump(low)) == low and config.load("") == config.Settings()
    for bad in ('{"books": "b"}', '{"screen": "none"}', '{"catalogue": "ftp://x"}', '{"other": 1}', '{"reader": "http://h/path"}'):
        with pytest.raises(ValueError):
            config.load(bad)
    assert config.address("10.0.0.2:8080") == ("10.0.0.2", 8080) and config.profile(" x4 ") == "X4" and config.profile("m5stack_papercolor") is None


def test_reader_listing(spark):
    rows = [("/", '[{"name":"A","size":0,"isDirectory":true},{"name":".x","size":1,"isDirectory":false},{"name":"n.txt","size":2,"isDirectory":false}]'), ("/A", '[{"name":"b.epub","size":5,"isDirectory":false}]')]
    got = reader.files(spark.createDataFrame(rows, "folder string, json string"))
    assert [(r.path, r.size, r.directory) for r in got.collect()] == [("A", 0, True), ("A/b.epub", 5, False), ("n.txt", 2, False)]
    assert reader.shown_on_reader(got).count() == 1
    with pytest.raises(ValueError):
        reader.files(spark.createDataFrame([("/", '[{"name":"a\\\\b","size":0,"isDirectory":false}]')], "folder string, json string"))


def test_incomplete_uploads(spark):
    a = spark.createDataFrame([("x", bytearray(b"abcdef")), ("y", bytearray(b"abc")), ("z", bytearray(b"abc"))], "path string, content binary")
    b = spark.createDataFrame([("x", bytearray(b"abc")), ("y", bytearray(b"abc")), ("z", bytearray(b"ax"))], "path string, content binary")
    assert [r.path for r in reader.incomplete(a, b).collect()] == ["x"]


def page(*lines):
    return b"BT /F1 11 Tf 1 0 0 1 50 700 Tm " + b" ".join(b"(" + t + b") Tj 0 -14 Td" for t in lines) + b" ET"


def test_pdf_becomes_epub(spark):
    text = page(b"It was a long and winding road that went", b"on and on over the hills and far away.")
    files = spark.createDataFrame([("a.pdf", bytearray(make_pdf(text))), ("b.pdf", bytearray(make_pdf(page(b"short"))))], "path string, content binary")
    about = spark.createDataFrame([("a.pdf", "Roads", "A. Walker")], "doc string, title string, author string")
    got = {r.doc: r for r in convert.converted(files, about).collect()}
    assert (epub.metadata(bytes(got["a.pdf"].epub)).title, got["b.pdf"].epub, got["b.pdf"].error) == ("Roads", None, "no prose to make a book from")
    assert {r.doc_id: r.concerns for r in convert.inspected(files).collect()} == {"a.pdf": "nothing found", "b.pdf": "nothing found"}  # under 120 bytes of text


def test_figures_stand_among_lines(spark):
    lines = spark.createDataFrame([(1, 0, 0, 700.0, "a"), (1, 0, 1, 500.0, "b")], "doc_id int, page int, line int, y float, text string")
    figures = spark.createDataFrame([(1, 0, 600.0, 7)], "doc_id int, page int, top float, figure int")
    assert [(r.text, r.figure) for r in convert.interleaved(lines, figures).collect()] == [("a", None), (None, 7), ("b", None)]


COPY = "copy_id bigint, place string, place_rank int, path string, format string, title string, author string, series string, series_index float, sha string, resources string, variant_resources string, size bigint, optimized boolean, seen bigint, gone boolean"


def a_copy(i, place="Local", path=None, gone=False, seen=1):
    return (i, place, 0, path or f"{i}.epub", "epub", f"T{i}", "A", None, None, f"s{i}", None, None, 5, False, seen, gone)


def test_a_version_is_named_at_once(spark, tmp_path, monkeypatch):
    """A batch that stops before its manifest is renamed changes nothing for readers, and can come again."""
    table = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(list(x), COPY)
    paths = lambda: sorted(r.path for r in catalogue.copies(spark, table).collect())
    assert catalogue.current(spark, table) == (-1, None) and catalogue.copies(spark, table) is None
    catalogue.upsert(rows(a_copy(1), a_copy(2)), 0, table)
    before = catalogue.current(spark, table)
    name = catalogue._name

    def stopped(*_):
        raise OSError("stopped between writing and naming")

    monkeypatch.setattr(catalogue, "_name", stopped)
    with pytest.raises(OSError):
        catalogue.upsert(rows(a_copy(1, gone=True, seen=2), a_copy(3)), 1, table)
    assert catalogue.current(spark, table) == before and paths() == ["1.epub", "2.epub"]
    monkeypatch.setattr(catalogue, "_name", name)
    for _ in range(2):
        catalogue.upsert(rows(a_copy(1, gone=True, seen=2), a_copy(3)), 1, table)
        assert paths() == ["2.epub", "3.epub"]


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = str(tmp_path / "table")
    catalogue.upsert(spark.createDataFrame([a_copy(i) for i in range(200)], COPY), 0, table)
    first = catalogue.current(spark, table)[1]["folders"]
    for batch in range(1, 6):
        catalogue.upsert(spark.createDataFrame([a_copy(1, seen=batch + 1)], COPY), batch, table)
    last = catalogue.current(spark, table)[1]["folders"]
    assert sum(first[b] != last[b] for b in first) == 1 and catalogue.copies(spark, table).count() == 200
    assert catalogue.manifests(spark, table) == [3, 4, 5]  # versions that readers may hold; older folders go
    assert not (tmp_path / "table" / "v1").exists() and (tmp_path / "table" / "v0").exists()
    catalogue.upsert(spark.createDataFrame([a_copy(i, gone=True, seen=9) for i in range(200)], COPY), 6, table)
    assert catalogue.copies(spark, table).count() == 0


def test_places_answer_for_themselves(spark):
    reports = [("Kobo", 1, "started", 1), ("Kobo", 1, "row", 2), ("Kobo", 1, "finished", 3), ("Kobo", 2, "started", 4), ("Kobo", 1, "row", 5), ("Kobo", 2, "unavailable", 6), ("Local", 1, "started", 1), ("Local", 1, "row", 2), ("Card", 3, "started", 1), ("Card", 3, "not connected", 2)]
    df = spark.createDataFrame(reports, "place string, operation int, event string, seq int")
    assert {r.place: (r.operation, r.state, r.inventory) for r in catalogue.states(df).collect()} == {"Kobo": (2, "Unavailable", 1), "Local": (1, "Checking", None), "Card": (3, "Not connected", None)}
    assert sorted((r.place, r.seq) for r in catalogue.inventory(df).collect()) == [("Kobo", 2), ("Kobo", 5)]


def test_only_what_the_cache_lacks_is_opened(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.epub").write_bytes(b"no book" * (i + 1))
    found = books.book_files(books.listing(spark, str(tmp_path)))
    rows = found.collect()
    todo = spark.createDataFrame([r for r in rows if r.below in ("1.epub", "2.epub")], found.schema)
    for i in (0, 3, 4, 5):
        (tmp_path / f"{i}.epub").unlink()  # would fail if it were opened
    (tmp_path / "2.epub").write_bytes(b"another size")
    got = {r.below: r.unreadable for r in books.read(spark, str(tmp_path), todo).collect()}
    assert set(got) == {"1.epub", "2.epub"} and "changed" in got["2.epub"] and got["1.epub"]
    (tmp_path / "1.epub").unlink()
    got = {r.below: r.unreadable for r in books.read(spark, str(tmp_path), todo).collect()}
    assert got["1.epub"]
    assert "binaryFile" not in books.read(spark, str(tmp_path), todo)._jdf.queryExecution().optimizedPlan().toString()


def test_roots_that_cannot_be_listed(spark, tmp_path):
    kept, warnings = books.existing_roots(spark, [str(tmp_path), str(tmp_path / "none")])
    assert kept == [str(tmp_path)] and len(warnings) == 1 and "none" in warnings[0]
    with pytest.raises(FileNotFoundError):
        books.existing_roots(spark, [str(tmp_path / "none")])


def test_a_folder_that_cannot_be_listed_is_a_warning(spark, tmp_path):
    from pyarrow import fs

    root = tmp_path / "books"
    for name in ("a.epub", "deep/er/b.pdf", ".hidden/c.epub", "deep/.d.epub", "shut/e.epub"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * 3)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "f.epub").write_bytes(b"x")
    (root / "deep" / "link").symlink_to(tmp_path / "out")
    rows = books.walked(spark, [str(root), str(tmp_path / "none")]).collect()
    assert {(r.below, r.length) for r in rows if r.warning is None} == {("a.epub", 3), ("deep/er/b.pdf", 3), ("shut/e.epub", 3)}
    assert [r.path for r in rows if r.warning] == [str(tmp_path / "none")]
    assert {r.below for r in books.book_files(books.walked(spark, [str(root)])).collect()} == {"a.epub", "deep/er/b.pdf", "shut/e.epub"}

    class Shut:
        def __init__(self):
            self.own = fs.LocalFileSystem()

        def get_file_info(self, what):
            if isinstance(what, fs.FileSelector) and what.base_dir.endswith("shut"):
                raise PermissionError("Cannot list. Permission denied")
            return self.own.get_file_info(what)

    got = list(books.walk(Shut(), str(root), str(root)))
    assert [x["warning"] for x in got if "warning" in x] == ["Cannot list"] and "deep/er/b.pdf" in {x.get("below") for x in got}


def test_listings_of_many_readers(spark):
    entry = lambda name: f'{{"name":"{name}","size":5,"isDirectory":false}}'
    rows = [("a", "/", f"[{entry('x.epub')}]"), ("b", "/", f"[{entry('x.epub')},{entry('y.pdf')}]")]
    got = reader.files(spark.createDataFrame(rows, "reader string, folder string, json string"))
    assert sorted((r.reader, r.path) for r in got.collect()) == [("a", "x.epub"), ("b", "x.epub"), ("b", "y.pdf")]
    many = spark.range(reader.MANY + 1).select(F.format_string('{"name":"%d.epub","size":5,"isDirectory":false}', "id").alias("e")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("e"), ","), F.lit("]")).alias("json"))
    half = lambda name: many.select(F.lit(name).alias("reader"), F.lit("/").alias("folder"), "json")
    with pytest.raises(Exception, match="a: too many entries"):
        reader.files(half("a").unionByName(spark.createDataFrame(rows[1:], "reader string, folder string, json string"))).collect()
    fewer = many.select(F.regexp_replace("json", r'^\[[^}]*\},', "[").alias("json"))
    both = fewer.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("reader"), F.lit("/").alias("folder"), "json")
    assert reader.files(both).count() == 2 * reader.MANY  # as many as a reader may have, on each of two
    with pytest.raises(Exception, match="not a listing"):
        reader.files(spark.createDataFrame([("a", "/", '[{"name":"x\\\\y","size":0,"isDirectory":false}]')], "reader string, folder string, json string")).collect()


def test_a_folder_with_quotes_is_listed(spark, tmp_path):
    root = tmp_path / "o'brien's \"new\" books"
    (root / "deep").mkdir(parents=True)
    (root / "deep" / "it's.epub").write_bytes(b"x")
    assert [r.below for r in books.listing(spark, str(root)).collect()] == ["deep/it's.epub"]


def test_a_cache_is_saved_over_itself(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "cache"), "key string, seen bigint"
    held = lambda: sorted((r.key, r.seen) for r in cache.load(spark, path, schema).collect())
    rows = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    cache.save(rows, path, 3)
    cache.save(cache.load(spark, path, schema), path, 3)
    assert held() == [("a", 1), ("b", 2)]
    none, new = spark.createDataFrame([], "key string"), spark.createDataFrame([("c",)], "key string")
    reader_of_old = cache.load(spark, path, schema)
    assert not cache.scanned(cache.load(spark, path, schema), rows.select("key"), none, path, 9) and held() == [("a", 1), ("b", 2)]  # hits alone
    assert cache.scanned(cache.load(spark, path, schema), rows.select("key"), new, path, 9) and held() == [("a", 9), ("b", 9), ("c", 9)]
    assert reader_of_old.count() == 2  # its files are still there
    monkeypatch.setattr(cache, "kept", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        cache.save(rows, path, 9)
    assert len(held()) == 3
    monkeypatch.undo()
    for i in range(4):
        cache.save(cache.load(spark, path, schema), path, 9 + i)
    assert len(held()) == 3 and len(list((tmp_path / "cache").glob("saved-*"))) == cache.HELD


def test_a_cache_that_was_written_straight_to_its_path(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "key string, seen bigint"
    spark.createDataFrame([("a", 1)], schema).withColumn("version", F.lit(cache.VERSION)).write.parquet(path)
    assert cache.load(spark, path, schema).count() == 1
    cache.save(cache.load(spark, path, schema), path, 2)
    assert cache.load(spark, path, schema).count() == 1 and not list((tmp_path / "cache").glob("part-*"))
