import io
import sqlite3
import zipfile
import zlib

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.operators import device as D
from shelfspark.operators import feed as E
from shelfspark.operators import layout as Y
from shelfspark.sources import books, device_db, epub, opds, pdf

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'


def make_epub(title="A Title", author="An Author", text="Words.", more="", method=zipfile.ZIP_STORED, extra=None, drop=()):
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator>{more}</metadata><manifest><item id="c" href="ch%61pter.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/></spine></package>'
    members = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OPS/book.opf": opf, "OPS/chapter.xhtml": f"<html><body><p>{text}</p></body></html>"} | (extra or {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in members.items():
            if name not in drop:
                z.writestr(name, body)
    return out.getvalue()


def make_pdf(content, info="", compress=False, pages=1, extra=""):
    stream = zlib.compress(content) if compress else content
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R " + extra.encode() + b" >>",
        b"<< /Type /Pages /Kids [" + b" ".join(b"4 0 R" if i == 0 else b"%d 0 R" % (6 + i) for i in range(pages)) + b"] /Count %d /MediaBox [0 0 400 600] >>" % pages,
        b"<< " + info.encode("latin-1") + b" >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 6 0 R >> >> >>",
        b"<< /Length %d %s>>\nstream\n" % (len(stream), b"/Filter /FlateDecode " if compress else b"") + stream + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [600 700] >>",
    ] + [b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 6 0 R >> >> >>"] * (pages - 1)
    out = b"%PDF-1.7\n"
    for i, o in enumerate(objects, 1):
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF\n"


def test_metadata_and_series():
    got = epub.metadata(make_epub(more='<meta name="calibre:series" content="S"/><meta name="calibre:series_index" content="2.5"/><dc:creator>B</dc:creator>'))
    assert (got.title, got.author, got.series, got.series_index) == ("A Title", "An Author, B", "S", 2.5)
    got = epub.metadata(make_epub(more='<meta property="belongs-to-collection" id="x">T</meta><meta refines="#x" property="group-position">3</meta>'))
    assert (got.series, got.series_index) == ("T", 3.0)
    assert epub.metadata(make_epub(extra={"mimetype": "text/plain"})) is None


def test_identity_survives_repacking_and_metadata():
    a, b, c, d = make_epub(), make_epub(method=zipfile.ZIP_DEFLATED), make_epub(title="Other"), make_epub(text="Else.")
    ids = [epub.identity(x) for x in (a, b, c, d)]
    assert len({i[0] for i in ids}) == 4 and ids[0][1] == ids[1][1] == ids[2][1] != ids[3][1]
    assert epub.identity(b"bad")[1] is None


def test_validation():
    epub.validate(make_epub())
    for bad in (b"bad", make_epub(drop=("OPS/chapter.xhtml",)), make_epub(text="<p>"), make_epub(extra={"../x": "y"}), make_epub(extra={"META-INF/rights.xml": "<r/>"}), make_epub(extra={"mimetype": "x"})):
        with pytest.raises(epub.BadBook):
            epub.validate(bad)
    fonts = '<e><EncryptedData><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/></EncryptedData></e>'
    epub.validate(make_epub(extra={"META-INF/encryption.xml": fonts}))
    with pytest.raises(epub.BadBook):
        epub.validate(make_epub(extra={"META-INF/encryption.xml": fonts.replace("idpf", "other")}))
    with pytest.raises(epub.BadBook):
        epub.validate_as("pdf", b"%PDF-1.7 cut")
    epub.validate_as("pdf", b"%PDF-1.7 %%EOF")


def test_references():
    assert epub.resolve("OPS", "../a/./b%20c.xhtml#x") == "a/b c.xhtml"
    for bad in ("../../x", "/x", "a%zz", "c:x"):
        with pytest.raises(epub.BadBook):
            epub.resolve("OPS", bad)


def test_references_as_a_column(spark):
    rows = [(b, h) for b in ("", "OPS", "OPS/text") for h in ("a.xhtml", "text/c%C3%A9%20d.xhtml#p1", "../img/./x.png", "../../out", "/abs", "x%zz", "x%", "%ff", "http://x/y", "..\\b", "a+b%2Bc", "", "#p", "..", "a//b/../c", "x%EF%BF%BD", "%2e%2e/a")]

    def said(b, h):
        try:
            return epub.resolve(b, h)
        except epub.BadBook:
            return None

    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", X.resolved_reference(F.col("b"), F.col("h")).alias("p")).collect()
    assert {(r.b, r.h): r.p for r in got} == {(b, h): said(b, h) for b, h in rows}


def test_correction_keeps_identity():
    book = make_epub(more='<meta name="calibre:series" content="Old"/>')
    new = epub.corrected(book, title="New & <better>", series="Saga", series_index="2")
    got = epub.metadata(new)
    assert (got.title, got.author, got.series, got.series_index) == ("New & <better>", "An Author", "Saga", 2.0)
    assert epub.identity(new)[1] == epub.identity(book)[1]
    with pytest.raises(epub.BadBook):
        epub.corrected(book, series="x", series_index="two")
    with pytest.raises(epub.BadBook):
        epub.corrected(book)


def test_spans_in_a_book():
    got = zipfile.ZipFile(io.BytesIO(epub.with_spans(make_epub(text="One. Two."))))
    assert b'id="kobo.1.2">Two.</span>' in got.read("OPS/chapter.xhtml")


def test_pdf_text_and_information():
    page = b"BT /F1 10 Tf 1 0 0 1 50 500 Tm (AB) Tj 0 -12 Td [(A) -300 (B) 20 (A)] TJ ET q 100 0 0 80 20 30 cm /Im0 Do Q"
    for compress in (False, True):
        d = pdf.Document(make_pdf(page, "/Title (A \\205 B) /Author <FEFF00C900E9>", compress))
        (p,) = d.pages()
        pieces, drawn = pdf.placed(d, p)
        assert d.size(p) == (400.0, 600.0)
        assert [(x["text"], x["x"], x["y"], x["size"]) for x in pieces] == [("AB", 50, 500, 10), ("A BA", 50, 488, 10)]
        assert abs(pieces[0]["advance"] - 13) < 1e-6 and drawn == [{"name": "Im0", "top": 110.0, "height": 80.0, "width": 100.0}]
        assert pdf.information(make_pdf(page, "/Title (A \\205 B) /Author <FEFF00C900E9>", compress)) == {"Title": "A – B", "Author": "Éé"}
    with pytest.raises(epub.BadBook):
        pdf.Document(b"no")


def test_pdf_text_moves_by_what_is_shown():
    """Widths of A and B are 0.6 and 0.7 em; spacing, stretch, rise and leading as the standard has them."""

    def at(body):
        d = pdf.Document(make_pdf(body))
        return [(p["text"], *(round(p[k], 6) for k in ("x", "y", "size", "advance"))) for p in pdf.placed(d, d.pages()[0])[0]]

    assert at(b"BT /F1 10 Tf 5 5 Td (A) Tj (B) Tj ET") == [("A", 5, 5, 10, 6), ("B", 11, 5, 10, 7)]
    assert at(b"BT /F1 10 Tf 1 Tc 200 Tz (AB) Tj (A) Tj ET") == [("AB", 0, 0, 10, 30), ("A", 30, 0, 10, 14)]
    assert at(b"BT /F1 10 Tf 12 TL 3 Ts (A) Tj T* 0 Ts (B) Tj (A) ' 2 1 (B) \" ET") == [("A", 0, 3, 10, 6), ("B", 0, -12, 10, 7), ("A", 0, -24, 10, 6), ("B", 0, -36, 10, 8)]
    assert at(b"2 0 0 2 10 20 cm BT /F1 10 Tf 0 1 -1 0 5 5 Tm (A) Tj (B) Tj ET") == [("A", 20, 30, 20, 12), ("B", 20, 42, 20, 14)]
    assert at(b"q BT /F1 10 Tf ET 3 0 0 3 0 0 cm Q BT (A) Tj /F1 8 Tf (A) Tj ET") == [("A", 0, 0, 0, 0), ("A", 0, 0, 8, 4.8)]
    assert at(b"Q Q cm Td Tf 1 cm BT /F1 10 Tf 4 2 TD (A) Tj T* (B) Tj ET") == [("A", 4, 2, 10, 6), ("B", 4, 4, 10, 7)]


def test_pdf_forms_have_a_matrix_and_never_draw_themselves():
    form = lambda n, body, more=b"": b"%d 0 obj\n<< /Subtype /Form /Matrix [2 0 0 2 1 1] /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (n, len(body), more, body)
    whole = make_pdf(b"1 0 0 1 10 10 cm /X Do q 5 0 0 7 0 0 cm /Im Do Q")
    whole = whole.replace(b"/Resources << ", b"/Resources << /XObject << /X 8 0 R >> ").replace(b"trailer", form(8, b"BT /F1 10 Tf (A) Tj ET /X Do /Y Do", b"/Resources << /Font << /F1 6 0 R >> /XObject << /X 8 0 R /Y 9 0 R >> >>") + form(9, b"BT /F1 10 Tf (B) Tj ET") + b"trailer")
    d = pdf.Document(whole)
    pieces, drawn = pdf.placed(d, d.pages()[0])
    assert [(p["text"], p["x"], p["y"], p["size"]) for p in pieces] == [("A", 11, 11, 20), ("B", 13, 13, 40)]
    assert drawn == [{"name": "Im", "top": 17.0, "height": 7.0, "width": 5.0}]


def test_pdf_pieces_become_lines(spark):
    lines = b"BT /F1 11 Tf 1 0 0 1 50 700 Tm (Hello) Tj 60 0 Td (world) Tj -60 -14 Td (again) Tj ET"
    files = spark.createDataFrame([("a.pdf", bytearray(make_pdf(lines))), ("b.pdf", bytearray(b"x"))], "path string, content binary")
    rows = pdf.pieces(files)
    assert rows.where("error IS NOT NULL").count() == 1
    got = Y.lines(rows.where("text IS NOT NULL").withColumnRenamed("doc", "doc_id")).orderBy("line").collect()
    assert [r.text for r in got] == ["Hello world", "again"]


def test_reading_a_folder(spark, tmp_path):
    for name, body in {"a.epub": make_epub(), "deep/b.pdf": make_pdf(b"", "/Title (P)"), "bad.epub": b"bad", ".hidden/c.epub": make_epub(), "notes.txt": b"x", "r.acsm": b"<r/>", "archive/r.acsm": b"<r/>"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    files = books.listing(spark, str(tmp_path))
    found = books.book_files(files)
    assert {r.below for r in found.collect()} == {"a.epub", "deep/b.pdf", "bad.epub"}
    got = {r.below: r for r in books.read(spark, str(tmp_path), found).collect()}
    assert got["a.epub"].title == "A Title" and got["deep/b.pdf"].title == "P" and got["bad.epub"].author.startswith("Unreadable: ") and got["bad.epub"].sha == ""
    asked = books.requests(files).withColumn("sha", F.lit("same"))
    assert books.spent(asked, asked.where("below LIKE '%archive/%'")).count() == 0
    card = [(r.path, r.directory) for r in books.card_files(spark, str(tmp_path)).collect()]
    assert ("deep", True) in card and ("deep/b.pdf", False) in card and not any(p.startswith(".") for p, _ in card)


FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opds="http://opds-spec.org/2010/catalog"><title>T</title><link rel="next" href="?page=2"/>
<entry><id>1</id><title>One</title><author><name>A</name></author><author><name>B</name></author>
<link rel="http://opds-spec.org/acquisition/open-access" type="text/html" href="/read"/><link rel="http://opds-spec.org/acquisition/open-access" type="application/epub+zip" href="/1.epub" length="10"/></entry>
<entry><id>2</id><link rel="http://opds-spec.org/acquisition/borrow" type="application/atom+xml;type=entry" href="/b"><opds:availability status="available"/>
<opds:indirectAcquisition type="application/atom+xml"><opds:indirectAcquisition type="application/vnd.adobe.adept+xml"><opds:indirectAcquisition type="application/pdf"/></opds:indirectAcquisition></opds:indirectAcquisition></link></entry>
<entry><id>3</id><link rel="http://opds-spec.org/acquisition/borrow" type="application/atom+xml" href="/c"><opds:indirectAcquisition type="application/audiobook+lcp"/></link></entry>
<entry><id>4</id><title>More</title><link rel="subsection" type="application/atom+xml;profile=opds-catalog" href="more"/></entry></feed>"""


def test_feed(spark):
    made = opds.feeds(spark.createDataFrame([("http://h/c/feed", FEED), ("http://h/x", "<!DOCTYPE html><html>"), ("http://h/y", "<a/>"), ("http://h/z", None)], "address string, text string"))
    rows = {r.address: r for r in made.collect()}
    assert rows["http://h/c/feed"].next == "http://h/c/feed?page=2" and "web page" in rows["http://h/x"].error and rows["http://h/y"].error and rows["http://h/z"].error
    best = {r.entry_id: r for r in E.best_offers(E.offers(opds.offers(made))).collect()}
    assert (best["1"].delivery, best["1"].format) == ("book", "epub") and (best["2"].delivery, best["2"].shown) == ("acsm", "PDF via Adobe DRM") and best["3"].shown.startswith("Readium LCP")
    entries = opds.entries(made)
    assert [r.title for r in E.navigation(entries).collect()] == ["More"]
    lines = {r.id: r.a for r in entries.select("id", E.author_line(F.col("authors")).alias("a")).collect()}
    assert lines["1"] == "A and others" and lines["2"] == "Unknown author"
    assert opds.pages(made, "http://h/c/feed", 5) == ["http://h/c/feed"]


def test_search_template():
    d = '<OpenSearchDescription xmlns="http://a9.com/-/spec/opensearch/1.1/"><Url type="text/html" template="/w?q={searchTerms}"/><Url type="application/atom+xml;profile=opds-catalog" template="/s?q={searchTerms}"/></OpenSearchDescription>'
    assert opds.search_address(d, "http://h/a", "two words & é") == "http://h/s?q=two+words+%26+%C3%A9"


def make_device(path, old=False, wal=False):
    db = sqlite3.connect(path)
    if wal:
        db.execute("PRAGMA journal_mode=WAL")
    db.execute("CREATE TABLE content (ContentID TEXT PRIMARY KEY, Title TEXT, Attribution TEXT" + ("" if old else ", Accessibility INTEGER") + ")")
    db.executemany(f"INSERT INTO content VALUES (?, ?, ?{'' if old else ', ?'})", [r[: 3 if old else 4] for r in (("b1", "Test", "A", "6"), ("b2", "", None, "1"), ("b3", "Gone", "C", None))])
    db.execute("CREATE TABLE content_keys (volumeid TEXT, elementid TEXT, elementkey TEXT)")
    db.execute("INSERT INTO content_keys VALUES ('b1', 'e', 'k')")
    db.execute("CREATE TABLE Bookmark (VolumeID TEXT, Text TEXT, Annotation TEXT, DateCreated TEXT, ChapterProgress REAL, Hidden TEXT, Type TEXT)")
    db.executemany("INSERT INTO Bookmark VALUES (?, ?, ?, ?, ?, ?, 'x')", [("b1", " lit ", None, "2025-09-02T07:43:13", 0.222, "false"), ("b1", "", "said", "", 0.5, None), ("b1", " ", None, "", 0.6, "false"), ("b1", "h", None, "", 0.7, "true")])
    inner = "" if old else "InternalName TEXT, "
    db.execute(f"CREATE TABLE Shelf ({inner}Name TEXT, _IsDeleted TEXT)")
    db.executemany(f"INSERT INTO Shelf VALUES ({'' if old else '?, '}?, ?)", [r[1:] if old else r for r in (("i1", "Science", "false"), ("i2", "Empty", None), ("i3", "Old", "true"))])
    db.execute("CREATE TABLE ShelfContent (ShelfName TEXT, ContentId TEXT, DateModified TEXT, _IsDeleted TEXT)")
    db.executemany("INSERT INTO ShelfContent VALUES (?, ?, '', ?)", [("Science" if old else "i1", "b1", "false"), ("Science", "b9", None), ("Science", "b2", "true"), ("i3", "b1", None)])
    db.commit()
    return db


@pytest.mark.parametrize("old", [False, True])
def test_device_database(spark, tmp_path, old):
    path = str(tmp_path / "device.sqlite")
    db = make_device(path, old, wal=not old)
    t = lambda n: device_db.table(spark, path, n)
    store = D.store_books(t("content"), t("content_keys"), spark.createDataFrame([("b1",), ("b2",)], "id string"))
    got = {r.id: r for r in store.collect()}
    assert set(got) == {"b1", "b2"} and got["b1"].encrypted and got["b1"].preview == (not old) and got["b2"].title == "b2"
    notes = D.annotations(t("Bookmark"), t("content"))
    assert {(r.text, r.note) for r in notes.collect()} == {("lit", ""), ("", "said")}
    (doc,) = D.markdown(notes).collect()
    assert doc.document == "# Test\n\n*A*\n\n> lit\n\n— 22% in, 2025-09-02\n\nsaid\n\n— 50% in\n"
    shelves = D.shelved(t("Shelf"), t("ShelfContent"), t("content"))
    assert {(r.shelf, r.id, r.title) for r in shelves.collect()} == {("Science", "b1", "Test"), ("Science", "b9", "b9"), ("Empty", None, None)}
    assert {r.shelf: [b.id for b in r.books] for r in D.nested_shelves(shelves).collect()} == {"Science": ["b9", "b1"], "Empty": []}
    with pytest.raises(ValueError, match="Empty, Science"):
        D.on_shelf(store, shelves, "nowhere")
    db.execute("DROP TABLE Bookmark")
    db.commit()
    assert t("Bookmark").count() == 0
    db.close()


def test_samples_of_pictures():
    import numpy as np

    from shelfspark.sources import figures

    assert figures.samples(b"\xa0\x40", 3, 2, 1, 1)[..., 0].tolist() == [[1, 0, 1], [0, 1, 0]]  # a row begins at a byte
    assert figures.samples(b"\x1b\xe4", 4, 2, 1, 2)[..., 0].tolist() == [[0, 1, 2, 3], [3, 2, 1, 0]]
    assert figures.samples(b"\x01\x00\xff\xff", 2, 1, 1, 16)[..., 0].tolist() == [[256, 65535]]
    with pytest.raises(epub.BadBook):
        figures.samples(b"\x00", 3, 1, 3, 8)
    whole = make_pdf(b"")
    body = b"87cURDZ~>"
    image = lambda n, more, raw: b"%d 0 obj\n<< /Subtype /Image %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, more, len(raw), raw)
    whole = whole.replace(b"trailer", image(20, b"/Width 5 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter [/ASCII85Decode]", body) + image(21, b"/Width 4 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8 /Decode [1 0] /Filter /RunLengthDecode", b"\xfe\x10\x00\x05\x80")
                          + image(22, b"/Width 2 /Height 1 /ImageMask true", b"\x40") + image(23, b"/Filter [/ASCIIHexDecode /DCTDecode]", b"FFD8>") + image(24, b"/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /Lab", b"abc") + b"trailer")
    d = pdf.Document(whole)
    of = lambda n: figures.pixels(d, d.get(pdf.Ref(n)))[0, :, 0].tolist()
    assert of(20) == list(b"Hello") and of(21) == [239, 239, 239, 250] and of(22) == [0, 255]
    assert figures.picture(d, d.get(pdf.Ref(23))) == ("image/jpeg", b"\xff\xd8")
    with pytest.raises(epub.BadBook):
        figures.picture(d, d.get(pdf.Ref(24)))
    made = figures.png(np.arange(18, dtype=np.uint8).reshape(2, 3, 3))
    assert made.startswith(b"\x89PNG") and zlib.decompress(made[made.index(b"IDAT") + 4 : made.index(b"IEND") - 8])[1:10] == bytes(range(9))


def test_a_database_is_read_in_parts_and_filters_reach_it(spark, tmp_path):
    path = str(tmp_path / "big.sqlite")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE Bookmark (VolumeID TEXT, Text, Annotation TEXT, DateCreated TEXT, ChapterProgress REAL, Hidden TEXT)")
    rows = [(f"v{i % 7}", [None, "", "t", 5, 2.5, b"x"][i % 6] if i % 6 < 5 else "z", None, "2025", i / 1000, ["true", "false", None, "1", 0][i % 5]) for i in range(1000)]
    db.executemany("INSERT INTO Bookmark VALUES (?, ?, ?, ?, ?, ?)", rows)
    db.execute("DELETE FROM Bookmark WHERE rowid BETWEEN 300 AND 420")
    db.commit()
    db.close()
    del rows[299:420]
    t = device_db.table(spark, path, "Bookmark", rows=100)
    assert t.rdd.getNumPartitions() == 9 and t.count() == len(rows)
    as_read = [tuple(None if x is None else x if i == 4 else str(x) for i, x in enumerate(r)) for r in rows]
    key = lambda r: tuple(map(str, r))
    for where, holds in (
        ([ds.EqualTo(("Hidden",), "true"), ds.In(("VolumeID",), ("v1", "v3"))], lambda r: r[5] == "true" and r[0] in ("v1", "v3")), ([ds.IsNull(("Text",))], lambda r: r[1] is None), ([ds.EqualTo(("Text",), "5")], lambda r: r[1] == "5"),
        ([ds.In(("Text",), ("2.5", "t"))], lambda r: r[1] in ("2.5", "t")), ([ds.StringStartsWith(("Text",), "2")], lambda r: (r[1] or "").startswith("2")), ([ds.IsNotNull(("Hidden",)), ds.EqualTo(("Hidden",), "0")], lambda r: r[5] == "0"),
    ):
        some = device_db.table(spark, path, "Bookmark", where, 100)
        assert sorted(map(tuple, some.collect()), key=key) == sorted(filter(holds, as_read), key=key), where
        db = sqlite3.connect(path)
        sent = list(device_db.columns_of(db, "Bookmark", ["VolumeID", "Text", "Annotation", "DateCreated", "ChapterProgress", "Hidden"], ["string"] * 4 + ["double", "string"], where))
        db.close()
        assert len(sent) < len(rows) / 2  # what SQLite gives up at all
    assert sorted(map(tuple, t.where("Hidden = 'true'").collect()), key=key) == sorted((r for r in as_read if r[5] == "true"), key=key) and t.count() == len(rows)
    assert device_db.table(spark, path, "Shelf", [ds.EqualTo(("Name",), "x")]).count() == 0  # no such table
    with pytest.raises(ValueError):
        device_db.table(spark, path, "Bookmark", [ds.GreaterThan(("ChapterProgress",), 0.5)])


def test_places_of_rows(spark):
    from shelfspark.operators import ranks

    df = spark.range(997).select(((F.col("id") * 7919) % 997).alias("id")).repartition(9)
    assert {(r.id, r.place) for r in ranks.numbered(df, [F.col("id").desc()]).collect()} == {(i, 997 - i) for i in range(997)}
    assert ranks.numbered(df.where("false"), [F.col("id")]).count() == 0
