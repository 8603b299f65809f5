"""Archives of books: opened once, each member read once, taken over as it is packed, and read as zipfile reads them."""

import io
import random
import zipfile
import zlib

import numpy as np
import pytest

from shelfspark.plans.registry import QUERIES
from shelfspark.sources import epub, figures, screens
from tests.test_sources import make_epub


def zipped(members, method=zipfile.ZIP_DEFLATED, into=None):
    out = into or io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in members:
            z.writestr(zipfile.ZipInfo(name, (2024, 5, 6, 7, 8, 10)), body, method)
    return out.getvalue()


class Unseekable(io.BytesIO):
    def seekable(self):
        return False

    def seek(self, *a):
        raise io.UnsupportedOperation

    def tell(self):
        raise io.UnsupportedOperation


MEMBERS = [("a", b""), ("b/", b""), ("ä/ß.txt", b"x" * 500), ("c", bytes(range(256)) * 4)]


def test_archives_are_those_of_zipfile():
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        assert epub.archived(epub.stored(n, b, method, (2024, 5, 6, 7, 8, 10)) for n, b in MEMBERS) == zipped(MEMBERS, method)
    assert epub.archived([]) == zipped([])


def outcome(read):
    try:
        return read()
    except Exception as e:
        return type(e), str(e)


def test_archives_are_read_as_by_zipfile():
    whole = zipped(MEMBERS)
    told = whole.replace(b"PK\3\4" + whole[4:30] + b"a", b"PK\3\4" + whole[4:30] + b"z", 1)  # the member has another name than the directory gives
    pick, books = random.Random(5), [whole, zipped(MEMBERS, zipfile.ZIP_STORED), zipped(MEMBERS, zipfile.ZIP_BZIP2), b"before it" + whole, zipped(MEMBERS, into=Unseekable()), told]
    for _ in range(400):
        at = pick.randrange(len(whole))
        books.append(whole[:at] + bytes([whole[at] ^ 1 << pick.randrange(8)]) + whole[at + 1 :])
    for book in books:
        try:
            plain = zipfile.ZipFile(io.BytesIO(book))
        except Exception as e:
            with pytest.raises((epub.BadBook, type(e))):
                epub.opened(book)
            continue
        own = epub.opened(book)
        for i in plain.infolist():
            assert outcome(lambda: own.read(i.filename)) == outcome(lambda: plain.read(i.filename))
            assert outcome(lambda: own.read(i.filename)) == outcome(lambda: plain.read(i.filename))


def test_members_are_taken_over_as_they_are_packed():
    squeezed = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = b"some words " * 300
    packed = squeezed.compress(body[:40]) + squeezed.flush(zlib.Z_FULL_FLUSH) + squeezed.compress(body[40:]) + squeezed.flush()
    old = epub.archived([epub.stored("mimetype", epub.MIMETYPE), ("x", (1990, 2, 3, 4, 5, 6), 8, zlib.crc32(body), len(body), packed), epub.stored("y", b"old")])
    new = epub.opened(epub.rewritten(old, {"y": b"new"}, {"z": b"more"}))
    assert [new.read(n) for n in ("mimetype", "x", "y", "z")] == [epub.MIMETYPE, body, b"new", b"more"] and new.testzip() is None
    assert new.raw(new.getinfo("x")) == packed and new.getinfo("x").date_time == (1990, 2, 3, 4, 5, 6)


@pytest.fixture
def counted(monkeypatch):
    seen = {"opened": 0, "unpacked": 0}
    begin, unpack = zipfile.ZipFile.__init__, zlib.decompressobj

    def opening(self, *a, **k):
        seen["opened"] += 1
        begin(self, *a, **k)

    def unpacking(*a, **k):
        seen["unpacked"] += a[:1] == (-15,)
        return unpack(*a, **k)

    monkeypatch.setattr(zipfile.ZipFile, "__init__", opening)
    monkeypatch.setattr(zlib, "decompressobj", unpacking)
    return seen


def test_a_correction_opens_each_book_once(counted):
    book = make_epub(method=zipfile.ZIP_DEFLATED)
    counted["opened"] = 0
    old = epub.opened(book)
    new = epub.opened(epub.corrected(old, title="Other"))
    assert epub.metadata(new).title == "Other" and epub.identity(new)[1] == epub.identity(old)[1]
    assert counted["opened"] <= 3 and counted["unpacked"] <= 12  # the old book, what was made as it is checked, and as it is read


def test_a_device_copy_opens_each_book_once(counted):
    wide = figures.png(np.full((4, 1000, 3), 90, np.uint8))
    book = epub.rewritten(make_epub(method=zipfile.ZIP_DEFLATED), {}, {"w.png": wide})
    counted.update(opened=0, unpacked=0)
    assert screens.device_copy(book, "X3")[1] == 1
    assert counted["opened"] == 2 and counted["unpacked"] <= 2 * 4


def test_weights_are_kept_and_small():
    screens.weights.cache_clear()
    for n, m in ((480, 681), (480, 16384), (1, 16384), (959, 960)):
        assert sum(x.nbytes for x in screens.weights(n, m)) <= 24 * m + 24 * n
        assert abs(screens.weights(n, m)[1].sum(1) - 1).max() < 1e-5
    assert screens.weights.cache_info().hits == 4


def test_books_are_made_once_and_not_moved(spark, small):
    for name in ("device_pictures", "corrected_books"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
