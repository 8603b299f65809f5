"""EPUB files as bytes: what they say about themselves, what they are, whether they are whole, and corrected copies."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from shelfspark.operators.segment import spanned

# Limits, names and algorithms.
MAX_BOOK, MAX_EXPANDED, MAX_ENTRIES, MAX_MEMBER = 128 << 20, 256 << 20, 20_000, 8 << 20
MIMETYPE, CONTAINER, ENCRYPTION, RIGHTS = b"application/epub+zip", "META-INF/container.xml", "META-INF/encryption.xml", "META-INF/rights.xml"
DEVICE_MARKER = "META-INF/xteink-device-profile.txt"
FONT_ALGORITHMS = {"http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"}
DC = "{http://purl.org/dc/elements/1.1/}"
SERIES_ID = "series"
#: Bytes of its members that an open archive keeps; a larger member is read in pieces.
HELD = 8 << 20


class BadBook(ValueError):
    """Why a file can't be taken as a book."""


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


class Archive(zipfile.ZipFile):
    """An archive in memory. Members that are plain (whole, stored or deflated, as the directory says) are read where they lie, once for all that ask; others are left to zipfile."""

    def __init__(self, data: bytes):
        super().__init__(io.BytesIO(data))
        self.data, self.held, self.room, self.sound, self.trees = data, {}, HELD, False, {}
        starts = sorted(i.header_offset for i in self.infolist())
        self.ends = dict(zip(starts, [*starts[1:], self.start_dir], strict=True)) if len(set(starts)) == len(starts) else {}

    def raw(self, i: zipfile.ZipInfo) -> bytes | None:
        """A member as it is stored; None if its own header says anything else than the directory, or it is of a kind that isn't read here."""
        at, d = i.header_offset, self.data
        if i.flag_bits & 0x61 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or at < 0 or d[at : at + 4] != b"PK\3\4" or at + 30 > len(d):
            return None
        n, more = struct.unpack_from("<2H", d, at + 26)
        begin = at + 30 + n + more
        if d[at + 30 : at + 30 + n] != i.orig_filename.encode("utf-8" if i.flag_bits & 0x800 or i.orig_filename.isascii() else "cp437") or begin + i.compress_size > self.ends.get(at, -1):
            return None
        return d[begin : begin + i.compress_size]

    def plain(self, i: zipfile.ZipInfo) -> bytes | None:
        """What a plain member says, if its length and checksum are those of the directory."""
        if (out := self.held.get(i.header_offset)) is None and (out := self.raw(i)) is not None:
            try:
                out = out if i.compress_type == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(out, i.file_size + 1)
            except zlib.error:
                return None
            if len(out) != i.file_size or zlib.crc32(out) != i.CRC:
                return None
            if len(out) <= self.room:
                self.held[i.header_offset] = out
                self.room -= len(out)
        return out

    def read(self, name: str | zipfile.ZipInfo, pwd: bytes | None = None) -> bytes:
        i = name if isinstance(name, zipfile.ZipInfo) else self.getinfo(name)
        return super().read(i, pwd) if (out := self.plain(i)) is None else out


def opened(data: bytes | Archive) -> Archive:
    """The archive; one that is open already is handed on, so that what asks for it in turn reads it once."""
    if isinstance(data, Archive):
        return data
    try:
        return Archive(data)
    except zipfile.BadZipFile as e:
        raise BadBook("not a ZIP archive") from e


def _member(z: Archive, name: str, most: int = MAX_MEMBER) -> bytes:
    try:
        i = z.getinfo(name)
        if i.file_size <= min(most, HELD):
            return z.read(i)
        with z.open(i) as f:
            out = f.read(most + 1)
    except KeyError as e:
        raise BadBook(f"{name} is missing") from e
    except (zipfile.BadZipFile, RuntimeError, OSError) as e:
        raise BadBook(f"{name} can't be read") from e
    if len(out) > most:
        raise BadBook(f"{name} is larger than {most} bytes")
    return out


def stored(name: str, body: bytes, method: int = zipfile.ZIP_STORED, date: tuple = (1980, 1, 1, 0, 0, 0)) -> tuple:
    """A member for archived()."""
    squeeze = zlib.compressobj(-1, zlib.DEFLATED, -15) if method == zipfile.ZIP_DEFLATED else None
    return name, date, method, zlib.crc32(body), len(body), squeeze.compress(body) + squeeze.flush() if squeeze else body


def archived(members: Iterable[tuple]) -> bytes:
    """An archive of members (name, date, method, checksum, length, bytes as they are stored), the same that zipfile writes; zipfile can't take one over without packing it anew."""
    parts, directory, at, count = [], [], 0, 0
    for name, date, method, crc, size, body in members:
        raw = name.encode()
        flags, day, time = 0 if name.isascii() else 0x800, date[0] - 1980 << 9 | date[1] << 5 | date[2], date[3] << 11 | date[4] << 5 | date[5] // 2
        if at + len(body) > 0x7FFFFFFF or size > 0x7FFFFFFF or count == 0xFFFF:
            raise BadBook("too large")
        said = struct.pack("<5H3L2H", 20, flags, method, time, day, crc, len(body), size, len(raw), 0)
        parts += b"PK\3\4", said, raw, body
        directory += b"PK\1\2\x14\3", said, struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, at), raw
        at, count = at + 30 + len(raw) + len(body), count + 1
    end = b"".join(directory)
    return b"".join([*parts, end, b"PK\5\6", struct.pack("<4H2LH", 0, 0, count, count, len(end), at, 0)])


def _xml(data: bytes, what: str) -> ET.Element:
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise BadBook(f"{what} is not XML") from e


def _tree(z: Archive, name: str, what: str) -> ET.Element:
    """A member as XML, parsed once."""
    if name not in z.trees:
        z.trees[name] = _xml(_member(z, name), what)
    return z.trees[name]


def package_path(z: Archive) -> str:
    root = next((e for e in _tree(z, CONTAINER, CONTAINER).iter() if _local(e) == "rootfile"), None)
    if root is None or not root.get("full-path"):
        raise BadBook("no package document is named")
    return root.get("full-path")


def inspect(data: bytes | Archive) -> Archive:
    """The archive, if its members have safe and different names, agree with their sizes and are not too many or too large."""
    z = opened(data)
    if z.sound:
        return z
    infos = z.infolist()
    if len(infos) > MAX_ENTRIES:
        raise BadBook("too many entries")
    if len({i.filename for i in infos}) != len(infos):
        raise BadBook("two entries have one name")
    if any(i.orig_filename.startswith("/") or "\\" in i.orig_filename or "\0" in i.orig_filename or ".." in i.orig_filename.split("/") for i in infos):
        raise BadBook("an entry leads out of the archive")
    if sum(i.file_size for i in infos) > MAX_EXPANDED:
        raise BadBook("too large when expanded")
    for i in infos:
        try:
            if i.file_size <= HELD:
                read = len(z.read(i))
            else:
                with z.open(i) as f:
                    read = 0
                    while chunk := f.read(1 << 16):
                        read += len(chunk)
        except (zipfile.BadZipFile, RuntimeError, OSError, EOFError) as e:
            raise BadBook(f"{i.filename} can't be read") from e
        if read != i.file_size:
            raise BadBook(f"{i.filename} has another size than it says")
    z.sound = True
    return z


@dataclass
class Metadata:
    title: str | None
    author: str
    identifiers: list[str]
    series: str | None
    series_index: float | None


def metadata(data: bytes | Archive) -> Metadata | None:
    """What the package document says; None if this is no EPUB."""
    z = opened(data)
    names = set(z.namelist())
    if not {"mimetype", CONTAINER} <= names or _member(z, "mimetype") != MIMETYPE:
        return None
    package = _tree(z, package_path(z), "the package document")
    texts = lambda tag: [t for e in package.iter(DC + tag) if (t := (e.text or "").strip())]
    metas = [e for e in package.iter() if _local(e) == "meta"]
    named = lambda name: next((e.get("content", "").strip() for e in metas if e.get("name") == name), "")
    group = next((e for e in metas if e.get("property") == "belongs-to-collection"), None)
    series = named("calibre:series") or (group is not None and (group.text or "").strip()) or None
    index = _number(named("calibre:series_index"))
    if index is None and group is not None and group.get("id"):
        at = next((e for e in metas if e.get("refines") == "#" + group.get("id") and e.get("property") == "group-position"), None)
        index = _number(at.text) if at is not None else None
    return Metadata(next(iter(texts("title")), None), ", ".join(texts("creator")), texts("identifier"), series, index)


def _number(x: str | None) -> float | None:
    try:
        return float((x or "").strip())
    except ValueError:
        return None


def identity(data: bytes | Archive) -> tuple[str, str | None]:
    """SHA-256 of the bytes, and of the resources: all members but the package document and the device marker, by name.

    Repacking, renaming and corrected metadata leave the second as it is. It is None for what is no EPUB.
    """
    whole = hashlib.sha256(data.data if isinstance(data, Archive) else data).hexdigest()
    try:
        z = inspect(data)
        if not {"mimetype", CONTAINER} <= set(z.namelist()):
            return whole, None
        try:
            package = package_path(z)
        except BadBook:
            package = None
        digest = hashlib.sha256()
        for i in sorted(z.infolist(), key=lambda i: i.filename.encode()):
            if i.filename in (DEVICE_MARKER, package) or i.is_dir():
                continue
            name = i.filename.encode()
            digest.update(len(name).to_bytes(8, "little") + name + i.file_size.to_bytes(8, "little"))
            if i.file_size <= HELD:
                digest.update(z.read(i))
                continue
            with z.open(i) as f:
                while chunk := f.read(1 << 16):
                    digest.update(chunk)
        return whole, digest.hexdigest()
    except BadBook:
        return whole, None


def is_device_copy(data: bytes | Archive) -> bool:
    return DEVICE_MARKER in opened(data).namelist()


def resolve(base: str, href: str) -> str:
    """A path in the archive from a reference in a document in folder base."""
    raw = href.partition("#")[0]
    if re.search(r"%(?![0-9A-Fa-f]{2})", raw):
        raise BadBook("invalid escape in a reference")
    try:
        path = unquote_to_bytes(raw).decode()
    except UnicodeDecodeError as e:
        raise BadBook("a reference is not UTF-8") from e
    if path.startswith("/") or "\\" in path or ":" in path:
        raise BadBook("invalid reference")
    out = posixpath.normpath(f"{base}/{path}" if base else path)
    if out.startswith(".."):
        raise BadBook("a reference leads out of the book")
    return out


def check_encryption(z: Archive) -> None:
    """Obfuscated fonts are no obstacle; anything else that is encrypted is."""
    names = z.namelist()
    if RIGHTS in names:
        raise BadBook("it has a rights document")
    if ENCRYPTION in names:
        for e in _xml(_member(z, ENCRYPTION), ENCRYPTION).iter():
            if _local(e) == "EncryptedData":
                method = next((m.get("Algorithm") for m in e.iter() if _local(m) == "EncryptionMethod"), None)
                if method not in FONT_ALGORITHMS:
                    raise BadBook("its content is encrypted")


def spine(z: Archive) -> list[tuple[str, str]]:
    """(path, media type) of the documents in reading order."""
    root = package_path(z)
    package = _tree(z, root, "the package document")
    items = {}
    for e in package.iter():
        if _local(e) == "item" and e.get("id") is not None:
            items.setdefault(e.get("id"), e)
    out = []
    for ref in (e for e in package.iter() if _local(e) == "itemref"):
        item = items.get(ref.get("idref"))
        if item is None or item.get("href") is None:
            raise BadBook("the reading order names what is not in the manifest")
        out.append((resolve(posixpath.dirname(root), item.get("href")), item.get("media-type", "")))
    return out


def validate(data: bytes | Archive) -> None:
    """Raises BadBook unless this is a whole, readable EPUB."""
    if len(data.data if isinstance(data, Archive) else data) > MAX_BOOK:
        raise BadBook("too large")
    z = inspect(data)
    if _member(z, "mimetype") != MIMETYPE:
        raise BadBook("another media type")
    chapters = spine(z)
    if not chapters:
        raise BadBook("no reading order")
    for path, kind in chapters:
        body = _member(z, path, MAX_EXPANDED)
        if kind == "application/xhtml+xml":
            _xml(body, path)
    check_encryption(z)


def validate_as(format_: str, data: bytes) -> None:
    """Raises BadBook unless the bytes are what their name claims."""
    if format_ == "epub":
        validate(data)
    elif format_ == "pdf":
        if b"%PDF-" not in data[:1024]:
            raise BadBook("no PDF header")
        if b"%%EOF" not in data[-4096:]:
            raise BadBook("an incomplete PDF")
    elif format_ == "cbz":
        if not any(re.search(r"\.(?:jpe?g|png|gif|webp|bmp|avif)$", n, re.I) for n in inspect(data).namelist()):
            raise BadBook("a CBZ without pictures")
    else:
        raise BadBook(f"unknown format {format_}")


def rewritten(data: bytes | Archive, change: dict[str, bytes], added: dict[str, bytes] | None = None) -> bytes:
    """The archive with some members replaced or put at its end; the media type first and stored, as readers want it. Other plain members are taken over as they are packed."""
    old, added = opened(data), added or {}

    def members():
        yield stored("mimetype", MIMETYPE)
        for i in old.infolist():
            if i.filename != "mimetype" and i.filename not in added:
                body = b"" if i.is_dir() else change.get(i.filename)
                if body is None and old.plain(i) is not None:
                    yield i.filename, i.date_time, i.compress_type, i.CRC, i.file_size, old.raw(i)
                else:
                    yield stored(i.filename, old.read(i) if body is None else body, zipfile.ZIP_DEFLATED, i.date_time)
        for name, body in added.items():
            yield stored(name, body)

    return archived(members())


def _element(pattern: str) -> re.Pattern:
    return re.compile(rf"<({pattern})(?:\s[^>]*)?(?:/>|>.*?</(?:dc:)?[a-z]+>)", re.S)


def corrected(data: bytes | Archive, title: str | None = None, author: str | None = None, series: str | None = None, series_index: str | None = None) -> bytes:
    """The book with another title, author or series; an empty text takes one away. All else stays byte for byte."""
    if title is author is series is series_index is None:
        raise BadBook("nothing to change")
    z = opened(data)
    check_encryption(z)
    root = package_path(z)
    head, end, tail = _member(z, root).decode().partition("</metadata>")
    if not end:
        raise BadBook("no metadata to change")
    clean = lambda x: re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", escape(x.strip(), {'"': "&quot;"}))
    added = ""
    for tag, value in (("title", title), ("creator", author)):
        if value is not None:
            head = _element(f"(?:dc:)?{tag}").sub("", head)
            added += f"<dc:{tag}>{clean(value)}</dc:{tag}>" if value.strip() else ""
    if series is not None or series_index is not None:
        head = re.sub(r'<meta\s(?=[^>]*(?:name="calibre:series(?:_index)?"|property="belongs-to-collection"|refines="#' + SERIES_ID + r'"))[^>]*(?:/>|>.*?</meta>)', "", head, flags=re.S)
        if series and series.strip():
            added += f'<meta name="calibre:series" content="{clean(series)}"/><meta property="belongs-to-collection" id="{SERIES_ID}">{clean(series)}</meta>'
            if series_index and series_index.strip():
                if _number(series_index) is None:
                    raise BadBook("the place in a series is no number")
                added += f'<meta name="calibre:series_index" content="{clean(series_index)}"/><meta refines="#{SERIES_ID}" property="group-position">{clean(series_index)}</meta>'
    out = rewritten(z, {root: (head + added + end + tail).encode()})
    new = opened(out)
    validate(new)
    after = metadata(new)
    if title and title.strip() and after.title != title.strip() or series and series.strip() and after.series != series.strip():
        raise BadBook("the change did not take")
    return out


def with_spans(data: bytes) -> bytes:
    """The book with the sentences of its documents in numbered spans."""
    z = inspect(data)
    package = _tree(z, package_path(z), "the package document")
    folder = posixpath.dirname(package_path(z))
    prose = {resolve(folder, e.get("href")) for e in package.iter() if _local(e) == "item" and e.get("media-type") == "application/xhtml+xml" and e.get("href")}
    return rewritten(z, {n: spanned(z.read(n).decode()).encode() for n in z.namelist() if n in prose})


def written(title: str, author: str, chapters: list[tuple[str, list[tuple[str, str]]]]) -> bytes:
    """A book from chapters of (heading or paragraph, text)."""
    if not any(kind == "paragraph" and len(text.encode()) > 40 for _, blocks in chapters for kind, text in blocks):
        raise BadBook("no prose to make a book from")
    names = [f"chapter{i}.xhtml" for i in range(1, len(chapters) + 1)]
    page = lambda name, body: f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(name)}</title></head><body>{body}</body></html>'
    tag = {"heading": "h2", "paragraph": "p"}
    members = {n: page(name, "".join(f"<{tag[k]}>{escape(t)}</{tag[k]}>" for k, t in blocks)) for n, (name, blocks) in zip(names, chapters, strict=True)}
    members["nav.xhtml"] = page("Contents", '<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>' + "".join(f'<li><a href="{n}">{escape(name)}</a></li>' for n, (name, _) in zip(names, chapters, strict=True)) + "</ol></nav>")
    items = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' + "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    identifier = hashlib.sha256("".join(members.values()).encode()).hexdigest()
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">sha256:{identifier}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>und</dc:language>{f"<dc:creator>{escape(author)}</dc:creator>" if author else ""}</metadata>'
        f'<manifest>{items}</manifest><spine>{"".join(f"<itemref idref={chr(34)}c{i}{chr(34)}/>" for i in range(len(names)))}</spine></package>'
    )
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    data = archived([stored("mimetype", MIMETYPE), *(stored(name, body.encode(), zipfile.ZIP_DEFLATED) for name, body in {CONTAINER: container, "book.opf": opf, **members}.items())])
    validate(data)
    return data
