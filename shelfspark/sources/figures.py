"""Pictures of PDF pages as PNG or JPEG files: filters undone, samples unpacked, colours turned into RGB, transparency laid over white.

A picture whose last filter is DCT is a JPEG already and stays as it is behind the filters around it. Of all others the samples
are read: 1, 2, 4, 8 or 16 bits, gray, RGB, CMYK, ICC-based by their number of components, or indexed in one of these.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfspark.shipping import in_batches, ship
from shelfspark.sources.epub import BadBook
from shelfspark.sources.pdf import Document, Painter, Stream, painted

MOST_PIXELS = 1 << 26
# Colour spaces by name, as their number of components.
COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}


def space_of(d: Document, entry) -> tuple[int, bytes | None]:
    """Components of a colour space, or those of its base and the palette."""
    entry = d.get(entry)
    parts = [d.get(x) for x in entry] if isinstance(entry, list) else [entry]
    if parts[0] in COMPONENTS:
        return COMPONENTS[parts[0]], None
    if parts[0] == "ICCBased" and len(parts) > 1 and isinstance(parts[1], Stream):
        n = d.get(parts[1].entries.get("N"))
        if n in (1, 3, 4):
            return n, None
    if parts[0] in ("Indexed", "I") and len(parts) > 3:
        base, nested = space_of(d, parts[1])
        table = d.content(parts[3]) if isinstance(parts[3], Stream) else parts[3]
        if nested is None and isinstance(table, bytes):
            return base, table
    raise BadBook("a colour space that is not read")


def samples(data: bytes, width: int, height: int, n: int, bits: int) -> np.ndarray:
    """height x width x n whole numbers; each row begins at a byte."""
    row = -(-width * n * bits // 8)
    if len(data) < row * height:
        raise BadBook("fewer samples than pixels")
    rows = np.frombuffer(data, np.uint8, row * height).reshape(height, row)
    if bits == 16:
        flat = rows.view(">u2").astype(np.uint32)
    elif bits == 8:
        flat = rows
    else:
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        flat = ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(height, -1)
    return flat[:, : width * n].reshape(height, width, n)


def coloured(levels: np.ndarray) -> np.ndarray:
    """Levels of 0 to 1 in one, three or four components as RGB bytes."""
    if levels.shape[-1] == 4:
        levels = (1 - levels[..., :3]) * (1 - levels[..., 3:])
    out = (levels.astype(np.float32) * np.float32(255) + np.float32(1e-3)).astype(np.uint8)
    return np.repeat(out, 3, axis=-1) if out.shape[-1] == 1 else out


@lru_cache(maxsize=16)
def colours(bits: int, n: int, turned: bool) -> np.ndarray:
    """The bytes of red, green and blue of each level of gray, of one of three components, or of each pair of an ink and black."""
    levels = np.arange(1 << bits, dtype=np.uint32) / np.float32((1 << bits) - 1)
    levels = 1 - levels if turned else levels
    if n == 4:
        ink, black = np.broadcast_arrays(levels[:, None], levels[None, :])
        return coloured(np.stack([ink, ink, ink, black], axis=-1))[..., 0]
    return coloured(levels[:, None]) if n == 1 else coloured(levels[:, None])[:, 0]


def _seen(raw: np.ndarray, bits: int, n: int, turned: bool) -> np.ndarray:
    table = colours(bits, n, turned)
    return table[raw[..., 0]] if n == 1 else table[raw] if n == 3 else table[raw[..., :3], raw[..., 3:]]


def pixels(d: Document, stream: Stream) -> np.ndarray:
    """height x width x 3 bytes."""
    e = stream.entries
    width, height = d.get(e.get("Width", e.get("W"))), d.get(e.get("Height", e.get("H")))
    if not (isinstance(width, int) and isinstance(height, int) and width > 0 and height > 0 and width * height <= MOST_PIXELS):
        raise BadBook("a picture without a size that can be read")
    stencil = d.get(e.get("ImageMask", e.get("IM"))) is True
    bits = 1 if stencil else d.get(e.get("BitsPerComponent", e.get("BPC", 8)))
    if bits not in (1, 2, 4, 8, 16):
        raise BadBook("samples of a size that is not read")
    n, palette = (1, None) if stencil else space_of(d, e.get("ColorSpace", e.get("CS")))
    data = d.content(stream)
    if data is None:
        raise BadBook("a filter that is not undone")
    raw = samples(data, width, height, 1 if palette is not None else n, bits)
    if palette is not None:
        table = np.frombuffer(palette.ljust((int(raw.max(initial=0)) + 1) * n, b"\0"), np.uint8)
        return _seen(table[: len(table) // n * n].reshape(-1, n), 8, n, False)[raw[..., 0]]
    turned = d.get(e.get("Decode", e.get("D")))
    turned = isinstance(turned, list) and len(turned) >= 2 and d.get(turned[0]) == 1 and d.get(turned[1]) == 0
    if n < 4 or bits <= 8:
        return _seen(raw, bits, n, turned)
    levels = raw / np.float32((1 << bits) - 1)
    return coloured(1 - levels if turned else levels)


def over_white(d: Document, stream: Stream, rgb: np.ndarray) -> np.ndarray:
    """The picture as it looks on paper, where a soft mask or a stencil lets it through."""
    mask = d.get(stream.entries.get("SMask"))
    if not isinstance(mask, Stream):
        return rgb
    alpha = pixels(d, mask)[..., :1].astype(np.uint32)
    height, width = rgb.shape[:2]
    if alpha.shape[:2] != (height, width):
        alpha = alpha[np.arange(height)[:, None] * alpha.shape[0] // height, np.arange(width)[None, :] * alpha.shape[1] // width]
    return ((rgb * alpha + 255 * (255 - alpha)) // 255).astype(np.uint8)


def png(levels: np.ndarray) -> bytes:
    """A PNG of one to four channels: gray, gray and alpha, RGB, RGBA; 8 or 16 bits by the type of the levels."""
    height, width, n = levels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    bits = 8 * levels.dtype.itemsize
    body, row = (levels.astype(">u2") if bits == 16 else levels).tobytes(), width * n * bits // 8
    rows = b"".join([x for at in range(0, len(body), row) for x in (b"\0", body[at : at + row])])
    head = struct.pack(">IIBBBBB", width, height, bits, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def picture(d: Document, stream: Stream) -> tuple[str, bytes]:
    """Media type and bytes of a picture."""
    filters = d.get(stream.entries.get("Filter"))
    names = [d.get(f) for f in (filters if isinstance(filters, list) else [filters])]
    if names and names[-1] in ("DCTDecode", "DCT"):
        around = Stream({**stream.entries, "Filter": names[:-1]}, stream.raw)
        body = d.content(around)
        if body is None:
            raise BadBook("a filter that is not undone")
        return "image/jpeg", body
    return "image/png", png(over_white(d, stream, pixels(d, stream)))


PICTURES = "doc string, page int, n int, name string, top double, width double, height double, media_type string, picture binary, error string"


def pictures(files: DataFrame) -> DataFrame:
    """A row for each picture that PDF files (path, content) draw, in order, with its place, and its bytes or why there are none."""
    ship(files.sparkSession)
    schema = T._parse_datatype_string(PICTURES)
    arrow = to_arrow_schema(schema)

    def of(painter: Painter, d: Document):
        for n, (drawn, stream) in enumerate(zip(painter.drawn, painter.images, strict=True)):
            kind, body, error = None, None, None
            try:
                if stream is None:
                    raise BadBook("a picture that isn't there")
                kind, body = picture(d, stream)
            except BadBook as e:
                error = str(e)
            yield {"n": n, **{k: drawn[k] for k in ("name", "top", "width", "height")}, "media_type": kind, "picture": body, "error": error}

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    d = Document(content)
                    for i, page in enumerate([] if d.encrypted() else d.pages()):
                        for r in list(of(painted(d, page), d)):  # all of a page or none
                            yield {"doc": path, "page": i, **r}, len(r["picture"] or b"")
                except BadBook:
                    continue

    return files.select("path", "content").mapInArrow(lambda batches: in_batches(read(batches), arrow), schema)
