"""Copies of books for a device: PNG pictures made to fit its screen, in gray, under their old names.

Pictures are read in all colour types, depths and orders of PNG. One that is larger than the screen shrinks by Lanczos weights of
three lobes, its sides in proportion; all become gray, with their transparency. Animated ones stay as they are, and so do JPEG
pictures, which are counted as left.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfspark.shipping import in_batches, ship
from shelfspark.sources import epub
from shelfspark.sources.epub import BadBook
from shelfspark.sources.figures import png, samples

PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"
#: Larger pictures are an error of their book: what a task holds for one is about 20 bytes a pixel and channel.
MOST_SIDE, MOST_PIXELS = 16384, 1 << 24
#: Samples that are weighed at once.
BLOCK = 1 << 20
# Screens as width, height and the mark that their copies carry.
SCREENS = {
    **dict.fromkeys(("X4", "X4 Pro", "X4 Classic", "Sticky", "Paper Mono", "Metalio", "Picco"), (480, 800, "xteink-x4-images-v1:480x800:gray:jpeg85")),
    "X3": (528, 792, "crosspoint-images-v1:528x792:gray:jpeg85"),
    **dict.fromkeys(("M5Paper", "M5Paper S3", "LilyGo T5"), (540, 960, "crosspoint-images-v1:540x960:gray:jpeg85")),
    "EEGO A4": (552, 768, "crosspoint-images-v1:552x768:gray:jpeg85"),
}
# Channels by colour type; first column and row of each pass of interlaced pictures, and the steps between them; the weights of red, green and blue.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
LUMA = np.array([2126, 7152, 722], np.int32)


def _by_diagonals(raw: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of pixels without their filters. A pixel needs those to its left, above, and above to its left, so all that lie on one diagonal are done at once."""
    height, width, step = raw.shape
    out = np.zeros((height + 1, width + 1, step), np.int16)
    out[0, 1:] = above
    for d in range(width + height - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        c, kind = d - r, kinds[r][:, None]
        a, b, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        by_a, by_b, by_corner = np.abs(b - corner), np.abs(a - corner), np.abs(a + b - 2 * corner)
        nearest = np.where((by_a <= by_b) & (by_a <= by_corner), a, np.where(by_b <= by_corner, b, corner))
        out[r + 1, c + 1] = raw[r, c] + np.where(kind == 3, (a + b) >> 1, nearest) & 255
    return out[1:, 1:].astype(np.uint8)


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from rows that begin with their filter; pixels of step bytes. Runs of averaging and nearest-of-three rows go by diagonals, others row by row."""
    kinds, height = raw[:, 0], raw.shape[0]
    if kinds.max(initial=0) > 4:
        raise BadBook("a filter that PNG hasn't got")
    if not kinds.any():
        return raw[:, 1:]
    out = raw[:, 1:].reshape(height, -1, step).copy()
    above = np.zeros(out.shape[1:], np.uint8)
    for hard, run in groupby(range(height), lambda y: kinds[y] > 2):
        rows = list(run)
        if hard:
            out[rows[0] : rows[-1] + 1] = _by_diagonals(out[rows[0] : rows[-1] + 1], kinds[rows], above)
        else:
            for y in rows:
                if kinds[y] == 1:
                    np.add.accumulate(out[y], axis=0, dtype=np.uint8, out=out[y])
                elif kinds[y] == 2:
                    out[y] += out[y - 1] if y else above
        above = out[rows[-1]]
    return out.reshape(height, -1)


def decoded(data: bytes) -> np.ndarray:
    """height x width x channels (gray, gray and alpha, RGB or RGBA) of a PNG, as bytes or, at 16 bits, as uint16."""
    at, body, palette, clear, head = 8, [], None, None, None
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        said = data[at + 8 : at + 8 + n]
        if kind == b"IHDR" and n == 13:
            head = struct.unpack(">IIBBBBB", said)
        elif kind == b"PLTE":
            palette = np.frombuffer(said[: n // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = said
        elif kind == b"IDAT":
            body.append(said)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise BadBook("a PNG without a head")
    width, height, bits, colour, _, _, interlaced = head
    n = CHANNELS.get(colour)
    if n is None or bits not in (1, 2, 4, 8, 16) or not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE and width * height <= MOST_PIXELS) or colour == 3 and palette is None:
        raise BadBook("a PNG of a form that is not read")
    step = max(1, n * bits // 8)
    passes = [p for p in PASSES if p[0] < width and p[1] < height] if interlaced else [(0, 0, 1, 1)]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    whole = sum(h * (1 + -(-w * n * bits // 8)) for w, h in sizes)
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), whole)
    except zlib.error as e:
        raise BadBook("a PNG that can't be read") from e
    if len(raw) < whole:
        raise BadBook("fewer samples than pixels")
    levels, start = np.zeros((height, width, n), np.uint16 if bits == 16 else np.uint8), 0
    for (x, y, dx, dy), (w, h) in zip(passes, sizes, strict=True):
        row = 1 + -(-w * n * bits // 8)
        rows = unfiltered(np.frombuffer(raw, np.uint8, h * row, start).reshape(h, row), step)
        levels[y::dy, x::dx] = rows.reshape(h, w, n) if bits == 8 else samples(rows.tobytes(), w, h, n, bits)
        start += h * row
    if colour == 3:
        full = np.zeros((256, 3), np.uint8)
        full[: len(palette)] = palette[:256]
        out = full[levels[..., 0]]
        if clear is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[:256]
            out = np.concatenate([out, alpha[levels[..., 0]][..., None]], axis=-1)
        return out
    most = 65535 if bits == 16 else 255
    full = levels if bits >= 8 else levels * levels.dtype.type(most // ((1 << bits) - 1))
    if clear is not None and colour in (0, 2) and len(clear) >= 2 * n:
        alpha = np.where((levels == np.frombuffer(clear, ">u2", n)).all(-1, keepdims=True), 0, most).astype(levels.dtype)
        return np.concatenate([full, alpha], axis=-1)
    return full


@lru_cache(maxsize=256)  # 24 bytes an old sample at most
def weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For n new samples of m old ones: the first old sample that each takes something of, and how much of that one and those behind it (n x as many as any takes)."""
    scale = m / n
    wide = max(scale, 1.0)
    centre = (np.arange(n) + 0.5) * scale
    taps = min(m, int(np.ceil(6 * wide)) + 2)
    first = np.clip(np.floor(centre - 3 * wide).astype(np.int64), 0, m - taps)
    k = first[:, None] + np.arange(taps)
    x = (k - (centre[:, None] - 0.5)) / wide
    there = (np.abs(x) < 3) & (k < np.ceil(centre[:, None] + 3 * wide)) & (k >= np.floor(centre[:, None] - 3 * wide))
    w = np.where(there, np.sinc(x) * np.sinc(x / 3), 0)
    return first, (w / w.sum(1, keepdims=True)).astype(np.float32)


def resampled(levels: np.ndarray, n: int) -> np.ndarray:
    """n samples along the first axis in place of those there."""
    if n == len(levels):
        return levels
    first, w = weights(n, len(levels))
    rows = np.ascontiguousarray(levels, np.float32).reshape(len(levels), -1)
    out, some = np.empty((n, rows.shape[1]), np.float32), max(1, BLOCK // (w.shape[1] * rows.shape[1]))
    for i in range(0, n, some):
        np.einsum("ntr,nt->nr", rows.take(first[i : i + some, None] + np.arange(w.shape[1]), axis=0), w[i : i + some], out=out[i : i + some])
    return out.reshape(n, *levels.shape[1:])


def fitted(levels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture no larger than the screen, and never larger than it was."""
    h, w = levels.shape[:2]
    if w <= width and h <= height:
        return levels
    share = min(width / w, height / h)
    w2, h2 = (max(1, int(np.floor(x * share + 0.5))) for x in (w, h))
    out = resampled(resampled(levels, h2).swapaxes(0, 1), w2).swapaxes(0, 1)
    return np.clip(np.floor(out + 0.5), 0, np.iinfo(levels.dtype).max).astype(levels.dtype)


def gray(levels: np.ndarray) -> np.ndarray:
    """One channel in place of three; transparency stays."""
    if levels.shape[-1] < 3:
        return levels
    one = (levels[..., :3].astype(np.int32) @ LUMA // 10000)[..., None].astype(levels.dtype)
    return np.concatenate([one, levels[..., 3:]], axis=-1)


def device_copy(data: bytes, device: str) -> tuple[bytes, int, int]:
    """The book for a device, how many pictures were made anew, and how many JPEG pictures stay; without a picture to make anew, the book itself."""
    width, height, mark = SCREENS[device]
    z = epub.inspect(data)
    names = z.namelist()
    if epub.DEVICE_MARKER in names and z.read(epub.DEVICE_MARKER) == mark.encode():
        return data, 0, 0
    made, left = {}, 0
    for name in names:
        body = z.read(name)
        if body.startswith(JPEG):
            left += 1
        elif body.startswith(PNG) and b"acTL" not in body:
            try:
                made[name] = png(gray(fitted(decoded(body), width, height)))
            except BadBook as e:
                raise BadBook(f"{name}: {e}") from e
    if not made:
        return data, 0, left
    out = epub.rewritten(z, made, {epub.DEVICE_MARKER: mark.encode()})
    epub.validate(out)
    return out, len(made), left


COPIES = "path string, content binary, pictures int, left int, error string"


def device_copies(files: DataFrame, device: str, original: bool = False) -> DataFrame:
    """Copies for a device of EPUB files (path, content); an error in place of the bytes of one that can't be made. With what each was made of, if asked: original."""
    ship(files.sparkSession)
    schema = T._parse_datatype_string(COPIES + ", original binary" * original)
    arrow = to_arrow_schema(schema)

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                row = {"path": path, "content": None, "pictures": None, "left": None, "error": None}
                try:
                    row["content"], row["pictures"], row["left"] = device_copy(content or b"", device)
                except BadBook as e:
                    row["error"] = str(e)
                if original:
                    row["original"] = content
                yield row, len(row["content"] or b"") + len(row.get("original") or b"")

    return files.select("path", "content").mapInArrow(lambda batches: in_batches(read(batches), arrow), schema)
