import io
import itertools
import math
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from shelfspark.sources import epub, figures, screens
from tests.test_sources import make_epub


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows, step, pick):
    """Rows of bytes behind filters, each by its rule for one byte after the other."""
    out, above = b"", bytes(len(rows[0])) if rows else b""
    for row in rows:
        kind = pick.randrange(5)
        out += bytes([kind])
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out += bytes([(x - (0, a, b, (a + b) // 2, nearest)[kind]) % 256])
        above = row
    return out


def packed(levels, bits):
    text = "".join(f"{v:0{bits}b}" for pixel in levels for v in pixel)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def encoded(grid, colour, bits, interlaced, pick, more=b""):
    height, width = len(grid), len(grid[0])
    step = max(1, len(grid[0][0]) * bits // 8)
    body = b""
    for x, y, dx, dy in screens.PASSES if interlaced else [(0, 0, 1, 1)]:
        rows = [packed(row[x::dx], bits) for row in grid[y::dy] if row[x::dx]]
        body += filtered(rows, step, pick) if rows else b""
    data = zlib.compress(body)
    cut = len(data) // 2
    return screens.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced)) + more + chunk(b"IDAT", data[:cut]) + chunk(b"IDAT", data[cut:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,bits", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_every_form_of_png(colour, bits):
    pick = random.Random(colour * 100 + bits)
    palette = [tuple(pick.randrange(256) for _ in range(3)) for _ in range(1 << min(bits, 8))]
    for (width, height), interlaced, clear in itertools.product([(1, 1), (3, 2), (9, 11), (17, 5)], (0, 1), (False, True)):
        grid = [[tuple(pick.randrange(1 << bits) for _ in range(screens.CHANNELS[colour])) for _ in range(width)] for _ in range(height)]
        more, full = b"", 1 if bits == 16 else 255 // ((1 << bits) - 1)
        want = [[tuple(v * full for v in p) for p in row] for row in grid]
        if colour == 3:
            more, want = chunk(b"PLTE", bytes(itertools.chain(*palette))), [[palette[p[0]] for p in row] for row in grid]
        if clear and colour == 3:
            more += chunk(b"tRNS", bytes([7, 200]))
            want = [[(*w, {0: 7, 1: 200}.get(p[0], 255)) for w, p in zip(a, b)] for a, b in zip(want, grid)]
        elif clear and colour in (0, 2):
            more = chunk(b"tRNS", struct.pack(f">{len(grid[0][0])}H", *grid[0][0]))
            want = [[(*w, 0 if p == grid[0][0] else 65535 if bits == 16 else 255) for w, p in zip(a, b)] for a, b in zip(want, grid)]
        got = screens.decoded(encoded(grid, colour, bits, interlaced, pick, more))
        assert got.tolist() == [[list(p) for p in row] for row in want]
        assert screens.decoded(figures.png(got)).tolist() == got.tolist()


def shrunk(values, n):
    """Lanczos with three lobes, a sum for each new sample."""
    scale, out = len(values) / n, []
    for i in range(n):
        centre, total, weight = (i + 0.5) * scale, 0.0, 0.0
        for k in range(max(0, math.floor(centre - 3 * scale)), min(len(values), math.ceil(centre + 3 * scale))):
            x = math.pi * (k - centre + 0.5) / scale
            w = 0 if abs(x) >= 3 * math.pi else 1 if x == 0 else math.sin(x) / x * math.sin(x / 3) / (x / 3)
            total, weight = total + w * values[k], weight + w
        out.append(total / weight)
    return out


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_pictures_fit_the_screen(channels):
    levels = np.random.default_rng(channels).integers(0, 256, (37, 53, channels)).astype(np.uint8)
    got = screens.fitted(levels, 20, 30)
    assert got.shape == (14, 20, channels)
    for c in range(channels):
        columns = [shrunk(levels[:, x, c].tolist(), 14) for x in range(53)]
        rows = [shrunk([column[y] for column in columns], 20) for y in range(14)]
        assert np.abs(np.clip(np.array(rows), 0, 255) - got[..., c]).max() <= 0.501
    assert screens.fitted(levels, 53, 37) is levels and screens.fitted(levels, 100, 1).shape[:2] == (1, 1)
    rgb = screens.gray(levels)
    assert rgb.shape[-1] == (channels if channels < 3 else channels - 2)
    if channels > 2:
        assert rgb[3, 4, 0] == (2126 * int(levels[3, 4, 0]) + 7152 * int(levels[3, 4, 1]) + 722 * int(levels[3, 4, 2])) // 10000


def test_copies_for_a_device(spark):
    wide = figures.png(np.full((4, 1000, 3), 90, np.uint8))
    moving = wide[:33] + chunk(b"acTL", bytes(8)) + wide[33:]
    put = lambda **more: epub.rewritten(make_epub(), {}, {k.replace("_", "."): v for k, v in more.items()})
    good = put(w_png=wide, m_png=moving, j_jpg=screens.JPEG + b"x", empty_png=b"")
    books = {"good": good, "plain": make_epub(), "cut": put(w_png=wide[:60]), "huge": put(w_png=encoded([[(0,)]], 0, 8, 0, random.Random(1)).replace(struct.pack(">II", 1, 1), struct.pack(">II", 9000, 9000))), "none": b"", "null": None}
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in books.items()], "path string, content binary")
    got = {r.path: r for r in screens.device_copies(rows, "X3").collect()}
    assert (got["good"].pictures, got["good"].left, got["good"].error) == (1, 1, None)
    made = zipfile.ZipFile(io.BytesIO(bytes(got["good"].content)))
    assert screens.decoded(made.read("w.png")).tolist() == [[[90]] * 528] * 2 and made.read("m.png") == moving and epub.is_device_copy(bytes(got["good"].content))
    assert bytes(got["plain"].content) == books["plain"] and got["plain"].pictures == 0
    assert all(got[k].content is None and got[k].error for k in ("cut", "huge", "none", "null"))
    assert screens.device_copy(bytes(got["good"].content), "X3") == (bytes(got["good"].content), 0, 0)
    again, pictures, _ = screens.device_copy(bytes(got["good"].content), "EEGO A4")
    assert pictures == 1 and zipfile.ZipFile(io.BytesIO(again)).read(epub.DEVICE_MARKER).startswith(b"crosspoint-images-v1:552x768")
    assert screens.device_copies(rows.limit(0), "X4").count() == 0
