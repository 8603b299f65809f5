"""Operator 2: media columns in FLAC, 8-bit mono.

encode() stores the bytes of a column losslessly as FLAC streams: fixed or linear predictors, whichever is
smallest for a frame, Rice-coded residuals, a seek point for every frame. decode() reads the streams back: it
verifies the checksums of frame headers and frames and the MD5 of the samples, and gives the PCM and the sample offset
at which each block begins; seek() decodes only the frames that hold the samples asked for.

Both work on many frames side by side, one numpy operation for the n-th symbol of all of them, so that the cost
for a sample is some tens of nanoseconds although Rice codes can only be read one after the other. Predictor
coefficients come from whole-number correlations by element-wise arithmetic, so that a stream depends on its own bytes only.

Defined results: a null payload has a null stream; an empty one is a stream without frames. What is not an
8-bit mono FLAC stream, or fails a checksum, raises ValueError. payload() pads a text with bytes 0 to a positive
multiple of 64, a null text like an empty one. An empty table gives no rows. Very long payloads are cut into frames and stored whole. Equal
rows repeat with equal streams. A column of the table that is named like a result (media; pcm, block_offsets, feature) gives way to it.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import bytes_of, documents, text_or_empty, with_arrow

BLOCK, RATE, PRECISION, LPC_ORDER, UNIT = 1024, 8000, 10, 4, 64
#: Bytes whose frames are worked on side by side.
SLICE = 2 << 20


def _table(poly: int, width: int) -> np.ndarray:
    out = []
    for byte in range(256):
        crc = byte << (width - 8)
        for _ in range(8):
            crc = (crc << 1) ^ (poly if crc >> (width - 1) else 0)
            crc &= (1 << width) - 1
        out.append(crc)
    return np.array(out, np.uint32)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def crc16_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.zeros(len(order), np.uint32)
    counts = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")
    for i, n in enumerate(counts):
        c = crc[:n]
        crc[:n] = ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ data[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@lru_cache(65536)
def _header(number: int, size: int) -> bytes:
    """Frame header of a fixed block size stream: 8 bits, mono, the rate of the stream."""
    if number < 0x80:
        coded = bytes([number])
    else:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
        coded = bytes([(0xFF00 >> n) & 0xFF | number >> (6 * (n - 1))])
        coded += bytes(0x80 | (number >> (6 * i)) & 0x3F for i in range(n - 2, -1, -1))
    full = size == BLOCK
    out = bytes([0xFF, 0xF8, (BLOCK.bit_length() - 1) << 4 if full else 0x70, 0x02]) + coded
    if not full:
        out += (size - 1).to_bytes(2, "big")
    return out + bytes([_crc8(out)])


def _levinson(r: np.ndarray) -> np.ndarray:
    """Predictor coefficients of LPC_ORDER for each row of correlations r[:, 0..LPC_ORDER]."""
    n, order = len(r), LPC_ORDER
    a = np.zeros((n, order))
    err = r[:, 0].astype(np.float64) + 1e-9
    for i in range(order):
        acc = r[:, i + 1].astype(np.float64)
        for j in range(i):
            acc = acc - a[:, j] * r[:, i - j]
        k = acc / err
        old = a[:, :i].copy()
        for j in range(i):
            a[:, j] = old[:, j] - k * old[:, i - 1 - j]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    return a


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parameter for each row and about how many bits it takes."""
    n = u.shape[1]
    total = u.sum(1, dtype=np.int64)
    mean = total // n
    k = np.zeros(len(u), np.int64)
    while (over := (mean >> k) > 1).any():
        k += over
    k = np.minimum(k, 14)
    return k, n * (k + 1) + (total >> k)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _plan(s: np.ndarray) -> dict:
    """For frames of one size: subframe kind, order, coefficients, residuals and bits."""
    n, size = s.shape
    best = np.full(n, 8 * size, np.int64)
    kind, order, rice = np.full(n, 1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    u = np.zeros(s.shape, np.int32)
    d = s
    for p in range(min(5, size)):
        if p:
            d = np.diff(d, axis=1)
        z = _zigzag(d)
        k, cost = _rice(z)
        cost = cost + 8 * p + 10
        better = cost < best
        best[better], kind[better], order[better], rice[better] = cost[better], 8 + p, p, k[better]
        u[better, p:] = z[better]
    shift, coefs = np.zeros(n, np.int64), np.zeros((n, LPC_ORDER), np.int64)
    if size > 4 * LPC_ORDER:
        wide = s.astype(np.int64)
        r = np.stack([np.einsum("ij,ij->i", wide[:, : size - i], wide[:, i:]) for i in range(LPC_ORDER + 1)], axis=1)
        a = _levinson(r)
        most = np.abs(a).max(1)
        sh = np.full(n, PRECISION - 1)
        for _ in range(PRECISION - 1):
            sh -= most * np.exp2(sh) >= (1 << (PRECISION - 1)) - 1
        sh = np.maximum(sh, 0)
        limit = 1 << (PRECISION - 1)
        q = np.clip(np.floor(a * np.exp2(sh)[:, None] + 0.5), -limit, limit - 1).astype(np.int32)
        guess = np.zeros((n, size - LPC_ORDER), np.int32)
        for j in range(LPC_ORDER):
            guess += q[:, j : j + 1] * s[:, LPC_ORDER - 1 - j : size - 1 - j]
        z = _zigzag(s[:, LPC_ORDER:] - (guess >> sh[:, None].astype(np.int32)))
        k, cost = _rice(z)
        cost = cost + 8 * LPC_ORDER + 19 + PRECISION * LPC_ORDER
        better = cost < best
        best[better], kind[better], order[better], rice[better] = cost[better], 31 + LPC_ORDER, LPC_ORDER, k[better]
        shift[better], coefs[better] = sh[better], q[better]
        u[better] = 0
        u[better, LPC_ORDER:] = z[better]
    same = (s == s[:, :1]).all(1)
    kind[same], order[same] = 0, 0
    coded = kind >= 8
    column = np.arange(size)[None, :]
    lengths = np.where(coded[:, None] & (column >= order[:, None]), (u >> rice[:, None].astype(np.int32)) + 1 + rice[:, None], 0).astype(np.int32)
    head = np.select([kind == 0, kind == 1, kind >= 32], [np.full(n, 16), np.full(n, 8 + 8 * size), 8 + 8 * order + 9 + PRECISION * order + 10], 8 + 8 * order + 10)
    return {"s": s, "u": u, "kind": kind, "order": order, "rice": rice, "shift": shift, "coefs": coefs, "lengths": lengths, "head": head, "bits": head + lengths.sum(1)}


def _write(bits: np.ndarray, at: np.ndarray, p: dict) -> None:
    """Write the subframes of a plan at their bit positions."""
    s, kind, order, rice = p["s"], p["kind"], p["order"], p["rice"]
    size = s.shape[1]
    _put(bits, at, kind << 1, 8)
    raw = s & 0xFF
    one = np.flatnonzero(kind == 0)
    _put(bits, at[one] + 8, raw[one, 0], 8)
    verbatim = np.flatnonzero(kind == 1)
    if len(verbatim):
        _put(bits, (at[verbatim, None] + 8 + 8 * np.arange(size)).ravel(), raw[verbatim].ravel(), 8)
    for o in range(1, 5):
        rows = np.flatnonzero((kind >= 8) & (order == o))
        for j in range(o if len(rows) else 0):
            _put(bits, at[rows] + 8 + 8 * j, raw[rows, j], 8)
    lpc = np.flatnonzero(kind >= 32)
    if len(lpc):
        to = at[lpc] + 8 + 8 * order[lpc]
        _put(bits, to, np.full(len(lpc), PRECISION - 1), 4)
        _put(bits, to + 4, p["shift"][lpc], 5)
        for j in range(LPC_ORDER):
            _put(bits, to + 9 + PRECISION * j, p["coefs"][lpc, j] & ((1 << PRECISION) - 1), PRECISION)
    coded = np.flatnonzero(kind >= 8)
    if not len(coded):
        return
    _put(bits, at[coded] + p["head"][coded] - 4, rice[coded], 4)  # method 0 and partition order 0 are zeros
    lengths = p["lengths"][coded]
    begin = (at[coded] + p["head"][coded])[:, None] + np.cumsum(lengths, axis=1) - lengths
    there = np.arange(size)[None, :] >= order[coded][:, None]
    u = p["u"][coded][there]
    k = np.broadcast_to(rice[coded][:, None].astype(np.int32), lengths.shape)[there]
    begin = begin[there] + (u >> k)
    bits[begin] = 1
    for j in range(int(k.max(initial=0))):  # j-th of the low bits, counted from the last
        low = np.flatnonzero(k > j)
        bits[begin[low] + k[low] - j] = (u[low] >> j) & 1


def encode_many(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for each range of raw."""
    sizes = np.diff(offsets)
    counts = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    number = np.arange(len(doc)) - first[doc]
    start = offsets[:-1][doc] + number * BLOCK
    length = np.minimum(BLOCK, sizes[doc] - number * BLOCK)
    samples = raw.astype(np.int32) - 128
    headers = [_header(a, b) for a, b in zip(number.tolist(), length.tolist(), strict=True)]
    head_bytes = np.fromiter(map(len, headers), np.int64, len(headers))
    groups, bits = [], np.zeros(len(doc), np.int64)
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        plan = _plan(samples[start[rows, None] + np.arange(size)])
        bits[rows] = plan["bits"]
        groups.append((rows, plan))
    frame_bytes = head_bytes + (bits + 7) // 8 + 2
    ends = np.cumsum(frame_bytes)
    begins = ends - frame_bytes
    stream = np.zeros(int(ends[-1]) * 8 if len(ends) else 0, np.uint8)
    for rows, plan in groups:
        _write(stream, (begins[rows] + head_bytes[rows]) * 8, plan)
    packed = np.packbits(stream)
    del stream
    for at, h in zip(begins.tolist(), headers, strict=True):
        packed[at : at + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16_many(packed, begins, frame_bytes - 2)
    packed[ends - 2], packed[ends - 1] = crc >> 8, crc & 0xFF
    out = []
    for i, size in enumerate(sizes.tolist()):
        a, b = int(first[i]), int(first[i] + counts[i])
        own = frame_bytes[a:b]
        least, most = (int(own.min()), int(own.max())) if b > a else (0, 0)
        md5 = hashlib.md5((raw[offsets[i] : offsets[i + 1]] ^ 0x80).tobytes()).digest()
        info = BLOCK.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big") + (RATE << 44 | 7 << 36 | size).to_bytes(8, "big") + md5
        points = np.zeros(b - a, [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        if b > a:
            points["sample"], points["byte"], points["n"] = number[a:b] * BLOCK, begins[a:b] - begins[a], length[a:b]
        seek = points.tobytes()
        frames = packed[begins[a] : ends[b - 1]].tobytes() if b > a else b""
        out.append(b"fLaC\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frames)
    return out


def _metadata(m: bytes) -> tuple[int, int, bytes, np.ndarray]:
    """Where frames begin, the number of samples, their MD5 and the seek points."""
    if m[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points = 4, False, None, b"", np.zeros(0, [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
    while not last:
        last, kind, size = m[at] >> 7, m[at] & 0x7F, int.from_bytes(m[at + 1 : at + 4], "big")
        body = m[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 36 & 0xFF != 7:
                raise ValueError("not 8-bit mono")
            total, md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = np.frombuffer(body, points.dtype)
            points = points[points["sample"] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + size
    if total is None:
        raise ValueError("no stream information")
    return at, total, md5, points


def _frame_header(m: np.ndarray, at: int) -> tuple[int, int, int]:
    """Number, block size and length of the header."""
    h = m[at : at + 20].tobytes()
    if h[0] != 0xFF or h[1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should begin")
    if h[3] & 0xF0 or h[3] >> 1 & 7 not in (0, 1):
        raise ValueError("not 8-bit mono")
    n = 1 if h[4] < 0x80 else 8 - (h[4] ^ 0xFF).bit_length()
    number = h[4] if n == 1 else h[4] & (0x7F >> n)
    for b in h[5 : 4 + n]:
        number = number << 6 | b & 0x3F
    code, at_end = h[2] >> 4, 4 + n
    if code == 6:
        size, at_end = h[at_end] + 1, at_end + 1
    elif code == 7:
        size, at_end = int.from_bytes(h[at_end : at_end + 2], "big") + 1, at_end + 2
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    at_end += {12: 1, 13: 2, 14: 2}.get(h[2] & 15, 0)
    if _crc8_cached(h[: at_end]) != h[at_end]:
        raise ValueError("frame header checksum")
    return number, size, at_end + 1


_crc8_cached = lru_cache(65536)(_crc8)


class _Bits:
    """Reads of up to 57 bits at many positions at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(data) + 8
        self.words = np.zeros(n, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + n] << np.uint64(56 - 8 * j)

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.window(at) >> np.uint64(64 - n)).astype(np.int64)

    def signed(self, at: np.ndarray, n: int) -> np.ndarray:
        v = self.read(at, n)
        return v - ((v >> (n - 1)) << n)


def _residuals(bits: _Bits, at: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice-coded residuals of many subframes, symbol by symbol in all of them. Rows begin at column order."""
    lanes = np.argsort(-(size - order), kind="stable")
    pos, size, order = at[lanes].copy(), size[lanes], order[lanes]
    method, depth = bits.read(pos, 2), bits.read(pos + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    pos += 6
    each = size >> depth
    left = each - order
    width = 4 + method
    k = np.zeros(len(pos), np.int64)
    raw = np.full(len(pos), -1, np.int64)
    counts = size - order
    out = np.zeros((int(size.max(initial=0)), len(pos)), np.int64)  # column by column
    active = np.searchsorted(-counts, -np.arange(1, int(counts.max(initial=0)) + 1), side="right")
    fresh = np.ones(len(pos), bool)
    whole = bool((depth == 0).all())
    one = np.uint64(1)
    row = np.arange(len(pos))
    for i, n in enumerate(active.tolist()):
        if i == 0 or not whole:
            while (new := np.flatnonzero(fresh[:n])).size:
                is5 = width[new] == 5
                k[new] = np.where(is5, bits.read(pos[new], 5), bits.read(pos[new], 4))
                pos[new] += width[new]
                escape = new[k[new] == (1 << width[new]) - 1]
                raw[new] = -1
                raw[escape] = bits.read(pos[escape], 5)
                pos[escape] += 5
                fresh[new] = False
                empty = new[left[new] == 0]  # a first partition that is all warm-up
                fresh[empty], left[empty] = True, each[empty]
            some_raw = bool((raw[:n] >= 0).any())
        p = pos[:n]
        w = bits.window(p)
        top = (w >> np.uint64(32)).astype(np.float64)
        q = 1054 - (top.view(np.int64) >> 52)  # leading zeros of the upper 32 bits
        low = k[:n]
        value = (q << low) | ((((w << (q & 63).astype(np.uint64)) << one) >> one) >> (63 - low).astype(np.uint64)).astype(np.int64)
        step = q + 1 + low
        if int(step.max(initial=0)) > 57 or (top == 0).any():
            for j in np.flatnonzero((step > 57) | (top == 0)).tolist():
                zeros, start = 0, int(pos[j])
                while not (word := int(bits.read(np.array([start + zeros]), 32)[0])):
                    zeros += 32
                zeros += 32 - word.bit_length()
                rest = int(bits.read(np.array([start + zeros + 1]), int(low[j]))[0]) if low[j] else 0
                value[j], step[j] = zeros << int(low[j]) | rest, zeros + 1 + int(low[j])
        signed = (value >> 1) ^ -(value & 1)
        if some_raw:
            for j in np.flatnonzero(raw[:n] >= 0).tolist():
                b = int(raw[j])
                signed[j] = int(bits.signed(np.array([pos[j]]), b)[0]) if b else 0
                step[j] = b
        pos[:n] += step
        out[order[:n] + i, row[:n]] = signed
        if not whole:
            left[:n] -= 1
            done = np.flatnonzero(left[:n] == 0)
            done = done[counts[done] > i + 1]
            fresh[done], left[done] = True, each[done]
    back = np.empty(len(lanes), np.int64)
    back[lanes] = row
    return out[:, back], pos[back]


def _subframes(bits: _Bits, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (column of the result for each subframe) and the bit behind each."""
    head = bits.read(at, 8)
    if (head & 0x81).any():
        raise ValueError("unsupported subframe")
    kind = head >> 1
    if (((kind > 1) & (kind < 8)) | ((kind > 12) & (kind < 32))).any():
        raise ValueError("reserved subframe")
    at = at + 8
    out = np.zeros((int(size.max(initial=0)), len(at)), np.int64)
    ends = at.copy()
    one = np.flatnonzero(kind == 0)
    out[:, one] = bits.signed(at[one], 8)[None, :]
    ends[one] += 8
    for i in np.flatnonzero(kind == 1).tolist():
        n = int(size[i])
        out[:n, i] = bits.signed(at[i] + 8 * np.arange(n), 8)
        ends[i] += 8 * n
    coded = np.flatnonzero(kind >= 8)
    if not len(coded):
        return out, ends
    order = np.where(kind >= 32, kind - 31, kind - 8)
    for j in range(int(order[coded].max())):
        has = coded[order[coded] > j]
        out[j, has] = bits.signed(at[has] + 8 * j, 8)
    pos = at + 8 * order
    lpc = coded[kind[coded] >= 32]
    coefs, shift = np.zeros((32, len(at)), np.int64), np.zeros(len(at), np.int64)
    if len(lpc):
        precision = bits.read(pos[lpc], 4) + 1
        shift[lpc] = bits.signed(pos[lpc] + 4, 5)
        if (precision == 16).any() or (shift[lpc] < 0).any():
            raise ValueError("invalid predictor")
        pos[lpc] += 9
        for j in range(int(order[lpc].max())):
            for b in np.unique(precision).tolist():
                has = lpc[(order[lpc] > j) & (precision == b)]
                coefs[j, has] = bits.signed(pos[has] + j * b, int(b))
        pos[lpc] += precision * order[lpc]
    residual, end = _residuals(bits, pos[coded], size[coded], order[coded])
    ends[coded] = end
    for o in range(5):
        own = np.flatnonzero((kind[coded] < 32) & (order[coded] == o))
        if not len(own):
            continue
        warm, now = out[:o, coded[own]], residual[o:, own]
        for j in range(o - 1, -1, -1):
            now = np.cumsum(np.concatenate([np.diff(warm[: j + 1], n=j, axis=0)[:1], now]), axis=0)
        out[: len(now), coded[own]] = now
    for o in np.unique(order[lpc]).tolist():
        own = np.flatnonzero((kind[coded] >= 32) & (order[coded] == o))
        x = np.concatenate([out[:o, coded[own]], residual[o:, own]])
        c, sh = coefs[:o, coded[own]][::-1], shift[coded[own]]
        for i in range(o, len(x)):
            x[i] += (c * x[i - o : i]).sum(0) >> sh
        out[: len(x), coded[own]] = x
    return out, ends


def decode_many(streams: list[bytes], ranges: list[tuple[int, int]] | None = None) -> list[tuple[bytes, list[int]]]:
    """PCM as unsigned bytes and the sample offset of each of its blocks, for each stream; only the blocks that hold range, if given."""
    metas = [_metadata(m) for m in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    cursors: list[list[int]] = []  # stream, byte, end, sample
    for i, (at, total, _, points) in enumerate(metas):
        begin, end = int(base[i] + at), int(base[i + 1])
        if not total:
            continue
        starts = [(int(p["sample"]), begin + int(p["byte"])) for p in points] if len(points) < 2 else list(zip(points["sample"].tolist(), (points["byte"].astype(np.int64) + begin).tolist(), strict=True))
        if not starts or starts[0][0]:
            starts = [(0, begin), *starts]
        for (sample, byte), (until, stop) in zip(starts, [*starts[1:], (total, end)], strict=True):
            if ranges is None or (sample < ranges[i][1] and until > ranges[i][0]):
                cursors.append([i, byte, stop, sample])
    bits = _Bits(data)
    blocks: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    while cursors:
        heads = [_frame_header(data, c[1]) for c in cursors]
        begin = np.array([c[1] for c in cursors], np.int64)
        size = np.array([h[1] for h in heads], np.int64)
        samples, ends = _subframes(bits, (begin + [h[2] for h in heads]) * 8, size)
        last = (ends + 7) // 8
        crc = crc16_many(data, begin, last - begin)
        if (crc != (data[last].astype(np.uint32) << 8 | data[last + 1])).any():
            raise ValueError("frame checksum")
        pcm = np.ascontiguousarray((samples + 128).astype(np.uint8).T)
        for j, c in enumerate(cursors):
            blocks[c[0]].append((c[3], pcm[j, : size[j]]))
        # Where seek points are further apart than frames, the next frame follows.
        cursors = [[c[0], int(last[j]) + 2, c[2], c[3] + int(size[j])] for j, c in enumerate(cursors) if int(last[j]) + 2 < c[2]]
    out = []
    for i, own in enumerate(blocks):
        own.sort(key=lambda x: x[0])
        pcm = np.concatenate([x[1] for x in own]) if own else np.zeros(0, np.uint8)
        if ranges is None:
            if len(pcm) != metas[i][1] or any(metas[i][2]) and hashlib.md5((pcm ^ 0x80).tobytes()).digest() != metas[i][2]:
                raise ValueError("samples do not agree with the stream's checksum")
        out.append((pcm.tobytes(), [x[0] for x in own]))
    return out


def describe(pcm: np.ndarray, blocks: int) -> str:
    """A few whole-number features of a signal: samples, blocks, peak, energy, sign changes, steepness."""
    x = pcm.astype(np.int64) - 128
    if not len(x):
        return "0,0,0,0,0,0"
    return ",".join(map(str, (len(x), blocks, int(np.abs(x).max()), int((x * x).sum()), int(((x[1:] < 0) != (x[:-1] < 0)).sum()), int(np.abs(np.diff(x)).sum()))))


def payload(text: str = "text") -> Column:
    """UTF-8 bytes padded with bytes 0 to a positive multiple of UNIT."""
    raw = F.encode(text_or_empty(text), "UTF-8")
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    zeros = F.unhex(F.lit("00" * UNIT))
    return F.concat(raw, F.substring(zeros, F.lit(1), pad))


def encode(df: DataFrame, column: str = "payload", into: str = "media", keep: list[str] | None = None) -> DataFrame:
    def make():
        def compute(batch: pa.RecordBatch):
            null = batch.column(column).is_null().to_pylist()
            made = encode_many(*bytes_of(batch, column))
            return [pa.array([None if n else m for n, m in zip(null, made, strict=True)], pa.binary())]

        return compute

    return with_arrow(df, column, [T.StructField(into, T.BinaryType())], make, keep, SLICE)


def decode(df: DataFrame, column: str = "media", pcm: str = "pcm", offsets: str = "block_offsets", feature: str = "feature", keep: list[str] | None = None) -> DataFrame:
    """Add the PCM, the sample offset of each block in it (block i is offsets[i] to offsets[i + 1]) and the features."""
    fields = [T.StructField(pcm, T.BinaryType()), T.StructField(offsets, T.ArrayType(T.LongType())), T.StructField(feature, T.StringType())]

    def make():
        def compute(batch: pa.RecordBatch):
            rows = batch.column(column).to_pylist()
            made = iter(decode_many([r for r in rows if r is not None]))
            out = [None if r is None else next(made) for r in rows]
            return [
                pa.array([o and o[0] for o in out], pa.binary()),
                pa.array([o and o[1] for o in out], pa.list_(pa.int64())),
                pa.array([o and describe(np.frombuffer(o[0], np.uint8), len(o[1])) for o in out], pa.string()),
            ]

        return compute

    return with_arrow(df, column, fields, make, keep, SLICE)


def seek(media: bytes, sample: int, n: int) -> bytes:
    """n samples from one on, decoding only the frames that hold them."""
    ((pcm, starts),) = decode_many([media], [(sample, sample + n)])
    return pcm[sample - starts[0] :][:n] if starts else b""


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), payload().alias("payload"))
    read = decode(encode(docs, keep=["doc_id", "n_bytes"]))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {"op2_flac": op2_flac}
ORACLE: dict[str, str] = {}
