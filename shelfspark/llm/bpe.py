"""Operator 1: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over characters finds every
token of the vocabulary in a piece in one scan. Encoding goes from left to right and takes the
longest token at each place; where the last two tokens are not what the merges make of their own
bytes, it falls back to the next shorter token, and without one it takes the last token back.
A place that was given up is never entered again, which makes the work linear in the piece.
Whether two tokens may stand side by side is found once by their merges and remembered.

Defined results: a null or empty text has no ids; decoding null ids or an id that the
vocabulary lacks gives null; an empty table gives no rows. Very long texts are encoded whole, in linear time and memory. Rows repeat as they
come, equal texts with equal ids; a column of the table that is named like a result (ids, decoded) gives way to it.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import documents, texts_of, with_arrow

#: Entries that a memory of pieces or of token pairs holds before it starts anew.
PIECES, PAIRS = 300_000, 400_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 of the token's bytes and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, array] = {}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        made = {t for t, r in ranks.items() if self.halve(t, r)}  # others never come out of merges
        self.automaton = ahocorasick.Automaton()
        top = max(self.bytes_of) + 1
        self.shorter = [-1] * top
        self.size = [len(self.bytes_of.get(r, b"")) for r in range(top)]
        for t in made:
            self.automaton.add_word(t.decode("latin-1"), (ranks[t], len(t) - 1))
            self.shorter[ranks[t]] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), -1)
        self.automaton.make_automaton()

    def halve(self, token: bytes, rank: int) -> bool:
        """Plain merges of a token's bytes, lowest rank first and leftmost among equals; notes the last one."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            low, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if low == 1 << 40:
                return False
            if len(parts) == 2:
                self.halves[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def fits(self, a: int, b: int) -> bool:
        """Whether merges leave tokens a and b side by side.

        Undoes the merges of both, latest first. At each moment one token of a ends at the border and
        one of b begins there; had their own merge come before the one just undone, it would have won.
        """
        key, before = a << 20 | b, 1 << 40
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and joint < before:
                fit = False
                break
            of_a, of_b = self.halves.get(a), self.halves.get(b)
            if of_a is None and of_b is None:
                fit = True
                break
            if of_b is None or of_a is not None and a > b:
                before, a = a, of_a[1]
            else:
                before, b = b + 1, of_b[0]  # at the same rank, the border is further left than b's merge
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = fit
        return fit

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest = [0] * len(data)
        for end, (rank, n) in self.automaton.iter(data.decode("latin-1")):
            longest[end - n] = rank  # ends only grow: the last to be set is the longest
        known, size, shorter, fits = self.pairs, self.size, self.shorter, self.fits
        all_of = len(data)
        out: list[int] = []
        given_up = None
        at, last, token = 0, -1, longest[0]
        while True:
            end = at + size[token]
            if given_up is None or not given_up[end]:
                if last < 0:
                    fit = True
                else:
                    fit = known.get(last << 20 | token)
                    if fit is None:
                        fit = fits(last, token)
                if fit:
                    out.append(token)
                    if end == all_of:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token_shorter = shorter[token]
            if token_shorter >= 0:
                token = token_shorter
                continue
            if given_up is None:
                given_up = bytearray(all_of + 1)
            given_up[at] = 1
            token = out.pop()
            at -= size[token]
            last = out[-1] if out else -1

    def forget(self) -> None:
        self.pieces.clear()
        self.pairs.clear()

    def encode(self, text: str | None) -> array:
        out = array("i")
        known = self.pieces
        for piece in self.find(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = array("i", self.piece(piece.encode()))
                if len(piece) <= 40:
                    if len(known) >= PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids  # extends in place
        return out


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    """One for each Python worker, whichever tasks it runs."""
    key = hash(raw), pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(raw), pattern)
    return _codecs[key]


_tables: dict[int, list[bytes | None]] = {}


def _table(raw: bytes) -> list[bytes | None]:
    """The bytes of each id, for each Python worker once."""
    if hash(raw) not in _tables:
        by = {r: t for t, r in read_ranks(raw).items()}
        _tables.clear()
        _tables[hash(raw)] = [by.get(r) for r in range(max(by) + 1)]
    return _tables[hash(raw)]


def joined(ids: np.ndarray, table: list[bytes | None]) -> bytes | None:
    if len(ids) and (ids.min() < 0 or ids.max() >= len(table)):
        return None
    try:
        return b"".join(map(table.__getitem__, ids.tolist()))
    except TypeError:  # a gap in the vocabulary
        return None


def _vocabulary(spark: SparkSession, path: str):
    """The rank file, read where the driver runs and sent once to each executor; a vocabulary is at most some MB."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 32 << 20:
        raise ValueError("a rank file of over 32 MB is not sent to the executors")
    return spark.sparkContext.broadcast(raw)


_IDS = T.ArrayType(T.IntegerType(), True)


def _encoded(texts: list[str | None], codec: Codec) -> pa.ListArray:
    flat, ends = array("i"), [0]
    for t in texts:
        flat += codec.encode(t)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))


def _decoded(rows: pa.ListArray, table: list[bytes | None]) -> pa.Array:
    offsets, flat = rows.offsets.to_pylist(), rows.values.fill_null(-1).to_numpy(zero_copy_only=False)
    valid = rows.is_valid().to_pylist()
    return pa.array([joined(flat[a:b], table) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each whole text, each match of pattern encoded separately, without special tokens."""
    sent = _vocabulary(df.sparkSession, path)

    def make():
        codec = _codec(sent.value, pattern)
        compute = lambda batch: [_encoded(texts_of(batch, text), codec)]
        compute.close = codec.forget
        return compute

    return with_arrow(df, text, [T.StructField(into, _IDS)], make, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Add the bytes that the ids of each row stand for."""
    sent = _vocabulary(df.sparkSession, path)
    size = "__ids_size"  # batches are small enough: none of their text is cut

    def make():
        table = _table(sent.value)
        return lambda batch: [_decoded(batch.column(ids), table)]

    kept = [c for c in df.columns if keep is None or c in keep]
    out = with_arrow(df.withColumn(size, F.lit("")), size, [T.StructField(into, T.BinaryType())], make, [*kept, ids])
    return out.select(*dict.fromkeys([*kept, into]))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", into: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """encode() and decode() in one pass, which halves the Python workers and what goes to and from them."""
    sent = _vocabulary(df.sparkSession, path)

    def make():
        codec, table = _codec(sent.value, pattern), _table(sent.value)

        def compute(batch: pa.RecordBatch):
            made = _encoded(texts_of(batch, text), codec)
            return [made, _decoded(made, table)]

        compute.close = codec.forget
        return compute

    return with_arrow(df, text, [T.StructField(ids, _IDS), T.StructField(into, T.BinaryType())], make, keep)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return round_trip(docs.select("doc_id", "text"), path, pattern, keep=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe": op1_bpe}
ORACLE: dict[str, str] = {}
