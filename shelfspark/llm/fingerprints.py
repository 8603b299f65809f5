"""Operator 11: MinHash fingerprints of texts, their likeness, and classes of near copies by bands of them.

A text's set is that of its five-word shingles (of all its words, where it has fewer), as 64-bit hashes. PERMUTATIONS
universal hash functions (a * x + b modulo 2**64, a odd) run over a set at once in numpy; of the least value of each, mixed, 16 bits
are kept. Two fingerprints are as alike as the share of values that they agree in, an estimate of the sets' Jaccard similarity with a
standard error of at most 0.045.

Classes of near copies (`classes`): texts with the same set are one row from the start; signatures are cut into BANDS bands of ROWS values, which an equi-join
in Spark (as hubs, so that no pairs within a band are made) turns into candidate groups, and the sets themselves decide, in blocks of bounded size.
A pair at a similarity of 0.8 shares a band with a probability of 0.99995.

Edited texts (`edited`): the last half of each text gives way to the beginning of the one behind it, in order of ids. The heads of ranges of
narrow rows are the cuts; texts go to their range by one exchange, sorted there and streamed, and the head of each range goes to the range before it as well, so that
every task has the successors of all its rows and holds two texts at a time besides a batch.

Defined results: a null text is an empty one. A text without words has the empty fingerprint "", which is like another empty one (1.0) and unlike any other (0.0). Null ids come last,
equal ids in order of their texts' hashes; rows equal in both are interchangeable. The only document is its own successor. An empty table gives no rows. Very long texts are
worked on whole, in steps of bounded size. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm import near, wordhash
from shelfspark.llm.common import SLICE_BYTES, bytes_of, documents, materialize, prepare, slices, text_or_empty, trimmed, with_arrow
from shelfspark.storage import discard

PERMUTATIONS, BANDS, ROWS = 128, 25, 5
STEP = 512  # shingles that all permutations run over at once

_random = np.random.Generator(np.random.PCG64(11))
_A = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> bytes:
    """PERMUTATIONS values of 16 bits, big-endian; nothing for an empty set."""
    if not len(shingles):
        return b""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), STEP):
        np.minimum(least, (_A[:, None] * shingles[None, i : i + STEP] + _B[:, None]).min(axis=1), out=least)
    return (wordhash.mix(least) >> np.uint64(48)).astype(">u2").tobytes()


def minhashes(texts: list[str]) -> list[bytes]:
    raw = [t.encode() for t in texts]
    return [minhash(s) for s in near.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))]


def likeness(a: bytes, b: bytes) -> float:
    """The share of values that two fingerprints agree in."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean())


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add fingerprint, as binary."""

    def make():
        return lambda batch: [pa.array([minhash(s) for s in near.shingle_sets(*bytes_of(batch, text))], pa.binary())]

    return with_arrow(df, text, [T.StructField("fingerprint", T.BinaryType())], make, keep)


def spelled(fingerprint: bytes) -> str:
    return base64.b64encode(fingerprint).decode()


# -- edited texts


def _sortable(none: bool, id_: object, hash_: int) -> tuple:
    return none, () if none else (id_,), hash_


def with_successors(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, text and beyond: all rows of a range in one partition, in order, and behind them the first row of the next range with beyond = true."""
    rows = df.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
    rows = rows.select(F.col("id").isNull().alias("none"), "id", F.xxhash64("text").alias("hash"), "text")
    names = ["none", "id", "hash"]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.select(*names).repartitionByRange(ranges, *names)
    heads = narrow.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*names)).alias("head")).select("head.*").collect()  # a narrow row for each range
    cuts = sorted({_sortable(*r) for r in heads})
    if not cuts:
        return rows.select("id", "text", F.lit(False).alias("beyond"))

    @F.arrow_udf("bigint")
    def place(none: pa.Array, id_: pa.Array, hash_: pa.Array) -> pa.Array:
        """Twice the range of each row, and one more for its head."""
        out = []
        for k in map(_sortable, none.to_pylist(), id_.to_pylist(), hash_.to_pylist()):
            at = max(bisect_right(cuts, k) - 1, 0)
            out.append(2 * at + (cuts[at] == k))
        return pa.array(out, pa.int64())

    placed = rows.withColumn("place", place("none", "id", "hash"))
    own = F.struct(F.shiftright("place", 1).cast("int").alias("at"), F.lit(False).alias("beyond"))
    before = F.struct(F.pmod(F.shiftright("place", 1) - 1, F.lit(len(cuts))).cast("int").alias("at"), F.lit(True).alias("beyond"))
    dealt = placed.withColumn("to", F.explode(F.when(F.col("place") % 2 == 1, F.array(own, before)).otherwise(F.array(own)))).select(*names, "text", "to.at", "to.beyond")
    return dealt.repartitionById(len(cuts), "at").sortWithinPartitions("beyond", *names).select("id", "text", "beyond")


def edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    prepare(df.sparkSession)
    rows = with_successors(df, key, text)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row whose successor comes next: id, text, fingerprint
        ended = False
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                if ended:
                    break
                ids, texts, beyond = part.column("id"), part.column("text").to_pylist(), part.column("beyond").to_pylist()
                if True in beyond:  # one of the rows beyond is enough, and the last
                    ended = True
                    n = beyond.index(True) + 1
                    ids, texts = ids.slice(0, n), texts[:n]
                prints = minhashes(texts)
                done = pa.concat_arrays([*([] if last is None else [last[0]]), ids.slice(0, len(ids) - 1)])
                texts, prints = ([] if last is None else [last[1]]) + texts, ([] if last is None else [last[2]]) + prints
                changed = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:], strict=False)]
                new = minhashes(changed)
                last = ids.slice(len(ids) - 1), texts[-1], prints[-1]
                columns = [
                    [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in changed], [spelled(p) for p in prints[:-1]], [spelled(p) for p in new],
                    [likeness(p, q) for p, q in zip(prints, new, strict=False)], [likeness(p, q) for p, q in zip(prints, prints[1:], strict=False)],
                ]
                yield pa.RecordBatch.from_arrays([done, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", *names])

    kept = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(trimmed(run), f"id {kept}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", key)


# -- classes of near copies


def banded(reps: DataFrame) -> DataFrame:
    """(node, hub): the bands of each signature (node, signature), by number and values."""
    band = F.concat(F.unhex(F.lpad(F.hex("band"), 2, "0")), F.substring(F.col("signature"), F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    return reps.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select("node", band.alias("hub"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = near.THRESHOLD) -> DataFrame:
    """key, class_id (smallest key of the class that links of near copies join) and n_links (documents linked to this one, copies included) for each row."""
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def make():
        def compute(batch: pa.RecordBatch):
            sets = list(near.shingle_sets(*bytes_of(batch, "text")))
            return [pa.array([near.fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([minhash(s) or None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]

        return compute

    fields = [T.StructField("fp", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("n_grams", T.LongType())]
    signed = materialize(with_arrow(docs, "text", fields, make, ["id"]), "fingerprints")
    reps = materialize(near.representatives(signed, ["signature", "n_grams"]), "representatives")
    groups = near.components(banded(reps.select("node", "signature")))
    out = near.verified(docs, signed.select("id", "fp"), reps.drop("signature"), groups, threshold)
    discard(reps)
    return out.withColumnRenamed("id", key)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(documents(spark, sf_dir))


def minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


QUERIES = {"op11_minhash": op11_minhash, "minhash_classes": minhash_classes}
ORACLE: dict[str, str] = {}
