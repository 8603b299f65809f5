"""Operator 6: n-gram Jaccard join by a MinHash LSH forest with exact verification.

A document's set is that of its five-word shingles (of all its words, where it has fewer). Documents with the
same set are one class of copies, represented by the smallest id; what follows joins representatives.

Forest: each of TREES trees orders the representatives by a prefix trie of their MinHash values, as a sorted run of
keys. The descent starts at the longest matches: rows that agree in all DEPTH values of a tree are compared first and
united if alike, then rows that agree in one value less, and so on. A prefix whose rows are all one set already isn't
shortened any more, and rows that were compared under a longer one aren't compared again. Shortening ends at the
greatest length with which a pair at the threshold still meets in some tree with the target recall (depth_for), if the
recall measured on this very corpus reaches the target too; as long as it falls short, all prefixes lose one more
value. It is measured on PROBES documents, held exactly against all documents while those are signed: the share of
their similar pairs that the forest brought into one group.

Rows that meet are sifted by a one-bit sketch of the whole signature (far below the threshold, so that nothing similar
goes) and united, and the united sets of all trees make candidate groups. Only links between group members matter after that,
never pairs: each row of a tree says at most once or twice to which set it belongs. A prefix with more than BUCKET rows is
compared run by run and then in pairs of runs, in tasks of at most 2 * BUCKET rows, so that no two of its rows are left
out; two sets that meet there are named once.

Verification: members of a candidate group are dealt into blocks of about BLOCK_BYTES of sets, each pair of blocks is one small
task, which compares the sets themselves and returns a sum for each member and the verified sets within it. The work for a group of n
different texts is n * n by nature of the join (a count of links for each), but spread over bounded tasks.

Defined results: a document without words (null, empty, only white space) is linked to none and is its own class; an empty
table gives no rows. Rows with the same id and text count as copies. Ids of any type that sorts do, in its own order. A null id represents a class only if no other id does. Very long
texts are compared whole: a set of n words takes 8 * n bytes, the most that a task holds of one document. Only key and text are read, so
that other columns may have any names. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm import wordhash
from shelfspark.llm.common import bytes_of, documents, materialize, prepare, trimmed, with_arrow
from shelfspark.operators import resolve
from shelfspark.storage import discard

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 24, 7  # trees, and values that a tree's key has
#: A pair at the threshold agrees in 0.9 of the sketch's bits, give or take 0.023.
AGREE = 0.79
BLOCK, BLOCK_BYTES = 128, 1 << 20  # members of a group in a block, and bytes of their sets, both on average
BUCKET = 4096  # rows with a common prefix that are compared at once; more are taken in sorted runs of so many, and pairs of runs
HUBS = 16  # hubs that a large set is dealt over
PROBES, PROBE_BYTES = 256, 100_000  # documents that the recall is measured on, and the longest text among them
MOST_SENT = 64 << 20  # bytes that are broadcast at most

_random = np.random.Generator(np.random.PCG64(6))
_N = TREES * DEPTH
_A = _random.integers(0, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, _N, dtype=np.uint64)
_PLACE = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def depth_for(threshold: float, recall: float, trees: int = TREES) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with the recall."""
    depth = 1
    while depth < DEPTH and 1 - (1 - threshold ** (depth + 1)) ** trees >= recall:
        depth += 1
    return depth


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, ends, before = wordhash.words(raw, offsets)
    w = wordhash.hashes(raw, starts, ends)
    n = len(w) - SHINGLE + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for j in range(SHINGLE):
        if n > 0:
            grams += w[j : j + n] * _PLACE[j]
    grams = wordhash.mix(grams)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield wordhash.mix((w[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> bytes:
    return struct.pack(">QQ", int(np.add.reduce(wordhash.mix(s))), int(np.add.reduce(wordhash.mix(s ^ _SALT))) ^ len(s))


def signature(s: np.ndarray) -> tuple[bytes, bytes]:
    """TREES keys of DEPTH 16-bit values, one after the other, and a sketch of a bit for each value."""
    least = np.full(_N, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(least, (_A[:, None] * s[None, i : i + 512] + _B[:, None]).min(axis=1), out=least)
    mixed = wordhash.mix(least + np.arange(_N, dtype=np.uint64) * _SALT)
    return (mixed >> np.uint64(48)).astype(">u2").tobytes(), np.packbits(((mixed >> np.uint64(20)) & np.uint64(1)).astype(np.uint8)).tobytes()


class Probes:
    """Some texts' sets, to be held exactly against every other set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.fps = [fingerprint(s) for s in sets]
        grams = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order].astype(np.int32)
        self.grams, self.at = np.unique(grams[order], return_index=True)
        self.many = np.diff(np.append(self.at, len(grams)))

    def like(self, s: np.ndarray, threshold: float) -> list[int]:
        """Numbers of the sets that are similar to s."""
        if not len(self.grams) or not len(s):
            return []
        at = np.minimum(np.searchsorted(self.grams, s), len(self.grams) - 1)
        at = at[self.grams[at] == s]
        if not len(at):
            return []
        many = self.many[at]
        places = np.repeat(self.at[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        shared = np.bincount(self.owners[places], minlength=len(self.sizes))
        return np.flatnonzero((shared > 0) & (shared >= threshold * (self.sizes + len(s) - shared) - 1e-9)).tolist()


def probes(docs: DataFrame, most: int = PROBES) -> Probes:
    """The sets of at most so many documents of (id, text), of those that come first by a hash of their ids the ones up to PROBE_BYTES."""
    hashed = docs.select("text", F.xxhash64("id").alias("h"))
    first = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(most).collect()]  # reads no text
    some = hashed.where(F.col("h").isin(first) & F.octet_length("text").between(1, PROBE_BYTES)).dropDuplicates(["h"]).collect()  # a text of each id
    raw = [r.text.encode() for r in some]
    sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return Probes([s for s in sets if len(s)])


def signatures(df: DataFrame, text: str, keep: list[str], against: Probes | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add fp, keys and sketch, null for texts without words, n_grams, and alike: numbers of the probes that are similar."""
    shared = None if against is None else df.sparkSession.sparkContext.broadcast(against)

    def make():
        held = None if shared is None else shared.value

        def compute(batch: pa.RecordBatch):
            sets = list(shingle_sets(*bytes_of(batch, text)))
            signed = [signature(s) if len(s) else (None, None) for s in sets]
            alike = [None if held is None else held.like(s, threshold) or None for s in sets]
            fps = [fingerprint(s) if len(s) else None for s in sets]
            return [pa.array(fps, pa.binary()), pa.array([k for k, _ in signed], pa.binary()), pa.array([b for _, b in signed], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(alike, pa.list_(pa.int32()))]

        return compute

    fields = [*(T.StructField(n, T.BinaryType()) for n in ("fp", "keys", "sketch")), T.StructField("n_grams", T.LongType()), T.StructField("alike", T.ArrayType(T.IntegerType()))]
    return with_arrow(df, text, fields, make, keep)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _unite(keys: np.ndarray, sketch: np.ndarray, depth: int) -> np.ndarray:
    """A number of the set for each of some sorted rows, united from the longest matches of keys down to prefixes of depth values."""
    label = np.arange(len(keys))
    most = int((1 - AGREE) * _N)
    longer = label  # number of the prefix that is one value longer
    for length in range(DEPTH, depth - 1, -1):
        prefix = keys[:, : 1 + 2 * length]
        first = np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(axis=1)])
        starts, run = np.flatnonzero(first), np.cumsum(first) - 1
        whole = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
        live = np.flatnonzero(~whole[run])  # a prefix of which all rows are one set is done
        own = run[live]
        for k in range(1, len(live)):
            at = np.flatnonzero(own[k:] == own[:-k])
            if not len(at):
                break
            i, j = live[at + k], live[at]
            new = (label[i] != label[j]) & (longer[i] != longer[j])
            i, j = i[new], j[new]
            if len(i):
                near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= most
                for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    a, b = sorted((int(label[x]), int(label[y])))
                    if a != b:
                        label[label == b] = a
        longer = run
    return label


def _sets(label: np.ndarray, ids: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(id, hub) for the members of each set: its smallest id is the hub. Large sets are dealt over HUBS hubs, each of which the smallest id shares."""
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows) > 1:
            own = {ids[i] for i in rows.tolist()}
            if len(own) > 1:
                hub = min(own)
                if len(own) <= 4 * HUBS:
                    yield from ((x, hub) for x in own)
                else:
                    yield from ((x, hub + bytes([x[-1] % HUBS])) for x in own)
                    yield from ((hub, hub + bytes([i])) for i in range(HUBS))


def _bridges(a: np.ndarray, b: np.ndarray, own_a: list[bytes], own_b: list[bytes]) -> Iterator[tuple[int, int]]:
    """(row of a, row of b) with like sketches, one for each two sets that they join; own_a and own_b name the set that each row is in."""
    number = {x: i for i, x in enumerate(dict.fromkeys([*own_a, *own_b]))}
    at_a, at_b = (np.array([number[x] for x in own]) for own in (own_a, own_b))
    wide = [np.ascontiguousarray(np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))).view(np.uint64).T.copy() for x in (a, b)]
    most = int((1 - AGREE) * _N)
    for i in range(len(a)):
        if (at_b == at_a[i]).all():
            continue
        far = sum(np.bitwise_count(y ^ x[i]) for x, y in zip(*wide, strict=True))
        for j in np.flatnonzero((far <= most) & (at_b != at_a[i])).tolist():
            if at_b[j] != at_a[i]:
                gone = at_b[j]
                at_a[at_a == gone] = at_a[i]
                at_b[at_b == gone] = at_a[i]
                yield i, j


def _between(rows: DataFrame) -> DataFrame:
    """(node, hub) of like rows in different runs of a prefix; rows: prefix, lo, hi (the pair of runs), run, node, sketch, own, those of a pair together in one partition."""

    def judge(lo: int, members: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        a, b = [m for m in members if m[0] == lo], [m for m in members if m[0] != lo]
        bits = [np.frombuffer(b"".join(m[2] for m in x), np.uint8).reshape(len(x), -1) for x in (a, b)]
        for i, j in _bridges(*bits, [m[3] for m in a], [m[3] for m in b]):
            hub = a[i][1] + b[j][1]
            yield from ((a[i][1], hub), (b[j][1], hub))

    def run(batches):
        current, members = None, []
        for batch in batches:
            out = []
            for prefix, lo, hi, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (prefix, lo, hi) != current:
                    if current is not None:
                        out.extend(judge(current[1], members))
                    current, members = (prefix, lo, hi), []
                members.append(member)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(2)], names=["node", "hub"])
        if current is not None:
            out = list(judge(current[1], members))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(2)], names=["node", "hub"])

    return rows.select("prefix", "lo", "hi", "run", "node", "sketch", "own").mapInArrow(trimmed(run), "node binary, hub binary")


def together(rows: DataFrame, depth: int) -> DataFrame:
    """rows sorted by key, those with a common prefix in one partition; they are streamed there, so a prefix may be long."""
    return rows.repartitionByRange(F.substring("key", 1, 1 + 2 * depth)).sortWithinPartitions("key")


def meet(rows: DataFrame, depth: int, width: int) -> DataFrame:
    """(node, hub) of the sets of all trees, from rows (key, sketch, node) as together() gives them.

    All rows with a common prefix are compared: up to BUCKET of them at once; of more, each run of BUCKET within itself, and
    then each pair of runs as a task of its own, for which the first pass also gives the rows of such prefixes.
    """
    names = ["node", "hub", "prefix", "run", "sketch", "own"]
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        keys, sketches, ids = np.zeros((0, 1 + 2 * DEPTH), np.uint8), np.zeros((0, _N // 8), np.uint8), np.zeros((0, width), np.uint8)
        hot, runs = None, 0  # the prefix that takes more than a run, and its runs so far

        def out(n, more=False):
            nonlocal hot, runs
            prefix, nodes = keys[:n, : 1 + 2 * depth], [x.tobytes() for x in ids[:n]]
            label = _unite(keys[:n], sketches[:n], depth)
            found = [(*x, None, None, None, None) for x in _sets(label, nodes)]
            first = prefix[0].tobytes()
            if more and first != hot:
                hot, runs = first, 0
            if first == hot:
                least: dict[int, bytes] = {}
                own = np.flatnonzero((prefix == prefix[0]).all(axis=1)).tolist()
                for i in own:
                    least[label[i]] = min(least.get(label[i], nodes[i]), nodes[i])
                found += [(nodes[i], None, first, runs, sketches[i].tobytes(), least[label[i]]) for i in own]
                runs += 1
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, _fixed(batch.column(0), 1 + 2 * DEPTH)])
            sketches = np.concatenate([sketches, _fixed(batch.column(1), _N // 8)])
            ids = np.concatenate([ids, _fixed(batch.column(2), width)])
            while len(keys):
                # Up to BUCKET rows that end with a prefix, or BUCKET rows of one prefix.
                last = min(len(keys), BUCKET)
                head = keys[:last, : 1 + 2 * depth]
                new = np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1
                more = False
                if last < len(keys) and (keys[last, : 1 + 2 * depth] != head[-1]).any():
                    n = last
                elif len(new):
                    n = int(new[-1])
                elif last == BUCKET and last < len(keys):
                    n, more = last, True
                else:
                    break
                yield out(n, more)
                keys, sketches, ids = keys[n:], sketches[n:], ids[n:]
                if len(keys) <= BUCKET // 2:
                    break
        if len(keys):
            yield out(len(keys))

    met = materialize(rows.select("key", "sketch", "node").mapInArrow(trimmed(run), "node binary, hub binary, prefix binary, run int, sketch binary, own binary"), "met")
    edges, parts = met.where("prefix IS NULL").select("node", "hub"), met.where("prefix IS NOT NULL").drop("hub")
    if parts.isEmpty():
        return edges
    runs = materialize(parts.groupBy("prefix").agg(F.max("run").alias("last")), "runs")
    pairs = parts.join(sent(runs), "prefix").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).where("other <> run")
    pairs = pairs.select("prefix", F.least("run", "other").alias("lo"), F.greatest("run", "other").alias("hi"), "run", "node", "sketch", "own")
    return edges.unionByName(_between(pairs.repartition("prefix", "lo", "hi").sortWithinPartitions("prefix", "lo", "hi")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node is joined to by shared hubs, with a pointer jump in each round."""
    return resolve.components(edges.withColumnRenamed("hub", "key"), "node").withColumnRenamed("component", "label")


def measured_recall(signed: DataFrame, against: Probes, groups: DataFrame) -> float:
    """Of the pairs of a probe and a different set similar to it, the share that groups (node, label) hold together; 1 without such pairs."""
    numbered = signed.sparkSession.createDataFrame([(i, bytearray(x)) for i, x in enumerate(against.fps)], "probe int, probe_fp binary")
    pairs = signed.where("alike IS NOT NULL").select("fp", F.explode("alike").alias("probe")).distinct()
    pairs = pairs.join(F.broadcast(numbered), "probe").where("fp <> probe_fp").select("fp", "probe_fp").distinct()  # PROBES rows
    of = groups.select(F.col("node").alias("own"), "label")
    both = pairs.join(of.select(F.col("own").alias("fp"), F.col("label").alias("a")), "fp", "left").join(of.select(F.col("own").alias("probe_fp"), F.col("label").alias("b")), "probe_fp", "left")
    got = both.agg(F.avg(F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("int"))).first()[0]
    return 1.0 if got is None else got


def forest(reps: DataFrame, signed: DataFrame, against: Probes, threshold: float, recall: float) -> DataFrame:
    """(node, label) of the candidate groups; prefixes are shortened until the recall is reached, as expected and as measured."""
    key_of = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.substring(F.col("keys"), F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)))
    trees = reps.select("node", "keys", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(key_of.alias("key"), "sketch", "node")
    depth = depth_for(threshold, recall)
    while True:
        groups = components(meet(together(trees, depth), depth, 16))
        if depth == 1 or not against.fps or measured_recall(signed, against, groups) >= recall:
            return groups
        depth -= 1


def _jaccard_links(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of a and b are similar, by exact intersection."""
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    shared = np.zeros(sizes.shape, np.float64)
    if len(a) * len(b) <= 6:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                shared[i, j] = len(np.intersect1d(x, y, assume_unique=True))
    else:
        values, columns = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
        order = np.argsort(columns, kind="stable")
        columns, owner = columns[order], owner[order]
        step = max(1 << 10, (8 << 20) // (len(a) + len(b)))
        cuts = np.searchsorted(columns, np.arange(0, len(values) + step, step))
        for k in range(len(cuts) - 1):
            part = slice(cuts[k], cuts[k + 1])
            dense = np.zeros((len(a) + len(b), step), np.float32)
            dense[owner[part], columns[part] - k * step] = 1
            shared += dense[: len(a)] @ dense[len(a) :].T
    return shared >= threshold * (sizes - shared) - 1e-9


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """node, links (documents linked), hub (null without a link) from the members of each pair of blocks.

    rows: grp, lo, hi (the pair of blocks), block, node, n (copies) and set, those of a pair of blocks together in one partition.
    """

    def judge(lo: int, hi: int, members: list[tuple]) -> Iterator[tuple]:
        members = list({m[1]: m for m in members}.values())
        a, b = [m for m in members if m[0] == lo], [m for m in members if m[0] == hi]
        like = _jaccard_links([m[3] for m in a], [m[3] for m in b], threshold)
        whole = a if lo == hi else a + b
        if lo == hi:
            np.fill_diagonal(like, False)
            links, near = like @ np.array([m[2] for m in b]), like
        else:
            links = np.concatenate([like @ np.array([m[2] for m in b]), like.T @ np.array([m[2] for m in a])])
            near = np.zeros((len(whole), len(whole)), bool)
            near[: len(a), len(a) :] = like
            near |= near.T
        label = np.arange(len(whole))
        while True:
            least = np.minimum(label, np.where(near, label[None, :], len(whole)).min(axis=1, initial=len(whole)))
            if (least == label).all():
                break
            label = least
        tail = struct.pack(">II", lo, hi)
        for i, m in enumerate(whole):
            if links[i]:
                yield m[1], int(links[i]), whole[int(label[i])][1] + tail

    def run(batches):
        current, members = None, []
        out: list[tuple] = []

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["node", "links", "hub"])
            out.clear()
            return made

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for grp, lo, hi, block, node, n, own in zip(*columns, strict=True):
                if (grp, lo, hi) != current:
                    if current is not None:
                        out.extend(judge(*current[1:], members))
                    current, members = (grp, lo, hi), []
                members.append((block, node, n, np.frombuffer(own, np.uint64)))
            if len(out) > 5000:
                yield flush()
        if current is not None:
            out.extend(judge(*current[1:], members))
        yield flush()

    return rows.select("grp", "lo", "hi", "block", "node", "n", "set").mapInArrow(trimmed(run), "node binary, links bigint, hub binary")


def sent(df: DataFrame) -> DataFrame:
    """A hint to broadcast df if its values have at most MOST_SENT bytes; df should be materialised."""
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(8) for f in df.schema.fields), F.lit(8))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= MOST_SENT else df


def representatives(signed: DataFrame, names: list[str]) -> DataFrame:
    """node (the set's fingerprint), rep (the smallest id, null only if all are), n (copies) and the named columns, for each set of signed rows (id, fp, names)."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", *names)).alias("x")
    copies = signed.where(F.col("fp").isNotNull()).groupBy("fp").agg(first, F.count("*").alias("n"))
    return copies.select(F.col("fp").alias("node"), F.col("x.id").alias("rep"), "n", *(f"x.{c}" for c in names))


def verified(docs: DataFrame, signed: DataFrame, reps: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """id, class_id and n_links of each row of signed (id, fp), from candidate groups (node, label) of reps (node, rep, n, n_grams) whose sets decide.

    docs: (id, text), for the sets of the members.
    """
    found = groups.withColumnRenamed("label", "grp").join(reps.select("node", "rep", "n", "n_grams"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_grams") * 8 / BLOCK_BYTES)).cast("int")
    members = materialize(found.join(found.groupBy("grp").agg(blocks.alias("blocks")), "grp").drop("n_grams"), "members")

    # The texts of the members once more, for their sets.
    again = docs.join(sent(members), F.col("id").eqNullSafe(F.col("rep"))).select("text", "node", "n", "grp", "blocks")

    def make():
        def compute(batch: pa.RecordBatch):
            sets = list(shingle_sets(*bytes_of(batch, "text")))
            want = batch.column("node").to_pylist()
            return [pa.array([s.tobytes() if len(s) and fingerprint(s) == w else None for s, w in zip(sets, want, strict=True)], pa.binary())]

        return compute

    sets = with_arrow(again, "text", [T.StructField("set", T.BinaryType())], make, ["node", "n", "grp", "blocks"]).where(F.col("set").isNotNull())
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "set")
    checked = materialize(verify(dealt.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi"), threshold), "links")

    linked = checked.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(checked.select("node", "hub"))
    firsts = labels.join(reps.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("class_id"))  # of each class with links, in the keys' own order
    known = reps.select("node", "rep", "n").join(linked, "node", "left").join(labels.join(firsts, "label"), "node", "left")
    own = F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("class_id"))
    known = materialize(known.select(F.col("node").alias("fp"), own.alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    discard(checked, members)
    return signed.join(known, "fp", "left").select("id", F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """key, class_id (smallest key of the class that links join) and n_links (documents linked to this one, copies included) for each row."""
    prepare(df.sparkSession)
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    against = probes(docs)
    signed = materialize(signatures(docs, "text", ["id"], against, threshold), "signatures")
    reps = materialize(representatives(signed, ["keys", "sketch", "n_grams"]), "representatives")
    wide, signed = signed, materialize(signed.select("id", "fp", "alike"), "signed")
    discard(wide)
    groups = forest(reps, signed, against, threshold, recall)
    out = verified(docs, signed.select("id", "fp"), reps, groups, threshold)
    discard(reps)
    return out.withColumnRenamed("id", key)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each class: the one with the smallest key, once.

    A key that stands for several different texts stays if any of them represents its class.
    """
    found = materialize(classes(df, key, text).groupBy(key).agg(F.max((F.col(key) == F.col("class_id")).cast("int")).alias("first"), F.count("*").alias("rows")), "kept")
    dropped = materialize(found.where(F.col(key).isNotNull() & (F.col("first") == 0)).select(key), "dropped")
    kept = df.join(sent(dropped), key, "left_anti").select(*df.columns)
    repeated = materialize(found.where((F.col("rows") > 1) & (F.col("first") == 1)).select(key), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(sent(repeated), key, "left_semi").dropDuplicates([key, text]).select(*df.columns)
    return kept.join(sent(repeated), key, "left_anti").select(*df.columns).unionByName(once)


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


QUERIES = {"op6_near": op6_near}
ORACLE: dict[str, str] = {}
