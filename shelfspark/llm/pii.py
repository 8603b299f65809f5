"""Operator 9: information-theoretic sanitisation of personal data.

Protected entities are found by form: e-mail, address, card and phone, and secrets (long hexadecimal digits and tokens with a
known beginning). How strongly a word discloses them is estimated from co-occurrence in the whole corpus: the words within
WINDOW words of an entity are its context, left and right apart, and the pointwise mutual information of a word and what it
stands beside is held against the information content of that: 1 means that the word gives it away. This is done for kinds of
entities (a word that stands beside many different ones) and for single entities (a word that keeps coming back beside the same one).

A word is a span of its own if its share passes the threshold and its company is no chance: the likelihood ratio against
independence, of different entities or different contexts only (copies of one document prove nothing), must outweigh the number of words
tried. The threshold is DISCLOSURE or, if higher, what words get beside random places of the same documents, as many as there are entities.
Such a word is replaced by the most specific generalisation that discloses less than the threshold, from the kind over its group to any
personal data (GROUPS), and removed if there is none.

Counting takes passes that each send little: contexts of entities, occurrences in the corpus of the candidates, and the spans. Up
to BLOCK words are sent to executors as one array; more are joined by hash, for counting as sums of each task, and for
spans as the list of each different text.

Defined results: a null or empty text has no spans; an empty table gives no rows. Spans count code points, ends exclusive, and come in order
of start, then kind. Very long texts are read whole, in time linear but for a logarithm. Rows repeat as they come, each with its own spans. A
corpus without entities has no disclosing words. A column of the table that has the name of the result gives way to it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm import wordhash
from shelfspark.llm.common import bytes_of, documents, materialize, prepare, slices, texts_of, trimmed, with_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term")
#: Words on each side; the least disclosure; the chance of a false word, over all; different contexts that tell of a single entity; words that are broadcast.
WINDOW, DISCLOSURE, CHANCE, CONTEXTS, BLOCK = 8, 0.75, 0.001, 3, 1_000_000
LEFT, RIGHT = 0, 1
GROUPS = {"email": "contact", "phone": "contact", "ip": "device", "card": "finance", "secret": "credential"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(
    r"(?<![0-9A-Za-z])(?:(?=[a-f]*[0-9])[0-9a-f]{32,}|(?=[A-F]*[0-9])[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|glpat-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}"
    r"|AIza[0-9A-Za-z_-]{35}|sk_(?:live|test)_[0-9A-Za-z]{16,}|eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,})(?![0-9A-Za-z])"
)
_ANY = re.compile(r"[@0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping: a match holds an @, the longest run of local characters before it and a domain with a dot."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the protected entities."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts = [(p.start() + m.start(), p[0]) for p in _PART.finditer(m[0])]
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for _, p in four):
                    out.append((four[0][0], 1, four[3][0] + len(four[3][1])))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out += [(m.start(), 4, m.end()) for m in _SECRET.finditer(text)]
    return sorted(out)


def _texts(batch: pa.RecordBatch, text: str):
    """Bytes, offsets, and (row, text) of the rows that can hold entities."""
    raw, offsets = bytes_of(batch, text)
    hit = np.flatnonzero((raw == 64) | ((raw >= 48) & (raw <= 57)))
    rows = np.unique(np.searchsorted(offsets, hit, side="right") - 1)
    whole = raw.tobytes()
    return raw, offsets, [(i, whole[offsets[i] : offsets[i + 1]].decode()) for i in rows.tolist()]


_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words without punctuation around them, the number of words before each text, and hashes in lower case."""
    starts, ends, _ = wordhash.words(raw, offsets)
    for at, step in ((starts, 1), (ends, -1)):
        live = np.arange(len(starts))
        while len(live := live[(starts[live] < ends[live]) & _MARKS[raw[np.minimum(at[live] - (step < 0), len(raw) - 1)]]]):
            at[live] += step
    some = starts < ends
    starts, ends = starts[some], ends[some]
    return starts, ends, np.searchsorted(starts, offsets), wordhash.hashes(wordhash.lower(raw), starts, ends).astype(np.int64)


def contexts(df: DataFrame, text: str = "text") -> DataFrame:
    """term (hash of a word), kind, side, chance (beside a random place instead), entity (hash), place (hash of the word on the other side) and how often.

    Where all of these are null, n counts the bytes of the texts.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                raw, offsets, some = _texts(batch, text)
                found: Counter = Counter()
                for row, t in some:
                    spans = base_spans(t)
                    if not spans:
                        continue
                    own = raw[offsets[row] : offsets[row + 1]]
                    starts, ends, _, hashed = terms_of(own, np.array([0, len(own)]))
                    byte = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))  # of each code point
                    at = [(int(np.searchsorted(ends, byte[a], side="right")), int(np.searchsorted(starts, byte[b]))) for a, _, b in spans]
                    inside = np.zeros(len(hashed) + 1, int)
                    for i, j in at:
                        inside[i] += 1
                        inside[j] -= 1
                    free, hashes = (np.cumsum(inside)[:-1] == 0).tolist(), hashed.tolist()
                    for (a, kind, b), (i, j) in zip(spans, at, strict=True):
                        entity = xxhash.xxh64_intdigest(t[a:b]) - (1 << 63)
                        random = (entity + len(hashes)) % max(1, len(hashes))
                        for null, x, y in ((False, i, j), (True, random, random + 1)):
                            before, after = hashes[x - 1] if x else 0, hashes[y] if y < len(hashes) else 0
                            found.update((hashes[w], kind, LEFT, null, entity, after) for w in range(max(0, x - WINDOW), x) if free[w])
                            found.update((hashes[w], kind, RIGHT, null, entity, before) for w in range(y, min(len(hashes), y + WINDOW)) if free[w])
                found[(None,) * 6] = len(raw)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
                columns = [pa.array([k[i] for k in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["term", "kind", "side", "chance", "entity", "place", "n"])

    return df.select(text).mapInArrow(trimmed(run), "term bigint, kind int, side int, chance boolean, entity bigint, place bigint, n bigint")


def occurrences(df: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """term, n: how often each of the different terms stands in the corpus; the null term counts all words."""
    few = terms.count() <= BLOCK
    sent = df.sparkSession.sparkContext.broadcast(np.sort(terms.toPandas()["term"].to_numpy(np.int64))) if few else None

    def told(total: int, found: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([None, *found.tolist()], pa.int64()), pa.array([total, *counts.tolist()], pa.int64())], names=["term", "n"])

    def run(batches):
        wanted = None if sent is None else sent.value
        total, sums = 0, np.zeros(0 if wanted is None else len(wanted), np.int64)
        for whole in batches:
            for batch in slices(whole, text):
                _, _, _, h = terms_of(*bytes_of(batch, text))
                if wanted is None:  # too many words to remember for all of a task
                    yield told(len(h), *np.unique(h, return_counts=True))
                    continue
                total += len(h)
                if len(wanted):
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    sums += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        if wanted is not None:
            some = np.flatnonzero(sums)
            yield told(total, wanted[some], sums[some])

    counts = df.select(text).mapInArrow(trimmed(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return counts if few else counts.join(terms.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("long").alias("term"))), counts["term"].eqNullSafe(terms["term"]), "left_semi")


def shares(met: DataFrame, counts: DataFrame, words: int, tried: int) -> DataFrame:
    """met (term, total: context words of what it stands beside, n: of them the term, different) with share, where the company is no chance."""
    both = met.alias("c").join(counts.alias("t"), F.col("c.term") == F.col("t.term")).select("c.*", F.col("t.n").alias("all"))
    given, base = F.least(F.lit(1.0), F.col("n") / F.col("all")), F.col("total") / F.lit(float(words))
    ratio = F.col("different") * F.log(given / base)  # natural logarithm of the likelihood ratio
    share = F.when(base < 1, 1 + F.log(given) / -F.log(base)).otherwise(F.lit(0.0))
    return both.withColumn("share", share).where((given > base) & (ratio >= math.log(max(1, tried) / CHANCE)))


def disclosing(df: DataFrame, text: str = "text") -> DataFrame | None:
    """term, kind, share (disclosure) and label (generalisation, empty if removed) of the words that disclose entities; None without entities."""
    prepare(df.sparkSession)
    key = ["term", "kind", "side", "chance"]
    pairs = contexts(df, text).groupBy(*key, "entity", "place").agg(F.sum("n").alias("n")).groupBy(*key, "entity").agg(F.sum("n").alias("n"), F.count("*").alias("places"))
    pairs = materialize(pairs, "pairs")
    of_kind = {(r.kind, r.side): r.n for r in pairs.where("NOT chance").groupBy("kind", "side").agg(F.sum("n").alias("n")).collect()}  # a few kinds
    if not of_kind:
        return None
    total = F.create_map(*[F.lit(x) for k, n in of_kind.items() for x in (k[0] * 2 + k[1], n)])[F.col("kind") * 2 + F.col("side")]
    by_kind = pairs.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("different")).where("term IS NOT NULL AND different >= 2").withColumn("total", total)
    # Single entities: contexts that mostly differ, so that they are no copies of one.
    whole = pairs.where("NOT chance").groupBy("entity", "side").agg(F.sum("n").alias("total"))
    own = pairs.where((F.col("places") >= CONTEXTS) & (2 * F.col("places") >= F.col("n"))).join(whole, ["entity", "side"])
    own = own.groupBy("term", "entity", "kind", "side", "chance").agg(F.max("n").alias("n"), F.max("places").alias("different"), F.max("total").alias("total")).drop("entity")
    met = materialize(by_kind.withColumn("single", F.lit(False)).unionByName(own.withColumn("single", F.lit(True))), "met")
    tried = met.where("NOT chance").count()
    # Before occurrences are counted: what couldn't pass if it stood nowhere else. A word takes two bytes with its gap.
    most = (pairs.where("term IS NULL").agg(F.sum("n")).first()[0] or 0) / 2 + 1
    able = F.col("different") * F.log(F.greatest(F.lit(1.0), most / F.col("total"))) >= math.log(max(1, tried) / CHANCE)
    counts = materialize(occurrences(df, materialize(met.where(able).select("term").distinct(), "terms"), text), "occurrences")
    words = counts.where("term IS NULL").agg(F.max("n")).first()[0] or 1
    found = shares(met, counts, words, tried)
    noise = {r.kind: r.most for r in found.where("chance").groupBy("kind").agg(F.max("share").alias("most")).collect()}
    limits = {k: max(DISCLOSURE, noise.get(k, 0.0)) for k, _ in of_kind}

    def information(of) -> float:
        n = sum(n for (k, _), n in of_kind.items() if of(KINDS[k]))
        return -math.log(min(0.999, max(n, 1) / words))

    content = {k: information(lambda x, k=k: x == KINDS[k]) for k in limits}
    groups = {g: information(lambda x, g=g: GROUPS[x] == g) for g in GROUPS.values()}
    root = information(lambda x: True)

    label = F.lit("")
    for k, limit in limits.items():
        disclosed = F.lit(content[k])  # by what a single entity or the kind holds
        mine = F.when(F.col("single"), F.greatest(disclosed, -F.log(F.col("total") / float(words)))).otherwise(disclosed)
        general = F.lit("")
        for name, held in (("personal", root), (GROUPS[KINDS[k]], groups[GROUPS[KINDS[k]]]), (KINDS[k], content[k])):
            general = F.when(F.lit(held) / mine < limit, F.lit(f"[{name.upper()} TERM]")).otherwise(general)
        label = F.when(F.col("kind") == k, general).otherwise(label)
    limit = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)])[F.col("kind")]
    best = found.where(~F.col("chance") & (F.col("share") >= limit)).withColumn("label", label).groupBy("term").agg(F.max(F.struct("share", "kind", "label")).alias("x"))
    return materialize(best.select("term", "x.kind", "x.share", "x.label"), "disclosing")


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))


def find(df: DataFrame, text: str = "text", into: str = "spans", keep: list[str] | None = None, terms: DataFrame | None = None, clean: str | None = None) -> DataFrame:
    """Add the spans of each text: start, kind (place in KINDS), end and the label that replaces it.

    terms: what disclosing() gave for the corpus; found here if not given. clean: a column to add with the sanitised text.
    """
    found = disclosing(df, text) if terms is None else terms
    new = [into, *([] if clean is None else [clean])]
    names = [c for c in df.columns if c not in new and (keep is None or c in keep)]
    n = 0 if found is None else found.count()
    sent = None
    if 0 < n <= BLOCK:
        block = found.select("term", "kind", "label").toPandas().sort_values("term")
        sent = df.sparkSession.sparkContext.broadcast((block["term"].to_numpy(np.int64), block["kind"].tolist(), block["label"].tolist()))
    source = _told(df, text, found) if n > BLOCK else df

    def make():
        def compute(batch: pa.RecordBatch):
            raw, offsets, some = _texts(batch, text)
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for i, t in some:
                rows[i] = [(a, k, b, LABELS[KINDS[k]]) for a, k, b in base_spans(t)]
            if n:
                starts, ends, before, h = terms_of(raw, offsets)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                if sent is not None:
                    _mark(rows, range(len(rows)), sent.value, starts, ends, before, h, points, offsets)
                else:
                    for i, told in enumerate(batch.column(TOLD).to_pylist()):
                        if told:
                            told = sorted(told, key=lambda x: x["term"])
                            _mark(rows, [i], (np.array([x["term"] for x in told], np.int64), [x["kind"] for x in told], [x["label"] for x in told]), starts, ends, before, h, points, offsets)
            made = [[{"start": a, "kind": k, "end": b, "label": x} for a, k, b, x in sorted(r)] for r in rows]
            out = [pa.array(made, _SPAN)]
            return out if clean is None else [*out, pa.array([replaced(t, s) for t, s in zip(texts_of(batch, text), made, strict=True)], pa.string())]

        return compute

    fields = [T.StructField(into, SPAN), *([] if clean is None else [T.StructField(clean, T.StringType())])]
    out = with_arrow(source, text, fields, make, [*names, TOLD])
    return out.select(*names, *new)


TOLD = "__told"


def _told(df: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """df with the disclosing words that each text holds: joined by hash for each different text, then by the text's own hash."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                raw, offsets = bytes_of(batch, text)
                _, _, before, h = terms_of(raw, offsets)
                rows = [np.unique(h[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)]
                fps = [_fingerprint(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                some = [f for f, r in zip(fps, rows, strict=True) for _ in range(len(r))]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]), pa.int64())], names=["fp", "term"])

    held = df.select(text).mapInArrow(trimmed(run), "fp binary, term bigint").distinct().join(terms.select("term", "kind", "label"), "term")
    lists = materialize(held.groupBy("fp").agg(F.collect_list(F.struct("term", "kind", "label")).alias(TOLD)), "told")  # at most the different words of one text
    marked = with_arrow(df, text, [T.StructField("__fp", T.BinaryType())], lambda: lambda batch: [pa.array(_fingerprints(*bytes_of(batch, text)), pa.binary())])
    return marked.join(lists, marked["__fp"] == lists["fp"], "left").drop("__fp", "fp")


def _fingerprint(raw: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(raw.tobytes())


def _fingerprints(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    return [_fingerprint(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _mark(rows: list[list], which, block: tuple, starts, ends, before, h, points, offsets) -> None:
    """Add the spans of the block's words to the rows in question, where they touch no span by form."""
    wanted, kind, label = block
    a, b = int(before[which[0]]) if len(which) else 0, int(before[which[-1] + 1]) if len(which) else 0
    at = np.minimum(np.searchsorted(wanted, h[a:b]), len(wanted) - 1)
    hits = np.flatnonzero(wanted[at] == h[a:b])
    owner = np.searchsorted(before, hits + a, side="right") - 1
    known, begin, reach = -1, [], []
    for i, row, t in zip((hits + a).tolist(), owner.tolist(), at[hits].tolist(), strict=True):
        if row != known:  # where the spans by form begin, and how far those up to there reach
            known, forms = row, sorted((s[0], s[2]) for s in rows[row])
            begin, reach = [s[0] for s in forms], list(accumulate((s[1] for s in forms), max))
        x, y = (int(points[p] - points[offsets[row]]) for p in (starts[i], ends[i]))
        n = bisect_left(begin, y)
        if not n or reach[n - 1] <= x:
            rows[row].append((x, KINDS.index("term"), y, label[t]))


def replaced(text: str | None, spans: list[dict] | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the label of its first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], s["label"]]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitised(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the spans of its texts generalised or removed, and the same columns."""
    found = find(df, text, "__spans", clean="__text")
    return found.select(*[F.col("__text").alias(c) if c == text else F.col(c) for c in df.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op9_pii": op9_pii}
ORACLE: dict[str, str] = {}
