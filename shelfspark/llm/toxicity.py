"""Operator 10: toxic passages as maximum-scoring segments of token log-odds.

Words and their beginnings (so that inflected forms count together) get log-odds of toxic against other training
documents, smoothed by a Dirichlet prior in proportion to their frequency in both. A word scores the best log-odds
of those that have a clear surplus; without one, a small negative value. Near copies among the training documents
count once. A linear scan finds all maximal segments of a document (each the best that does not share a token with a
better one). Karlin-Altschul statistics, fitted to the other training documents, say how often a segment as good would come
by chance in a text of that length; the significant ones' surplus over chance, in nats, is summed and turned into a
probability by logistic regression on the training documents.

Defined results: a null or empty text, or one without a scoring token, has no segment and the score of surplus 0; an empty table
gives no rows. Without training documents of both labels all scores are the prior's. Very long texts are scanned whole, in linear time. Rows
repeat as they come; labels of one document that disagree count as toxic. Label, language, source and id are no inputs of a score. A
column of the table that has the name of a result (score, passages) gives way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import GAP, documents, materialize, prepare, text_or_empty, texts_of, trimmed, with_arrow

#: At most so many labelled documents are learned from: those first by the hash of their ids.
MAX_TRAIN = 20_000
#: Hash functions by which near copies among the training documents are told.
LIKE = 4
#: The prior weighs this share of the training tokens; a token scores if its log-odds are CLEAR standard errors above 0.
PRIOR, CLEAR, STRONG, LEAST_DOCS, SIGNIFICANT, FOLDS = 0.1, 2.5, 2.0, 3, 0.05, 5
OTHER, STEMS, MEMORY = -0.02, range(3, 8), 200_000

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word itself, marked by a blank, and its beginnings."""
    return [word + " ", *(word[:n] for n in STEMS if n <= len(word))]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)  # of the features that score
    other: float = OTHER
    rate: float = 1.0  # lambda of the extreme-value distribution; 1 for log-likelihood ratios
    log_k: float = 0.0
    bias: float = -2.0
    slope: float = 1.0


class Words(dict):
    """Scores by word, 0 for those that do not score; holds MEMORY words at most."""

    def __init__(self, model: Model):
        super().__init__()
        self.odds = model.odds

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
        out = max((self.odds.get(f, 0.0) for f in features(word)), default=0.0)
        if len(word) <= 40:
            self[word] = out
        return out


def maximal_segments(scores: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """(first, last, sum) of all maximal-scoring segments of a sequence that is other (negative) except at (place, score).

    A stack of candidates is kept with the cumulative sums left of and at the end of each. A new
    candidate joins the latest one that began lower, if that one's end is not above its own.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum behind
    total, at = 0.0, 0
    for place, score in scores:
        total += other * (place - at)
        at = place + 1
        first, left, right = place, total, total + score
        total = right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, place, left, right))
    return [(a, b, r - x) for a, b, x, r in stack]


def segments(text: str | None, model: Model, words: Words) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of words, and the maximal segments by first and last word and their sums."""
    found = tokens(text)
    hits = [(i, x) for i, x in enumerate(map(words.__getitem__, found)) if x]
    return len(found), maximal_segments(hits, model.other)


def surplus(n: int, found: list[tuple[int, int, float]], model: Model) -> tuple[float, list[tuple[int, int]]]:
    """Nats by which the significant segments pass chance, and these segments."""
    total, kept = 0.0, []
    for a, b, s in found:
        excess = model.rate * s - model.log_k - math.log(max(n, 1))  # minus log of the expected number as good
        if excess >= -math.log(SIGNIFICANT):
            total += excess
            kept.append((a, b))
    return total, kept


def probability(x: float, model: Model) -> float:
    z = model.bias + model.slope * min(x, 200.0)
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def training(labels: DataFrame, docs: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """text and toxic of the documents to learn from; at most `most` ids are broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0))
    ids = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    # Near copies share the smallest of the word triples' hashes by each of LIKE functions; texts of similarity s do so with s ** LIKE.
    words = F.split(text_or_empty(), GAP)
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: F.xxhash64(F.slice("w", i, F.lit(3))))
    least = F.array(*[F.array_min(F.transform(triples, lambda h, k=k: F.xxhash64(h, F.lit(k)))) for k in range(LIKE)])
    rows = rows.withColumn("w", words).select("doc_id", "text", "toxic", least.alias("like"))
    rows = materialize(rows, "training")
    first = rows.groupBy("like").agg(F.min(F.struct(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id")).alias("x")).select(F.col("x.doc_id").alias("doc_id"))
    return rows.join(F.broadcast(first), "doc_id", "left_semi").select("text", "toxic")  # at most `most` ids


def token_odds(rows: DataFrame) -> dict[str, float]:
    """Log-odds of the features with a clear surplus in toxic documents."""

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(texts_of(batch, "text"), batch.column(1).to_pylist(), strict=True):
                found = {f for t in set(tokens(text)) for f in features(t)}
                total.update((f, toxic) for f in found)
                total[None, toxic] += 1
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["token", "toxic", "n"])

    counts = rows.select("text", "toxic").mapInArrow(trimmed(count), "token string, toxic int, n bigint")
    by = counts.groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("no"))
    # Rare features never count; the null token has the numbers of documents.
    by = materialize(by.where(F.col("token").isNull() | (F.col("yes") >= LEAST_DOCS)), "tokens")
    whole = by.where(F.col("token").isNull()).first()
    if whole is None or not whole.yes or not whole.no:
        return {}
    prior = PRIOR * (F.col("yes") + F.col("no"))
    both = PRIOR * (whole.yes + whole.no)
    side = lambda n, total: F.log((n + prior) / F.greatest(F.lit(0.5), total + both - n - prior))
    odds = side(F.col("yes"), F.lit(float(whole.yes))) - side(F.col("no"), F.lit(float(whole.no)))
    spread = F.sqrt(1 / (F.col("yes") + prior) + 1 / (F.col("no") + prior))
    clear = by.where(F.col("token").isNotNull()).withColumns({"odds": odds, "z": odds / spread}).where((F.col("z") >= CLEAR) & (F.col("odds") >= STRONG))
    return {r.token: r.odds for r in clear.select("token", "odds").collect()}  # of a bounded sample


def fit(labels: DataFrame, docs: DataFrame, most: int = MAX_TRAIN) -> Model:
    prepare(docs.sparkSession)
    rows = training(labels, docs, most)
    model = Model(token_odds(rows))

    def measure(batches):
        words = Words(model)
        for batch in batches:
            got = [segments(t, model, words) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([[s for _, _, s in f] for _, f in got], pa.list_(pa.float64())), batch.column(1)], names=["n", "sums", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(trimmed(measure), "n bigint, sums array<double>, toxic int")
    # One row for each way that the bounded sample's documents come out, with how many do.
    cells = seen.groupBy("n", F.transform("sums", lambda s: F.round(s, 3)).alias("sums"), "toxic").count().collect()
    clean = [(r.n, max(r.sums), r["count"]) for r in cells if r.sums and r.toxic == 0]
    without = sum(r["count"] for r in cells if r.toxic == 0 and not r.sums)
    # Log-likelihood ratios have lambda 1; where chance segments are seen, their mean sets K: mean of the maximum = (log(K n) + 0.5772) / lambda.
    seen_k = [(s - math.log(max(n, 1)) - 0.5772, c) for n, s, c in clean]
    if seen_k:
        share = sum(c for _, c in seen_k) / (without + sum(c for _, c in seen_k))
        model.log_k = sum(k * c for k, c in seen_k) / sum(c for _, c in seen_k) + math.log(share)
    else:
        model.log_k = -math.log(max(2, without))
    points = Counter()
    for r in cells:
        x, _ = surplus(r.n, [(0, 0, s) for s in r.sums], model)
        points[round(min(x, 200.0), 2), r.toxic] += r["count"]
    model.bias, model.slope = logistic([(x, y, c) for (x, y), c in points.items()])
    return model


def logistic(points: list[tuple[float, int, int]], steps: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and slope by Newton's method with a small ridge on the slope; counted points (x, label, n)."""
    a, b = 0.0, 0.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = 0.0, -ridge * b, 1e-9, 0.0, ridge
        for x, y, c in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            ga, gb = ga + c * (y - p), gb + c * (y - p) * x
            w = c * p * (1 - p)
            haa, hab, hbb = haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        a, b = a + max(-2.0, min(2.0, da)), b + max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return a, max(b, 0.0)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score, and the significant passages as (first, last) tokens."""
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))

    def make():
        words = Words(model)

        def compute(batch: pa.RecordBatch):
            got = [surplus(*segments(t, model, words), model) for t in texts_of(batch, text)]
            return [pa.array([probability(x, model) for x, _ in got], pa.float64()), pa.array([[{"first": a, "last": b} for a, b in k] for _, k in got], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]

        return compute

    return with_arrow(df, text, [T.StructField("score", T.DoubleType()), T.StructField("passages", span)], make, keep)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs)
    out = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
