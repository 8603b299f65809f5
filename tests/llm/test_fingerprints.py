"""Fingerprints against plain sets, edited texts against a plain loop, classes against all pairs."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import fingerprints as fp
from shelfspark.llm import near


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(rows):
    """What each row becomes, in order of ids (null last) and hashes of texts."""
    texts = [t or "" for _, t in rows]
    return [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}é" for i in range(400)]
    rows = [(3 * i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 60, 300])))) for i in range(120)]
    return rows + [(1000, ""), (1001, "   "), (1002, "x"), (1003, "ab"), (1004, None)]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edited_texts_and_likeness(spark, corpus, ranges):
    shuffled = random.Random(ranges).sample(corpus, len(corpus))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        df = spark.createDataFrame(shuffled, "doc_id bigint, text string").select("*", F.lit(1).alias("id"), F.lit(2).alias("at"), F.lit("y").alias("hash")).repartition(5)
        got = {r.doc_id: r for r in fp.edited(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(corpus)
    prints = dict(zip((i for i, _ in corpus), fp.minhashes([t or "" for _, t in corpus]), strict=True))
    for (i, t), e, (j, _) in zip(corpus, edited(corpus), corpus[1:] + corpus[:1], strict=True):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t or ""), hashlib.sha256(e.encode()).hexdigest())
        new = fp.minhashes([e])[0]
        assert base64.b64decode(r.fingerprint) == prints[i] and base64.b64decode(r.edited_fingerprint) == new
        assert r.near_edited == fp.likeness(prints[i], new) and r.near_next == fp.likeness(prints[i], prints[j])
        assert abs(fp.likeness(prints[i], new) - (jaccard(t, e) if shingles(t) else float(not shingles(e)))) < 0.25
    assert np.mean([abs(fp.likeness(prints[i], fp.minhashes([e])[0]) - jaccard(t, e)) for (i, t), e in zip(corpus, edited(corpus), strict=True) if shingles(t)]) < 0.04


def test_odd_rows_of_edited_texts(spark):
    rows = [(1, "one two"), (1, "one two"), (1, "other words here"), (None, "a b c d e f"), (None, None), (7, "")]
    got = fp.edited(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    order = sorted(((r[0] is None, r[0] or 0, h.h), r) for r, h in zip(rows, spark.createDataFrame([(t or "",) for _, t in rows], "t string").select(F.xxhash64("t").alias("h")).collect(), strict=True))
    rows = [r for _, r in order]
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted((str(i), hashlib.sha256(e.encode()).hexdigest()) for (i, _), e in zip(rows, edited(rows), strict=True))
    one = fp.edited(spark.createDataFrame([("x", "abcd")], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in one] == [("x", 4, hashlib.sha256(b"abab").hexdigest(), 1.0)]
    assert fp.edited(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert (fp.likeness(b"", b""), fp.likeness(b"", b"12")) == (1.0, 0.0)


def plainly(rows):
    """id, class and links by all pairs."""
    sets = [shingles(t) for _, t in rows]
    like = [[a != b and bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in range(len(rows))] for a in range(len(rows))]
    label = list(range(len(rows)))
    while True:
        new = [min([label[a], *(label[b] for b in range(len(rows)) if like[a][b])]) for a in range(len(rows))]
        if new == label:
            break
        label = new
    least = lambda k: min((rows[b][0] for b in range(len(rows)) if label[b] == k and rows[b][0] is not None), default=None)
    return sorted(((rows[a][0], least(label[a]), sum(like[a])) for a in range(len(rows))), key=str)


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("of", [fp.classes, near.classes])
def test_classes_are_those_of_all_pairs(spark, of, kind):
    """Copies, chains of near copies and different texts, by ids that are numbers or texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        text = [rng.choice(words) for _ in range(80)]
        for _ in range(rng.choice([1, 4, 9])):
            rows.append((len(rows) * 7 % 1000, " ".join(text)))
            if rng.random() < 0.7:
                text[rng.randrange(80)] = rng.choice(words)
    rows += [(2000, None), (2001, ""), (2002, "two words"), (2003, "two words"), (None, rows[0][1])]
    rows = [(None if i is None else i if kind == "bigint" else f"d{i:02}", t) for i, t in rows]
    got = of(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == plainly(rows)


def test_documents(spark, small):
    got = fp.op11_minhash(spark, small).toPandas()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert got.near_edited.mean() > 0.2 > got.near_next.mean() and got.groupby("edited_sha256").edited_fingerprint.nunique().max() == 1
