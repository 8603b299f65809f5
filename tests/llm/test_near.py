"""The near join on large groups, and its measured recall."""

import random

import numpy as np
import pytest

from shelfspark.llm import near
from tests.llm.test_ops import brute_links, shingles


def many_variants(n, seed=11, words=150, places=12, others=3):
    """Near copies of one text, most of them different: up to five words at some places are replaced by one of a few others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    at = rng.sample(range(words), places)
    out = []
    for _ in range(n):
        t = list(base)
        for p in rng.sample(at, rng.randrange(0, 6)):
            t[p] = f"v{p}.{rng.randrange(others)}"
        out.append(" ".join(t))
    return out


def dense_links(texts, threshold=0.8):
    """Links of each text and the smallest number of its class, from exact intersections of all pairs."""
    sets = [shingles(t) for t in texts]
    number = {g: i for i, g in enumerate(dict.fromkeys(g for s in sets for g in s))}
    whole = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        whole[i, [number[g] for g in s]] = 1
    size, links, label = whole.sum(axis=1), np.zeros(len(sets), int), np.arange(len(sets))
    like = []
    for a in range(0, len(sets), 1000):
        shared = whole[a : a + 1000] @ whole.T
        near_ = shared >= threshold * (size[a : a + 1000, None] + size[None, :] - shared) - 1e-4
        links[a : a + 1000] = near_.sum(axis=1) - 1
        like.append(near_)
    while True:
        least = np.concatenate([np.where(x, label[None, :], len(sets)).min(axis=1) for x in like])
        if (least == label).all():
            return links, label
        label = least


@pytest.fixture(scope="module")
def large():
    texts = many_variants(10_000)
    return texts, *dense_links(texts)


@pytest.mark.parametrize("partitions", [1, 16, 64])
def test_large_group_agrees_with_brute_force(spark, large, partitions):
    texts, links, label = large
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(partitions)
        got = {r.doc_id: (r.class_id, r.n_links) for r in near.classes(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(set(texts)) > 5000
    assert got == {i: (int(label[i]), int(links[i])) for i in range(len(texts))}


def test_probes_find_every_similar_set(spark):
    whole = dict(enumerate(many_variants(60, seed=1) + many_variants(40, seed=2) + ["", "a b", "a b c"]))
    links, _ = brute_links({i: shingles(t) for i, t in whole.items()})
    docs = spark.createDataFrame([(i, t) for i, t in whole.items()], "id bigint, text string")
    against = near.probes(docs, 30)
    rows = near.signatures(docs, "text", ["id"], against).collect()
    number = {fp: i for i, fp in enumerate(against.fps)}
    found = {r.id: len(r.alike or []) for r in rows}
    probed = [r for r in rows if r.fp is not None and bytes(r.fp) in number]
    assert 0 < len(probed) <= 2 * len(against.fps)
    for r in probed:
        n = number[bytes(r.fp)]
        assert sum(n in (x.alike or []) for x in rows) == links[r.id] + 1
    assert found[100] == 0


def test_prefixes_are_shortened_until_the_recall_is_measured(spark, monkeypatch):
    """A forest whose expected recall is misjudged: only the measured one makes it go on."""
    texts = many_variants(40, seed=3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    depths = []
    meet = near.meet
    monkeypatch.setattr(near, "depth_for", lambda *_: near.DEPTH)
    monkeypatch.setattr(near, "meet", lambda rows, depth, width: depths.append(depth) or meet(rows.where("false") if depth > 5 else rows, depth, width))
    links, find = brute_links({i: shingles(t) for i, t in enumerate(texts)})
    got = near.classes(df).collect()
    assert depths == [7, 6, 5] and all(r.class_id == find(r.doc_id) and r.n_links == links[r.doc_id] for r in got)


def test_rows_are_united_from_the_longest_matches_down():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(2, 60))
        keys = np.zeros((n, 1 + 2 * near.DEPTH), np.uint8)
        keys[:, 1::2] = rng.integers(0, 2, (n, near.DEPTH))
        keys = keys[np.lexsort(keys.T[::-1])]
        sketch = rng.integers(0, 256, (4, near._N // 8), dtype=np.uint8)[rng.integers(0, 4, n)]
        got = near._unite(keys, sketch, 5)
        for i in range(n):
            for j in range(i):
                if (keys[i, :11] == keys[j, :11]).all() and (sketch[i] == sketch[j]).all():
                    assert got[i] == got[j]
                if got[i] == got[j]:
                    assert (keys[i, :11] == keys[j, :11]).all()
