"""Disclosure against brute force, words that disclose each kind, single entities, generalisation, joins beyond a block."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfspark.llm import pii

KIND_WORDS = {"email": "mailto", "ip": "host", "card": "visa", "phone": "tel", "secret": "apikey"}


def digits14(rng):
    while True:
        d = "".join(rng.choices("0123456789", k=16))
        if pii.luhn(d):
            return d


def corpus(seed=1, n=120, copies=0):
    """Prose, with a telling word somewhere before each kind of entity."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k))
    made = {
        "email": lambda: f"u{rng.randrange(10**6)}@ex{rng.randrange(99)}.org", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": lambda: digits14(rng),
        "phone": lambda: f"+1 555 {rng.randrange(10**7):07d}", "secret": lambda: "".join(rng.choices("0123456789abcdef", k=39)) + "7",
    }
    rows = []
    for _ in range(n):
        kind = rng.choice(list(made))
        rows.append(f"{prose(30)} {KIND_WORDS[kind]}: {prose(rng.randrange(0, 4))} {made[kind]()} {prose(30)}")
    rows += [prose(60) for _ in range(n)]
    return rows + rows[:1] * copies


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")


def test_each_kind_has_its_disclosing_word(spark):
    rows = corpus()
    found = pii.disclosing(frame(spark, rows)).collect()
    h = {w: int(pii.terms_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[3][0]) for w in KIND_WORDS.values()}
    told = {r.term: pii.KINDS[r.kind] for r in found}
    assert told == {h[w]: k for k, w in KIND_WORDS.items()}
    spans = {r.doc_id: [(pii.KINDS[s.kind], rows[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find(frame(spark, rows)).collect()}
    assert all({k for k, _ in spans[i]} >= {"term"} and {x for k, x in spans[i] if k == "term"} <= set(KIND_WORDS.values()) for i in range(120))
    assert all(not spans[i] for i in range(120, 240))


def test_disclosure_against_brute_force(spark):
    rows = corpus(seed=5, n=60)
    strip = lambda w: w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
    counts, near, different, totals, everything = Counter(), Counter(), defaultdict(set), Counter(), 0
    for t in rows:
        spans = pii.base_spans(t)
        words = [(m.start(), m.end(), strip(m[0])) for m in re.finditer(r"\S+", t)]
        words = [w for w in words if w[2]]
        everything += len(words)
        counts.update(w for _, _, w in words)
        for a, k, b in spans:
            free = [not any(x < d and c < y for c, _, d in spans) for x, y, _ in words]
            i = sum(y <= a for _, y, _ in words)
            j = sum(x < b for x, _, _ in words)
            for side, at in ((0, range(max(0, i - pii.WINDOW), i)), (1, range(j, min(len(words), j + pii.WINDOW)))):
                for w in at:
                    if free[w]:
                        near[words[w][2], k, side] += 1
                        different[words[w][2], k, side].add(t[a:b])
                        totals[k, side] += 1
    tried = sum(len(x) >= 2 for x in different.values())
    want = {}
    for (w, k, side), n in near.items():
        m, base, given = len(different[w, k, side]), totals[k, side] / everything, n / counts[w]
        if m >= 2 and given > base and m * math.log(given / base) >= math.log(tried / pii.CHANCE):
            share = 1 + math.log(given) / -math.log(base)
            if share >= pii.DISCLOSURE:
                want[w] = max(want.get(w, (0, 0)), (share, k))
    got = {r.term: (r.share, r.kind) for r in pii.disclosing(frame(spark, rows)).collect()}
    h = lambda w: int(pii.terms_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[3][0])
    assert want and {h(w) for w in want} == set(got)
    assert all(got[h(w)][1] == k and abs(got[h(w)][0] - s) < 1e-9 for w, (s, k) in want.items())


def test_copies_prove_nothing(spark):
    """A document copied hundreds of times, with a few words changed in some, tells of no single entity."""
    rng = random.Random(2)
    rows = corpus(seed=2, n=40)
    base = rows[0].split()
    for _ in range(300):
        t = list(base)
        t[rng.randrange(10)] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(t))
    terms = {r.term for r in pii.disclosing(frame(spark, rows)).collect()}
    known = {int(pii.terms_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[3][0]) for w in KIND_WORDS.values()}
    assert terms <= known


def test_a_word_that_keeps_coming_back_beside_one_entity(spark):
    rng = random.Random(3)
    rows = corpus(seed=3, n=60)
    rows += [f"{' '.join(rng.choices([f'w{i}' for i in range(300)], k=20))} Zaphod {rng.choice(['', 'w1 '])}zb@heart.example.org {' '.join(rng.choices([f'w{i}' for i in range(300)], k=20))}" for _ in range(8)]
    clean = [r.text for r in pii.sanitised(frame(spark, rows)).collect()]
    assert not any("Zaphod" in t or "zb@heart" in t for t in clean)


def test_generalisation_discloses_less(spark):
    clean = " ".join(r.text for r in pii.sanitised(frame(spark, corpus())).collect())
    assert not any(f" {w}:" in clean for w in KIND_WORDS.values())
    labels = set(re.findall(r"\[[A-Z]+ TERM\]", clean))
    assert labels <= {"[CONTACT TERM]", "[PERSONAL TERM]"} and all(f"[{k.upper()} TERM]" not in clean for k in ("email", "phone"))


def test_more_words_than_a_block(spark, monkeypatch):
    df = frame(spark, corpus(copies=50))
    want = sorted((r.doc_id, r.spans) for r in pii.find(df).collect())
    monkeypatch.setattr(pii, "BLOCK", 0)
    assert sorted((r.doc_id, r.spans) for r in pii.find(df).collect()) == want


@pytest.mark.parametrize("secret", ["AKIA" + "AB12" * 4, "ghp_" + "aB3" * 12, "A1" * 16, "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4", "xoxb-1234567890-abc"])
def test_secrets_by_form(secret):
    assert [(a, pii.KINDS[k], b) for a, k, b in pii.base_spans(f"see {secret} here") if k == 4] == [(4, "secret", 4 + len(secret))]


def test_long_text_full_of_entities(spark):
    rows = corpus(seed=7, n=60)
    long = " ".join(f"tel: +1 555 {i:07d} and visa" for i in range(40_000))
    terms = pii.disclosing(frame(spark, rows))
    began = time.time()
    got = pii.find(frame(spark, [long, "", None]), terms=terms).collect()
    assert time.time() - began < 30 and sum(s.kind == 3 for s in got[0].spans) == 40_000 and not got[1].spans and not got[2].spans


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd", 7, "x")], "doc_id bigint, text string, spans int, clean string")
    out = pii.find(df)
    assert sorted(out.columns) == ["clean", "doc_id", "spans", "text"] and len(out.first().spans) == 1
    assert pii.sanitised(df).columns == df.columns and pii.sanitised(df).first().clean == "x"
    assert pii.find(df.where("false")).count() == 0
