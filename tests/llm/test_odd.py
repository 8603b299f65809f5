"""Empty tables, clashing columns, very long texts and many sources, for operators and stages."""

import random

import pytest

import corpus_pipeline as P
import public_tokenizers
from shelfspark.llm import bpe, flac, mixing, quality, sharding

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, media string, ids string, score string, draw string, size string, bucket string, grp string, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    prose = " ".join(random.Random(1).choices([f"word{i}" for i in range(200)], k=300))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, prose, "en", "b"), (3, prose, "en", "b"), (4, prose + " tail", "en", "c"), (None, prose[::-1], None, "a"), (5, "mail me at a.b@example.org, " + prose, "de", "a"), (6, (prose + "\n") * 300, "en", "d")]
    return spark.createDataFrame([(*r, 5, "m", "i", "s", "d", "z", "b", "g", "f") for r in rows], SCHEMA)


@pytest.mark.parametrize("rows", ["all", "none"])
@pytest.mark.parametrize("stage", [s for _, s in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_on_odd_rows(spark, odd, stage, rows):
    df = odd if rows == "all" else odd.where("false")
    out = stage(spark, df, "")
    got = out.collect()
    if stage is not P.STAGES[-1][1]:
        assert out.columns == df.columns
    assert len(got) == 0 if rows == "none" else len(got) > 0
    if rows == "all" and stage is P.near_copies:
        assert sum(r.doc_id == 3 for r in got) == 1 and all(r.doc_id != 4 for r in got)
    if rows == "all" and stage is P.personal_data:
        assert len(got) == 8 and not any("a.b@example.org" in (r.text or "") for r in got)
    if rows == "all" and stage is P.mixed_sources:
        assert {r.source for r in got} <= {"a", "b", "c", "d"} and all(r.text for r in got)


def test_operators_on_empty_tables(odd):
    none = odd.where("false")
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0 and bpe.digests(none, PATH, public_tokenizers.PATTERN).count() == 0
    assert flac.decode(flac.encode(none.withColumn("payload", flac.payload()))).count() == 0
    assert sharding.shard(none, 3).count() == 0 and quality.filtered(none).count() == 0 and mixing.plan(none).count() == 0


def test_results_replace_columns_of_their_name(odd):
    out = flac.decode(flac.encode(odd.withColumn("payload", flac.payload()).withColumnRenamed("score", "feature").withColumnRenamed("draw", "pcm")))
    assert out.where("pcm <> payload OR media IS NULL").count() == 0 and len(out.columns) == len(set(out.columns))
    assert dict(bpe.encode(odd, PATH, public_tokenizers.PATTERN).dtypes)["ids"].startswith("array")


def test_targets_of_many_sources_against_brute_force(spark):
    rng = random.Random(4)
    sizes = {f"host{i:05d}": rng.choice([0, 1, 5, 50, 500, 5000]) for i in range(3000)} | {None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: (r.weight, r.target) for r in mixing.targets(df).collect()}
    names = [*sorted(k for k in sizes if k is not None), None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    clamped, total = set(), sum(sizes.values())
    while True:
        left, over = total - sum(3 * sizes[s] for s in clamped), sum(weight[s] for s in names if s not in clamped)
        more = {s for s in names if s not in clamped and 3 * sizes[s] * over <= left * weight[s]}
        if not more:
            break
        clamped |= more
    assert all(got[s] == (weight[s], 3.0 * sizes[s] if s in clamped else weight[s] * (left / over)) for s in names)
    assert 0 < len(clamped) < len(names) and abs(sum(t for _, t in got.values()) - total) < 1e-6 * total
