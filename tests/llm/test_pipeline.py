import pytest

import corpus_pipeline as P
from shelfspark.llm import bpe, mixing, near, pii, quality


@pytest.fixture(scope="module")
def stages(spark, small):
    out = [P.documents(spark, small)]
    for name, stage in P.STAGES:
        out.append(P.materialize(stage(spark, out[-1], small), name.replace(" ", "-")))
    return out


def test_stages_are_in_order_and_keep_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality rules", "n-gram jaccard join", "pii", "mixing to target weights", "byte-level bpe"]
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_decisions_take_effect(stages):
    raw, good, single, clean, mixed, tokens = stages
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(good) == sorted(r.doc_id for r in quality.judged(raw, ("doc_id",)).where("kept").collect())
    assert ids(single) == sorted({r.class_id for r in near.classes(good).collect()})
    assert ids(clean) == ids(single) and not any(s[1] < 4 for r in clean.collect() for s in pii.base_spans(r.text))
    assert mixed.exceptAll(P._counted(mixing.mix(clean))).count() == 0
    assert tokens.count() == mixed.count() and tokens.where("n_bytes <> 0").count() == tokens.count()
    codec = bpe.Codec(bpe.read_ranks(open(P.VOCABULARY, "rb").read()), P.public_tokenizers.PATTERN)
    want = sorted(list(codec.encode(r.text)) for r in mixed.select("text").collect())
    assert sorted(r.ids for r in tokens.select("ids").collect()) == want


def test_run_agrees_with_the_stages(spark, small, stages):
    assert P.run(spark, small).exceptAll(stages[-1]).count() == 0
