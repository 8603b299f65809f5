"""From raw documents to mixed, sanitised and tokenised training text, in five stages.

Each stage takes all that its predecessor kept, reread from Parquet, and its decisions take effect: documents that the
quality rules reject go, one document of each class of near copies stays, spans of personal data and disclosing words are
replaced, sources are repeated or thinned to their target weights, and what is left is encoded.

Odd rows, stage by stage. Null, empty and blank texts: fail the quality rules; to the others a null text is an empty one (alone in
its class, without personal data, of size 0 and so never mixed, without ids). Very long texts are worked on whole. Repeated rows: each is judged;
of equal ids or texts one row stays after the join; later stages take each row for itself. Ties (equal ids or draws) are broken by the hash of the text. A null
language or source is one of its own. An empty table gives an empty table. Columns besides doc_id, text, lang and source stay, whatever their names, up
to the last stage, which returns its own; n_chars, where there is one, is counted anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, mixing, near, pii, quality
from shelfspark.llm.common import documents, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.sanitised(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and n_bytes (of the ids decoded again) of each document."""
    both = bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_copies),
    ("pii", personal_data),
    ("mixing to target weights", mixed_sources),
    ("byte-level bpe", tokens),
]

#: SQL can express neither the join, the sanitisation nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
