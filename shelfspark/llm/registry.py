"""The queries of this subpackage and their SQL."""

from shelfspark.llm import bpe, clusters, fingerprints, flac, html_text, licenses, mixing, near, pii, quality, sessions, sharding, toxicity

MODULES = (bpe, flac, sharding, mixing, quality, near, html_text, licenses, pii, toxicity, sessions, clusters, fingerprints)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
