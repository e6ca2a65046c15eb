"""All queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import queries_ctw, queries_digest, queries_jaccard, queries_mixing, queries_quality, queries_sentencepieces, queries_sharding, queries_toxicity, queries_vptree, queries_warc

_MODULES = (queries_ctw, queries_warc, queries_vptree, queries_sentencepieces, queries_jaccard, queries_toxicity, queries_mixing, queries_quality, queries_digest, queries_sharding)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
