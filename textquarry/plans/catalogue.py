"""All queries of the core with their SQL."""

from __future__ import annotations

from textquarry.plans import corpus, evaluation, sources_and_streams, texts

_PARTS = [corpus.R, texts.R, evaluation.R, sources_and_streams.R]
QUERIES = {k: v for r in _PARTS for k, v in r.queries.items()}
SQL = {k: v for r in _PARTS for k, v in r.sql.items()}
