"""All queries of this subpackage."""

from __future__ import annotations

from . import corpus_encoding, mixing, quantile_sketch, rank_fusion, split_overlap, top_n, truncation

MODULES = (top_n, split_overlap, rank_fusion, quantile_sketch, corpus_encoding, mixing, truncation)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
