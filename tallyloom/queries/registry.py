"""All queries outside the optional subpackages."""

from __future__ import annotations

from . import evaluation, p1_nested, p2_drift, p3_differences, streams_and_sinks, streams_of_records

MODULES = (evaluation, p1_nested, p2_drift, p3_differences, streams_and_sinks, streams_of_records)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
