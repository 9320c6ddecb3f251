"""Registered queries over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from logitblend.workload import blending, prompting, records, scoring, storage, texts

_MODULES = (blending, texts, prompting, scoring, storage, records)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
