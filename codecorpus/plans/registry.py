"""All registered queries and their DuckDB oracle SQL."""

from __future__ import annotations

from . import evaluation, judging, listings, normalise, storage, training

_MODULES = [evaluation, normalise, listings, judging, training, storage]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
