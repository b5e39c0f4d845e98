"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from . import durable, graphs, hooks, identifiers, merges, naming, nesting, reports, segments, stages, statistics, statutes, streams, temporal, texts, unify, vectors  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
