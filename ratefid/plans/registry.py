"""All queries of the engine by name, with the DuckDB SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sql import with_base

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_BODIES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; ``sql`` may use the base tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            _BODIES[f.__name__] = sql
        return f

    return add


def oracles() -> dict[str, str]:
    return {name: with_base(body) for name, body in _BODIES.items()}


def load() -> None:
    from . import evaluate_queries, frontier_queries, more_queries, policy_queries, queries_base, split_queries, statistics_queries, tail_queries, text_queries, trajectory_queries, order_queries, policy_replay_queries, input_queries, evidence_queries, bootstrap_queries, example_queries, answer_queries  # noqa: F401
