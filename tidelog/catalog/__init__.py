"""Registered queries: every operator over the given tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query and, when SQL can express it, the statement that must give the same rows."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load() -> None:
    """Import every module that registers queries."""
    from tidelog.catalog import (  # noqa: F401
        audit_queries,
        corpus_queries,
        fold_queries,
        join_queries,
        plan_queries,
        rank_queries,
        source_queries,
        stream_queries,
        suppression_queries,
        text_queries,
    )
