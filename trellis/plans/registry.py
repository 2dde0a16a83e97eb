"""Registry of named queries and their SQL oracles.

A query is a callable ``(spark, sf_dir) -> DataFrame``; its oracle is an
ANSI/DuckDB SQL string over the provided tables, or absent when the
operator is not SQL-expressible (then only row counts are compared).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, Callable[[], str]] = {}


def register(name: str, sql: Callable[[], str] | str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql if callable(sql) else (lambda s=sql: s)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from trellis.plans import (  # noqa: F401
        rollups,
        tree_queries,
        read_queries,
        summary_queries,
        state_queries,
        ops_queries,
        stream_queries,
        source_queries,
        store_queries,
    )


def all_queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    load_all()
    return {k: v() for k, v in ORACLE.items()}
