"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetloom.plans import adapters

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, tables: tuple[str, ...] = (), sql: str | None = None) -> Callable:
    """Register a query; ``tables`` are the adapters its SQL reads, ``sql`` what follows.

    ``sql`` starts with SELECT or with ", name AS (...)" to add further CTEs.
    """

    def add(make: Query) -> Query:
        QUERIES[name] = make
        if sql is not None:
            recursive = "WITH RECURSIVE" if "FROM fired WHERE" in sql else "WITH"
            head = adapters.with_sql(*tables) if tables else ""
            body = sql.strip()
            if not tables and body.startswith(","):
                head, body = "WITH", body[1:]
            SQL[name] = f"{head}\n{body}".strip().replace("WITH", recursive, 1)
        return make

    return add


def load() -> None:
    """Import the modules that register queries."""
    from packetloom.plans import (  # noqa: F401
        content_queries, intel_queries, log_queries, ml_queries, packet_queries,
        score_queries, store_queries, stream_queries,
    )
