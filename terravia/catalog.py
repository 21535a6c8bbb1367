"""All queries of the engine by name, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    oracle: str | None


_ENTRIES: dict[str, Entry] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: file a query under a name, with its oracle where SQL can express it."""

    def add(query: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"two queries named {name}")
        _ENTRIES[name] = Entry(query, oracle)
        return query

    return add


def entries() -> dict[str, Entry]:
    from terravia.plans import load_all

    load_all()
    return dict(_ENTRIES)


def queries() -> dict[str, Query]:
    return {name: e.query for name, e in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.oracle for name, e in entries().items() if e.oracle}
