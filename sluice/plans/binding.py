"""How queries are named and paired with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from sluice.sources.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]


def case_sql(names: Iterable[str]) -> str:
    """Rows (name, place) for a VALUES list."""
    return ", ".join(f"('{n}', {i})" for i, n in enumerate(names))


class Book:
    """Queries by name, with SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, blank: tuple[str, ...] = ()):
        """Register a query under its function's name; null is read as '' in the columns named in `blank`."""

        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                text = with_views(sql)
                if blank:
                    text = f"SELECT * REPLACE ({', '.join(f"coalesce({c}, '') AS {c}" for c in blank)}) FROM ({text})"
                self.oracles[f.__name__] = text
            return f

        return keep
