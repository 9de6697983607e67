"""All queries of the library with their SQL equivalents."""

from __future__ import annotations

from sluice.plans import fields, intake, lifecycle, pages
from sluice.plans.binding import Query

BOOKS = (lifecycle.BOOK, intake.BOOK, pages.BOOK, fields.BOOK)


def queries() -> dict[str, Query]:
    return {name: f for book in BOOKS for name, f in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.oracles.items()}
