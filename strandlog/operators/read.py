"""Reads over a live table: get, find, scan, count, pages, ranges, top-k, navigation.

Equality on a lookup compares text forms, so a text key "1" meets an integer 1. Where a
key is the canonical text of a typed value the filter is typed, and Parquet gets it; other
keys can meet nothing.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.text import float_text, key_text
from ..schema import INT_MAX, INT_MIN, Table

MAX_LIMIT, DEFAULT_LIMIT = 1000, 100


def matches(table: Table, field: str, key: Any) -> Column:
    """``field`` holds ``key``, compared by text form."""
    kind, text, c = table.kind(field), key_text(key), F.col(field)
    never = F.lit(False)
    if kind in ("id", "text"):
        return c == F.lit(text)
    if kind == "bool":
        return c == F.lit(text == "true") if text in ("true", "false") else never
    if kind == "int":
        try:
            n = int(text)
        except ValueError:
            return never
        return c == F.lit(n).cast("long") if str(n) == text and INT_MIN <= n <= INT_MAX else never
    try:
        x = float(text)
    except ValueError:
        return never
    if float_text(x) != text:
        return never
    if x == 0:  # the typed comparison takes -0.0 for 0.0
        negative = c.cast("string").startswith("-")
        return (c == F.lit(0.0)) & (negative if math.copysign(1, x) < 0 else ~negative)
    return F.isnan(c) if math.isnan(x) else c == F.lit(x)


def get(live: DataFrame, table: Table, field: str, key: Any) -> DataFrame:
    """No row or one, by id or a unique lookup."""
    if not table.lookup(field).unique:
        raise PlanError(f"{table.name}.{field} is no unique lookup")
    return live.filter(matches(table, field, key)).limit(1)


def find(live: DataFrame, table: Table, field: str, key: Any) -> DataFrame:
    """All rows under a declared lookup, by id ascending."""
    table.lookup(field)
    return live.filter(matches(table, field, key)).orderBy("id")


def scan(live: DataFrame) -> DataFrame:
    return live.orderBy("id")


def count(live: DataFrame, table: Table | None = None, field: str | None = None, key: Any = None) -> DataFrame:
    """One row with ``n``."""
    if field is not None:
        table.lookup(field)
        live = live.filter(matches(table, field, key))
    return live.agg(F.count(F.lit(1)).alias("n"))


def cardinality(live: DataFrame, table: Table, field: str) -> DataFrame:
    """(key, n) of a declared lookup."""
    from ..functions.text import value_text

    table.lookup(field)
    return live.groupBy(value_text(F.col(field), table.kind(field)).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def checked_limit(limit: int | None) -> int:
    limit = DEFAULT_LIMIT if limit is None else limit
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MAX_LIMIT:
        raise PlanError(f"limit must be 1 to {MAX_LIMIT}, not {limit!r}")
    return limit


def checked_cursor(cursor: str | None) -> int:
    if not cursor:
        return 0
    text = cursor[1:] if cursor[:1] == "+" else cursor
    if not (text.isascii() and text.isdigit()):
        raise PlanError(f"cursor {cursor!r} is no offset")
    return int(text)


def next_cursor(offset: int, limit: int, total: int) -> str | None:
    return str(offset + limit) if offset + limit < total else None


def page(rows: DataFrame, limit: int | None = None, cursor: str | None = None, key: str = "id") -> DataFrame:
    """One page by id: TakeOrderedAndProject, no full sort."""
    return rows.orderBy(key).offset(checked_cursor(cursor)).limit(checked_limit(limit))


def page_after(rows: DataFrame, last: Any, limit: int | None = None, key: str = "id") -> DataFrame:
    """The page after the row with key ``last``, at a cost that does not grow with the offset."""
    if last is not None:
        rows = rows.filter(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(checked_limit(limit))


def between(live: DataFrame, table: Table, field: str, gte: Any = None, lt: Any = None, gt: Any = None, lte: Any = None) -> DataFrame:
    """Rows whose lookup lies in a range, in the field's own order, then by id."""
    table.lookup(field)
    c = F.col(field)
    for bound, keep in ((gte, lambda v: c >= v), (lt, lambda v: c < v), (gt, lambda v: c > v), (lte, lambda v: c <= v)):
        if bound is not None:
            live = live.filter(keep(F.lit(bound)))
    return live.orderBy(field, "id")


def top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows in an order; ties by id."""
    return rows.orderBy(*order, "id").limit(k)


def children(parents: DataFrame, rows: DataFrame, key: str, parent_id: str = "id") -> DataFrame:
    """Rows joined to the parent their ``key`` names."""
    return rows.join(parents.withColumnRenamed(parent_id, key), key)


def contains(live: DataFrame, field: str, needle: str) -> DataFrame:
    """Rows whose text holds ``needle``."""
    return live.filter(F.col(field).contains(needle))
