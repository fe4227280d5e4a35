"""Deep pages of a total order without sorting what lies before them, and pages that go on from a row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import require
from millrace.operators.runs import page
from millrace.session import stored

#: Rows that may be sorted for a page; ranges that a search for the page tells apart at a time; rows that mark their ends.
RANGE_ROWS, RANGES, MARKS = 100_000, 32, 1024


def _keys(order: Sequence[str]) -> list[tuple[str, bool]]:
    """(name, descending) of orders "name" or "name desc"; nulls come first, or last where it descends, as Spark sorts."""
    return [(name, way.lower() == "desc") for name, _, way in (o.strip().partition(" ") for o in order)]


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [F.desc(name) if down else F.asc(name) for name, down in _keys(order)]


def precedes(order: Sequence[str], mark: Sequence[Any], rows: DataFrame, or_is: bool = False) -> Column:
    """Whether a row comes before one with the values mark in the order (or has just these)."""

    def first(name: str, down: bool, value: Any) -> Column:
        col, at = F.col(name), F.lit(value).cast(rows.schema[name].dataType)
        if value is None:
            return col.isNotNull() if down else F.lit(False)
        if value != value:  # NaN comes after all numbers
            return F.lit(False) if down else col.isNull() | ~F.isnan(col)
        above = (col > at) | F.isnan(col) if isinstance(value, float) else col > at  # statistics of cached columns leave NaN out
        return F.coalesce(above, F.lit(False)) if down else col.isNull() | (col < at)

    def same(name: str, value: Any) -> Column:
        col = F.col(name)
        return F.coalesce(F.isnan(col), F.lit(False)) if value != value else col.eqNullSafe(F.lit(value).cast(rows.schema[name].dataType))

    keyed = list(zip(_keys(order), mark, strict=True))
    return reduce(lambda later, k: first(*k[0], k[1]) | (same(k[0][0], k[1]) & later), reversed(keyed), F.lit(or_is))


def page_after(rows: DataFrame, order: Sequence[str], after: Sequence[Any], limit: int, max_limit: int = 100) -> DataFrame:
    """The page that follows a row with the values after: what comes before it is filtered away, not sorted."""
    require(1 <= limit <= max_limit and len(after) == len(order), "VECTOR_SEARCH_FAILED", f"limit must be 1 to {max_limit}, after a value for each order")
    return rows.where(~precedes(order, after, rows, or_is=True)).orderBy(*sort_columns(order)).limit(limit)


def page_range(rows: DataFrame, order: Sequence[str], limit: int, offset: int, most: int = RANGE_ROWS) -> tuple[DataFrame, int, int]:
    """(rows of a range that holds the page, rows before the range, all rows).

    The order's values of some rows, chosen by a hash, part the rows into ranges; one aggregate counts what lies before each
    mark. The range around the page is parted again until it has at most so many rows (or rows that are equal in the
    order). Marks only steer: whichever they are, the range and the count before it are exact. Computes the order's columns once,
    reads what that stores a few times, and moves a row of counts a task.
    """
    names = [name for name, _ in _keys(order)]
    keys, before, total = stored(rows.select(*names), "page-keys"), 0, None
    wanted = keys.select(*rows.columns) if set(rows.columns) == set(names) else rows
    within = F.lit(True)
    level = 0
    while True:
        held = keys.where(within)
        marks = held.orderBy(F.xxhash64(*names, F.lit(level))).limit(MARKS).distinct().orderBy(*sort_columns(order)).collect()
        marks = marks[:: max(1, len(marks) // RANGES)]
        told = held.agg(F.count("*").alias("n"), *[F.count_if(precedes(order, m, rows)).alias(f"m{i}") for i, m in enumerate(marks)]).first()
        total = told.n if total is None else total
        lows = [(told[f"m{i}"], m) for i, m in enumerate(marks) if before + told[f"m{i}"] <= offset]
        highs = [(told[f"m{i}"], m) for i, m in enumerate(marks) if before + told[f"m{i}"] >= offset + limit]
        (low, start), (high, end) = (lows[-1] if lows else (0, None)), (highs[0] if highs else (told.n, None))
        if start is not None:
            within = within & ~precedes(order, start, rows)
        if end is not None:
            within = within & precedes(order, end, rows)
        before += low
        if high - low <= most or high - low == told.n:
            return wanted.where(within), before, total
        level += 1


def deep_page(rows: DataFrame, order: Sequence[str], limit: int, offset: int = 0, max_limit: int = 100, most: int = RANGE_ROWS) -> DataFrame:
    """A page of rows in a total order, each with the number of all rows, as page() gives it, whatever the offset: beyond most rows
    only a range around the page is sorted. order: "name" or "name desc"."""
    if offset + limit <= most:
        return page(rows, sort_columns(order), limit, offset, max_limit)
    require(1 <= limit <= max_limit, "VECTOR_SEARCH_FAILED", f"limit must be 1 to {max_limit}, offset at least 0")
    found, before, total = page_range(rows, order, limit, offset, most)
    return found.orderBy(*sort_columns(order)).offset(offset - before).limit(limit).withColumn("total", F.lit(total).cast("long"))
