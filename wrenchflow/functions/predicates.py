"""Filters and predicates.

Predicates are plain ``Column`` expressions so Catalyst pushes them into the
Parquet scan (``PushedFilters``) and prunes partitions of the bookings table.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Date = str | dt.date


def _d(value: Date) -> Column:
    return F.lit(str(value)).cast("date")


def last_n_days(col: str, n: int, as_of: Date) -> Column:
    """``col >= as_of - n days`` with no upper bound (T14: future rows count)."""
    return F.col(col) >= F.date_sub(_d(as_of), int(n))


def period_to_date(col: str, unit: str, as_of: Date) -> Column:
    """From the start of ``as_of``'s month or year (no upper bound)."""
    if unit not in ("month", "year"):
        raise ValueError(f"unit must be month or year, not {unit!r}")
    return F.col(col) >= F.trunc(_d(as_of), unit)


def between_dates(col: str, start: Date, end: Date, inclusive_day: bool = True) -> Column:
    """P10: inclusive date range.

    For a timestamp column PostgreSQL's ``ts BETWEEN d1 AND d2`` stops at
    midnight of ``d2`` (T13); ``inclusive_day=True`` (default) keeps the whole
    last day (``ts < d2 + 1``).
    """
    c = F.col(col)
    if inclusive_day:
        return (c >= _d(start)) & (c < F.date_add(_d(end), 1))
    return c.between(_d(start), _d(end))


def contains_ci(cols: list[str], term: str, literal: bool = False) -> Column:
    """Case-insensitive substring on any of ``cols`` (``ILIKE '%term%'``, T11).

    ``literal=True`` escapes ``%`` and ``_`` so they match themselves.
    """
    if literal:
        term = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    pattern = f"%{term}%"
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in cols])


def fold(preds: list[Column | None]) -> Column:
    """AND of the non-None predicates (TRUE when none)."""
    live = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, live) if live else F.lit(True)


def filter_bookings(df: DataFrame, status: str | None = None, date: Date | None = None,
                    mechanic_id: int | None = None, term: str | None = None,
                    name_cols: tuple[str, ...] = ("customer_name", "service_name")) -> DataFrame:
    """Optional AND-ed predicates; ``status='all'`` means no status filter."""
    return df.where(fold([
        F.col("status") == status if status and status != "all" else None,
        F.col("booking_date") == _d(date) if date else None,
        F.col("mechanic_id") == F.lit(mechanic_id) if mechanic_id is not None else None,
        contains_ci(list(name_cols), term) if term else None,
    ]))


def active_only(col: str = "status") -> Column:
    """``status = 'active'``."""
    return F.col(col) == "active"


def exclude_status(*statuses: str, col: str = "status") -> Column:
    """``status NOT IN (...)`` (NULL status excluded, as in SQL)."""
    return ~F.col(col).isin(*statuses)


def null_safe_equal(a: str | Column, b: str | Column) -> Column:
    """``a IS NOT DISTINCT FROM b``."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a.eqNullSafe(b)
