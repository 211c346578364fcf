"""Report and insight date ranges (E7-E9), computed from typed parameters.

These are scalar parameter computations (no data), so plain Python dates are
used; the results become literals in the Spark plan, which lets Parquet
statistics and partition pruning skip whole files.
"""

from __future__ import annotations

import calendar
import datetime as dt

from wrenchflow.model import INSIGHT_RANGES, REPORT_TYPES


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def add_months(d: dt.date, months: int) -> dt.date:
    """Calendar month shift that clamps to the month end (Spark ``add_months``)."""
    m = d.month - 1 + months
    y, m = d.year + m // 12, m % 12 + 1
    return dt.date(y, m, min(d.day, calendar.monthrange(y, m)[1]))


def report_range(report_type: str, on) -> tuple[dt.date, dt.date]:
    """Bounds of a daily / weekly (Mon-Sun) / monthly / yearly report.

    Fix of T16/T17: the week is the Monday-to-Sunday week containing the
    date, computed on pure dates (no local-time conversion).
    """
    d = as_date(on)
    if report_type not in REPORT_TYPES:
        raise ValueError(f"report_type must be one of {REPORT_TYPES}")
    if report_type == "daily":
        return d, d
    if report_type == "weekly":
        start = d - dt.timedelta(days=d.weekday())
        return start, start + dt.timedelta(days=6)
    if report_type == "monthly":
        return d.replace(day=1), d.replace(day=calendar.monthrange(d.year, d.month)[1])
    return dt.date(d.year, 1, 1), dt.date(d.year, 12, 31)


def insight_range(range_name: str, as_of) -> tuple[dt.date, dt.date, dt.date, dt.date]:
    """(start, end, previous start, previous end) for month/quarter/year.

    Current period = [as_of - span, as_of]; previous = both bounds shifted
    back one span, so the two share a boundary day (T18, reproduced).
    Unknown ranges are rejected (the reference silently left them unshifted).
    """
    if range_name not in INSIGHT_RANGES:
        raise ValueError(f"range must be one of {INSIGHT_RANGES}")
    months = {"month": 1, "quarter": 3, "year": 12}[range_name]
    end = as_date(as_of)
    start = add_months(end, -months)
    return start, end, add_months(start, -months), add_months(end, -months)


def week_bounds_sunday(as_of) -> tuple[dt.date, dt.date]:
    """Sunday..Saturday week containing ``as_of``."""
    d = as_date(as_of)
    start = d - dt.timedelta(days=(d.weekday() + 1) % 7)
    return start, start + dt.timedelta(days=6)


def default_revenue_window(as_of) -> tuple[dt.date, dt.date]:
    """A12 default: the last 12 months up to ``as_of``."""
    end = as_date(as_of)
    return add_months(end, -12), end
