"""Scalar column expressions (E1-E14 and the type rules T1-T23).

All helpers return ``Column`` objects built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenchflow.model import DEFAULT_DURATION_MIN, TAX_RATE_HISTORY


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- rounding, numbers, text defaults ------------------------------------

def round_half_up(c: str | Column, digits: int = 0) -> Column:
    """JavaScript ``Math.round`` semantics (T9): .5 goes toward +infinity.

    ``floor(x * 10^d + 0.5) / 10^d`` in double arithmetic; identical bits in
    any IEEE engine, unlike decimal-string rounding.
    """
    scale = 10 ** digits
    out = F.floor(_c(c).cast("double") * scale + 0.5)
    return (out / scale) if digits else out


def to_money(c: str | Column) -> Column:
    """Exact DECIMAL money to a JSON number (double)."""
    return _c(c).cast("double")


def falsy_default(c: str | Column, default) -> Column:
    """JavaScript ``a || 'x'`` (T10): NULL and '' both take the default."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def coerce_bool(c: str | Column) -> Column:
    """E12: 'true'/true -> true, anything else -> false."""
    return F.coalesce(F.lower(_c(c).cast("string")) == "true", F.lit(False))


def coerce_number(c: str | Column, default=0) -> Column:
    """``Number(x)`` with missing or unparsable -> default."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(default).cast("double"))


def safe_ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL instead of raising on zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


# --- names, identifiers, documents ----------------------------------------

def initials(name: str | Column) -> Column:
    """First letter of each space-separated word, upper-cased, 2 chars."""
    words = F.filter(F.split(_c(name), " "), lambda w: w != "")
    firsts = F.transform(words, lambda w: F.substring(w, 1, 1))
    return F.upper(F.substring(F.array_join(firsts, ""), 1, 2))


def invoice_number(created: str | Column, payment_id: str | Column) -> Column:
    """``INV/yyyy/MM/<id>``."""
    return F.concat(F.lit("INV/"), F.date_format(_c(created), "yyyy/MM"), F.lit("/"),
                    _c(payment_id).cast("string"))


def payment_total(is_down: str | Column, down_amount: str | Column, price: str | Column) -> Column:
    """Amount due = down payment if flagged, else the full price."""
    return F.when(_c(is_down), _c(down_amount)).otherwise(_c(price))


def payment_tax(subtotal: str | Column, settled: bool) -> Column:
    """10 % tax on settled payments, 0 on pending ones."""
    rate = F.lit(TAX_RATE_HISTORY if settled else "0").cast("decimal(4,2)")
    return F.round(_c(subtotal) * rate, 2)


def service_items(service_id: str | Column, name: str | Column, price: str | Column) -> Column:
    """E5: one-element array ``[{item_id:'S'+id, name, qty:1, price, type:'service'}]``."""
    return F.array(F.struct(
        F.concat(F.lit("S"), _c(service_id).cast("string")).alias("item_id"),
        _c(name).alias("name"), F.lit(1).alias("qty"), _c(price).alias("price"),
        F.lit("service").alias("type")))


def end_min(start: str | Column, duration: str | Column) -> Column:
    """End minute = start + duration (default 60, also for a duration of 0); midnight not wrapped."""
    return _c(start) + F.coalesce(F.nullif(_c(duration), F.lit(0)), F.lit(DEFAULT_DURATION_MIN))


def hhmm(minutes: str | Column) -> Column:
    """Minute-of-day to ``HH:mm`` text."""
    m = _c(minutes)
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def parse_hhmm(text: str | Column) -> Column:
    """``HH:mm[:ss]`` text to minute-of-day; NULL when malformed."""
    t = _c(text)
    ok = t.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")
    return F.when(ok, F.substring(t, 1, 2).cast("int") * 60 + F.substring(t, 4, 2).cast("int"))


def json_diff(old: Column, new: Column) -> tuple[Column, Column]:
    """before/after images of a change as JSON text."""
    return F.to_json(old), F.to_json(new)


def weekday0(d: str | Column) -> Column:
    """Day of week with Sunday = 0 (PostgreSQL ``EXTRACT(DOW)``)."""
    return F.dayofweek(_c(d)) - 1


def stock_flag(stock: str | Column) -> Column:
    """In stock when stock > 0."""
    return _c(stock) > 0


def iso_date(d: str | Column) -> Column:
    return F.date_format(_c(d), "yyyy-MM-dd")


def hours_between(a: str | Column, b: str | Column) -> Column:
    """T5: ``EXTRACT(EPOCH FROM (b - a)) / 3600`` as double."""
    return F.timestamp_diff("SECOND", _c(a), _c(b)) / 3600.0
