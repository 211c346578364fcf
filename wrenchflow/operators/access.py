"""Row access (P12): one policy table, compiled to equi-joins of a whole table with all principals.

A rule says which rows of a table a role may see: all of them, those on a path of
keys that ends at the principal's user id, or those that anyone may see.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchflow.sources.tables import Garage


@dataclass(frozen=True)
class Rule:
    """``path`` leads from a column of the row to a user id: (table, its key, the column to go on with)."""

    table: str
    roles: tuple[str, ...]
    scope: str
    column: str | None = None
    path: tuple[tuple[str, str, str], ...] = ()
    only: str | None = None


_OFFICE = ("admin", "staff")
_CUSTOMER, _MECHANIC = ("customers", "id", "user_id"), ("mechanics", "id", "user_id")

POLICY = [
    Rule("bookings", (*_OFFICE, "owner"), "all"),
    Rule("bookings", ("customer",), "own", "customer_id", (_CUSTOMER,)),
    Rule("bookings", ("mechanic",), "assigned", "mechanic_id", (_MECHANIC,)),
    Rule("vehicles", _OFFICE, "all"),
    Rule("vehicles", ("customer",), "own", "customer_id", (_CUSTOMER,)),
    Rule("field_notes", _OFFICE, "all"),
    Rule("field_notes", ("mechanic",), "assigned", "booking_id", (("bookings", "id", "mechanic_id"), _MECHANIC)),
    Rule("field_notes", ("mechanic",), "author", "mechanic_id", (_MECHANIC,)),
    Rule("testimonials", (), "public", only="approved"),
    Rule("testimonials", _OFFICE, "all"),
    Rule("testimonials", ("customer",), "own", "customer_id", (_CUSTOMER,), "not approved"),
    Rule("users", _OFFICE, "all"),
    Rule("users", ("mechanic", "customer", "owner"), "self", "id"),
]


def _reached(g: Garage, rule: Rule, rows: DataFrame) -> DataFrame:
    """``rows`` with ``_user``, the user id at the end of the rule's path; rows that lead nowhere go."""
    rows = rows.withColumn("_user", F.col(rule.column))
    for table, key, onward in rule.path:
        step = getattr(g, table).select(F.col(key).alias("_k"), F.col(onward).alias("_n"))
        rows = rows.join(step, F.col("_user") == F.col("_k")).withColumn("_user", F.col("_n")).drop("_k", "_n")
    return rows


def visible_rows(g: Garage, table: str, principals: DataFrame | None = None) -> DataFrame:
    """``user_id, role, row_id, scope`` of a whole table for every principal (user_id, role; default all users).

    A role that sees everything gives one row per principal with a null ``row_id``, and
    rows that anyone may see one row each with a null ``user_id``: no product of
    principals and rows.  All else are equi-joins on keys.
    """
    p = principals if principals is not None else g.users.select(F.col("id").alias("user_id"), "role")
    frame = getattr(g, table)
    kind, parts = frame.schema["id"].dataType, []
    out = ("user_id", "role", "row_id", "scope")
    for rule in (r for r in POLICY if r.table == table):
        rows, scope = frame.where(rule.only) if rule.only else frame, F.lit(rule.scope).alias("scope")
        who = p.where(F.col("role").isin(*rule.roles))
        if not rule.roles:
            parts.append(rows.select(F.lit(None).cast(p.schema["user_id"].dataType).alias("user_id"),
                                     F.lit(None).cast("string").alias("role"), F.col("id").alias("row_id"), scope))
        elif rule.column is None:
            parts.append(who.select("user_id", "role", F.lit(None).cast(kind).alias("row_id"), scope))
        else:
            seen = _reached(g, rule, rows.select("id", rule.column)).select(F.col("id").alias("row_id"), "_user")
            parts.append(who.join(seen, F.col("user_id") == F.col("_user")).select("user_id", "role", "row_id", scope))
    return reduce(DataFrame.unionByName, parts).select(*out)


def rows_seen_by(g: Garage, table: str, role: str, user_id: int | None) -> DataFrame:
    """P12 for one principal: the rows of the table it may see, each once; ``user_id`` None is an anonymous caller."""
    frame = getattr(g, table)
    rules = [r for r in POLICY if r.table == table and (not r.roles or role in r.roles)]
    if any(r.roles and r.column is None for r in rules):
        return frame
    kept = [(frame.where(r.only) if r.only else frame) if not r.roles else
            _reached(g, r, (frame.where(r.only) if r.only else frame).select("id", r.column)).where(F.col("_user") == F.lit(user_id))
            for r in rules]
    if not kept:
        return frame.limit(0)
    ids = reduce(DataFrame.union, [k.select(F.col("id").alias("_seen")) for k in kept]).distinct()
    return frame.join(ids, F.col("id") == F.col("_seen"), "left_semi")
