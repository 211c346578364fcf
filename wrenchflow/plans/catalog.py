"""Catalogue of registered queries: each a Spark plan plus its DuckDB oracle.

A query is a function ``Garage -> DataFrame`` over the shop tables.  The
driver-facing callable binds the shop tables from the driver's parquet
folder (``sources.binding``), runs the operator and presents the result as
JSON-style scalars (the reference answers in JSON): exact decimals become
doubles, dates ``yyyy-MM-dd`` text, timestamps ``yyyy-MM-dd HH:mm:ss`` text.
The oracle strings do the same in SQL.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchflow.session import scratch_path, written
from wrenchflow.sources.binding import JOB_TABLES, bind, with_binding
from wrenchflow.sources.tables import Garage


@dataclass
class Query:
    name: str
    build: Callable[[Garage], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator adding a ``Garage -> DataFrame`` function to the catalogue."""
    def deco(fn: Callable[[Garage], DataFrame]):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def present(df: DataFrame) -> DataFrame:
    """JSON-style scalar columns: decimal->double, date/timestamp->text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


_GARAGES: dict[tuple[str, int, str], Garage] = {}


def garage_for(spark: SparkSession, sf_dir: str) -> Garage:
    """The shop tables bound from ``sf_dir``, each materialised once per session when first used.

    Production reads stored shop tables (``load_tables``); here a table of the
    binding is written as Parquet under the session's shared checkpoint
    folder by the first query that uses it, and later queries read those
    files, so queries neither re-derive the binding nor carry its lineage.
    Each file of bookings is sorted by date so date predicates skip its
    other pages (Parquet's column index).
    """
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    cached = _GARAGES.get(key)
    if cached is None or cached.bookings.sparkSession is not spark:
        path = scratch_path(spark, f"garage/{uuid.uuid4().hex}")
        _GARAGES[key] = StoredGarage(bind(spark, sf_dir), path, lambda: bind(spark, sf_dir, f"{path}/jobs"))
    return _GARAGES[key]


class StoredGarage(Garage):
    """A bound garage whose tables are written under ``path`` one by one, at first use.

    Tables made of job rows come from ``with_jobs()``, which writes those rows once for all of them.
    """

    def __init__(self, bound: Garage, path: str, with_jobs: Callable[[], Garage]):
        self._bound, self._path, self._stored, self._with_jobs = bound, path, {}, with_jobs

    def __getattribute__(self, name: str):
        if name not in Garage.__dataclass_fields__:
            return object.__getattribute__(self, name)
        if name not in self._stored:
            if name in JOB_TABLES and self._with_jobs:
                self._jobs_bound = self._with_jobs()
                self._with_jobs = None
            bound = self._jobs_bound if name in JOB_TABLES else self._bound
            self._stored[name] = written(getattr(bound, name), f"{self._path}/{name}")
        return self._stored[name]


def spark_callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(q.build(garage_for(spark, sf_dir)))
    run.__name__ = q.name
    run.__doc__ = q.doc
    return run


def load_all() -> dict[str, Query]:
    """Import the modules that register queries; return the catalogue."""
    from wrenchflow.plans import batch_queries, queries  # noqa: F401  (register on import)
    return REGISTRY


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: spark_callable(q) for n, q in load_all().items()}


def oracle_queries() -> dict[str, str]:
    return {n: with_binding(q.sql) for n, q in load_all().items() if q.sql}
