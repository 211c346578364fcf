"""S1 ``load_tables``: the shop's tables as lazily read DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchflow.model import SCHEMAS


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the canonical schema of ``table``.

    Missing columns become typed NULLs, present ones are cast; extra columns
    are dropped.  Pure projection, so Catalyst prunes unused columns from the
    scan below it.
    """
    have = set(df.columns)
    cols = []
    for f in SCHEMAS[table].fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


@dataclass
class Garage:
    """All shop tables; every field is a lazy DataFrame."""

    bookings: DataFrame
    services: DataFrame
    users: DataFrame
    customers: DataFrame
    mechanics: DataFrame
    vehicles: DataFrame
    payments: DataFrame
    testimonials: DataFrame
    mechanic_availability: DataFrame
    mechanic_tasks: DataFrame
    field_notes: DataFrame
    customer_messages: DataFrame
    activity_log: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def load_tables(spark: SparkSession, path: str) -> Garage:
    """Read ``{path}/{table}.parquet`` for every table with its fixed schema.

    No schema inference: the explicit ``StructType`` keeps the scan cheap at
    scale and lets Parquet push filters and prune columns.
    """
    frames = {
        name: spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}.parquet")
        for name, schema in SCHEMAS.items()
    }
    return Garage(**frames)


def write_tables(garage: Garage, path: str, mode: str = "overwrite") -> None:
    """Persist every table as Parquet (bookings partitioned by month)."""
    for name, df in garage.as_dict().items():
        writer = df.write.mode(mode)
        if name == "bookings":
            df = df.withColumn("booking_month", F.date_format("booking_date", "yyyy-MM"))
            writer = df.write.mode(mode).partitionBy("booking_month")
        writer.parquet(f"{path.rstrip('/')}/{name}.parquet")


def load_tables_jdbc(spark: SparkSession, url: str, properties: dict, partition_columns: dict[str, tuple],
                     num_partitions: int = 64) -> Garage:
    """S1 from the operational database: every table through ``spark.read.jdbc``.

    ``partition_columns`` maps a table to (column, lower, upper); those
    tables are read in ``num_partitions`` parallel range queries instead of
    one connection.  Rows are conformed to the fixed schemas.  (Not exercised
    in this repository's tests: no database is available here.)
    """
    frames = {}
    for name in SCHEMAS:
        if name in partition_columns:
            col, lo, hi = partition_columns[name]
            df = spark.read.jdbc(url, name, column=col, lowerBound=lo, upperBound=hi,
                                 numPartitions=num_partitions, properties=properties)
        else:
            df = spark.read.jdbc(url, name, properties=properties)
        frames[name] = conform(df, name)
    return Garage(**frames)
