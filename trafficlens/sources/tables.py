"""Parquet scans with projection, and time helpers shared by stand-ins."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one table and keep only ``columns`` (pruned at the scan)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def ntz_millis_sql(column: str) -> str:
    """SQL text: epoch milliseconds of a TIMESTAMP_NTZ without any zone conversion.

    Days since the epoch plus the wall-clock fields; floor to the millisecond.
    """
    c = f"`{column}`"
    return (f"(CAST(unix_date(to_date({c})) AS BIGINT) * 86400000 + hour({c}) * 3600000 + minute({c}) * 60000 + "
            f"CAST(floor(date_part('SECOND', {c}) * 1000) AS BIGINT))")


def epoch_millis(df: DataFrame, column: str) -> Column:
    """Milliseconds since the epoch, independent of the session time zone.

    Driver tables hold TIMESTAMP_NTZ (wall clock = UTC); those are converted
    field by field so the session zone never enters.  Zoned timestamps use
    ``unix_millis``.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, TimestampNTZType):
        return F.expr(ntz_millis_sql(column))
    return F.unix_millis(F.col(column))
