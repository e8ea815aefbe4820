"""File sources and sinks.  Written tables go to a fresh folder
under the session's shared ``spark.checkpoint.dir`` (never a machine-local
temp folder on a cluster)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from trafficlens.session import scratch_path

AUTH_SCHEMA = StructType([StructField("IP", LongType(), False), StructField("TIMESTAMP", LongType(), False),
                          StructField("BOT_OR_HUMAN", StringType(), False)])


def read_csv_typed(spark: SparkSession, path: str, schema: StructType = AUTH_SCHEMA) -> DataFrame:
    """Header CSV with a fixed schema (file-source columns are nullable in Spark)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_csv_untyped(spark: SparkSession, path: str, casts: dict[str, str]) -> DataFrame:
    """S3: every column arrives as text; bad text becomes null through try_cast."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text with a header."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """Label DOUBLE + sparse features."""
    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", str(num_features))
    return r.load(path)


# The two bean layouts of the reference's labelled sentences.
DOCUMENT_SCHEMA = StructType([StructField("id", LongType(), True), StructField("text", StringType(), True)])
LABELED_DOCUMENT_SCHEMA = StructType([StructField("id", LongType(), True), StructField("text", StringType(), True),
                                      StructField("label", DoubleType(), True)])


def rows_to_df(spark: SparkSession, rows: list, schema) -> DataFrame:
    """Literal rows with a schema (beans become tuples)."""
    return spark.createDataFrame(rows, schema)


def with_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """S6 for rows Spark already holds: reconcile columns (by name) and types to a
    fixed schema, JVM-side (``DataFrame.to``); missing columns raise."""
    return df.to(schema)


def write_parquet(df: DataFrame, path: str, same_partitions_as: DataFrame | None = None) -> str:
    """Overwrite Parquet; optionally keep the input's partition count."""
    out = df
    if same_partitions_as is not None:
        out = df.repartition(same_partitions_as.rdd.getNumPartitions())
    out.write.mode("overwrite").parquet(path)
    return path


def write_by_slice(df: DataFrame, path: str, ts: str, start: int, width: int) -> str:
    """One folder a time slice [start + slice * width, start + (slice + 1) * width), so that reading slices
    touches only theirs.  Rows are dealt by slice and, within one, by time: a slice with most of the rows is many files."""
    sliced = df.withColumn("slice", F.floor((F.col(ts) - F.lit(start)) / F.lit(width)).cast("int"))
    sliced.repartitionByRange("slice", ts).write.mode("overwrite").partitionBy("slice").parquet(path)
    return path


def slice_folders(spark: SparkSession, path: str) -> list[int | None]:
    """The slices that ``write_by_slice`` left at ``path`` (None: rows without a time); as many as time has."""
    return [r[0] for r in spark.read.parquet(path).select("slice").distinct().collect()]


def slice_folder(path: str, at: int | None) -> str:
    return f"{path}/slice={'__HIVE_DEFAULT_PARTITION__' if at is None else at}"


def read_between(spark: SparkSession, path: str, ts: str, start: int, width: int, low: int, high: int, closed: str = "left") -> DataFrame:
    """P7 on ``write_by_slice``'s layout: rows with low <= ts < high (``closed='both'``: <= high).  The bounds become a
    range of slices, which prunes folders, and a filter on ``ts``, which cuts the first and last slice."""
    rows, t = spark.read.parquet(path), F.col(ts)
    inside = F.col("slice").between((low - start) // width, (high - start) // width)
    return rows.where(inside & (t >= low) & ((t <= high) if closed == "both" else (t < high))).drop("slice")


def read_listed(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of the slices that ``wanted`` (a column ``slice``) lists: a semi join that prunes folders while it runs."""
    return spark.read.parquet(path).join(wanted.select("slice").distinct(), "slice", "left_semi")


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> str:
    """A catalogue table in the shared folder whose rows lie in ``buckets`` files by the hash of ``key``, sorted
    by it; the name of the table.  Rows that several joins need by one key are then shuffled once, here."""
    table = f"{name}_{os.urandom(6).hex()}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key) \
        .option("path", scratch_path(df.sparkSession, name)).saveAsTable(table)
    return table


def join_colocated(spark: SparkSession, left: str, right: str, key: str, how: str = "inner") -> DataFrame:
    """J1, J7 of two ``write_bucketed`` tables of one bucket count: bucket meets bucket, nothing is shuffled or sent round."""
    return spark.table(left).hint("merge").join(spark.table(right), key, how)


def write_csv_head(df: DataFrame, path: str, n: int, order: list[str]) -> str:
    """The first n rows in ``order`` to one CSV file with a header (top-n, then one task)."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def write_libsvm(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").format("libsvm").save(path)
    return path


def fresh(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
