"""Shared helpers of the training-data operators.

Column names that start with ``__llm_`` are reserved: operators that return
their input's columns use them for work columns, so any other extra column of
the input, whatever its name, passes through untouched.
"""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import trafficlens
from trafficlens.session import scratch_path

#: Fixed value: what the contracts call a word of a document.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*columns: str) -> Column:
    """64 bits over the columns; with the id it tells rows of one id apart.  Repeated rows share it."""
    return F.xxhash64(*[F.col(c) for c in columns])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage so that it survives lost executors, and gives Spark the
    table's true size for its own choice of join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._llm_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more, and let go of the shuffle files behind them.

    Spark frees a shuffle's files when the driver's JVM collects what refers to
    them, which by itself it does every half hour, so it is asked to here.
    """
    if not tables:
        return
    sc = tables[0].sparkSession.sparkContext
    for table in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(table._llm_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    sc._jvm.System.gc()


def arrow_schema(ddl: str):
    """Arrow schema of a DDL string (made on the driver; tasks get it with their function)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python once an application, so that tasks can import it wherever the
    job was started.  (A package that was itself sent as a zip file is there already.)"""
    sc, root = spark.sparkContext, Path(trafficlens.__file__).parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="trafficlens-")) / "trafficlens.zip"  # read by the driver's own file server
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def map_batches(rows: DataFrame, fn: Callable, schema) -> DataFrame:
    """``rows.mapInArrow`` with this package at hand in the tasks."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(fn, schema)


def append_columns(rows: DataFrame, new: str, fn: Callable, *inputs: str) -> DataFrame:
    """``rows`` with the columns of the DDL ``new``, computed batch-wise in Python without a shuffle.

    ``fn(*lists)`` gets the values of ``inputs`` for one Arrow batch and gives
    a list of tuples, one a row.  Only a batch is held at a time.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType(rows.schema.fields + StructType.fromDDL(new).fields)
    kinds = arrow_schema(new)

    def run(batches):
        for batch in batches:
            got = fn(*[batch.column(c).to_pylist() for c in inputs])
            columns = list(zip(*got, strict=True)) if got else [() for _ in kinds]
            added = [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *kinds.names])
    return map_batches(rows, run, schema)
