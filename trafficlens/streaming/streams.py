"""T1-T5 on Structured Streaming.

Sources are file streams (a folder of text / JSON / Parquet files); every
query runs with ``trigger(availableNow=True)``.  The caller names the folder of
a run; its checkpoint is kept there, so a run that is started again under the
same folder goes on where the last one ended.  Plain streams go to the file
sink, whose own log makes a batch count once; batches handled here are written
under their batch id and overwritten when a batch is tried again.  Windowed
aggregates carry a watermark, so their state is bounded; in ``update`` mode
every micro-batch adds its changed rows to an upsert log, and the current result
is the latest row per key (``latest_per_key``), a plain aggregate over the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trafficlens.operators.windows import sliding_counts, type_counts
from trafficlens.sources.uilog import parse_lines


def run_append(sdf: DataFrame, folder: str, fmt: str = "parquet") -> str:
    """Run a stateless (or append-mode) stream to completion into ``folder``/table; return that path."""
    q = (sdf.writeStream.format(fmt).option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{folder}/table"


def run_batches(sdf: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame], mode: str = "append") -> str:
    """Run a stream to completion; ``make(batch)`` is written as batch ``_batch`` of ``folder``/table, over what an
    earlier try of the same batch may have left."""
    def sink(batch: DataFrame, batch_id: int):
        make(batch).write.mode("overwrite").parquet(f"{folder}/table/_batch={batch_id}")

    q = (sdf.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{folder}/table"


def run_upsert_log(sdf: DataFrame, folder: str) -> str:
    """Run an update-mode aggregate; each batch's changed rows are kept with ``_batch``."""
    return run_batches(sdf, folder, lambda batch: batch, "update")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches of ``run_batches`` (folders that begin with '_' are hidden, so each is named)."""
    return spark.read.option("basePath", path).parquet(f"{path}/_batch=*")


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current result of an upsert log: the row of the latest batch per key."""
    log = read_batches(spark, path)
    vals = [c for c in log.columns if c not in keys and c != "_batch"]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("_batch")).alias("_v"))
    return latest.select(*keys, *[F.col("_v")[c].alias(c) for c in vals])


def ui_event_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """UI-event log lines from a folder, parsed."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return parse_lines(r.load(folder))


def verdict_counts(scored: DataFrame, ts: str, p: str, delay: str = "1 hour", width: str = "1 second") -> DataFrame:
    """Per time window, users (p < 0.5) and bots (the rest)."""
    w = F.window(F.col(ts), width)
    return (scored.withWatermark(ts, delay).groupBy(w.alias("w"))
            .agg(F.count_if(F.col(p) < 0.5).alias("users"), F.count_if(F.col(p) >= 0.5).alias("bots"))
            .select(F.unix_seconds(F.col("w.start")).alias("window_start"), "users", "bots"))


def sliding_login_stream(logins: DataFrame, window_ms: int, shift_ms: int, types: list[str],
                         delay: str = "1 hour") -> DataFrame:
    """T4: A6 on event time (epoch-aligned windows), late rows past the watermark drop."""
    t = F.timestamp_millis(F.col("TIMESTAMP"))
    w = F.window(F.col("_t"), f"{window_ms} milliseconds", f"{shift_ms} milliseconds")
    return (logins.withColumn("_t", t).withWatermark("_t", delay)
            .groupBy(w.alias("w"), "USER_ID", "isBot").agg(*type_counts(types, "LOGIN_CREDENTIAL_TYPE"))
            .select(F.unix_millis(F.col("w.start")).alias("window_start"), "USER_ID", "isBot", *types))


def score_requests(spark: SparkSession, folder: str, schema: StructType, model, fields: list[str]) -> DataFrame:
    """JSON requests -> named string fields (missing = '') -> fitted model -> P(bot)."""
    from pyspark.ml.functions import vector_to_array
    req = spark.readStream.schema(schema).json(folder)
    filled = req.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in req.columns
                          else F.lit("").alias(c) for c in fields])
    return model.transform(filled).withColumn("predict_proba", vector_to_array("probability")[1])


def slice_counts(batch: DataFrame, ts_min: Column | int, slice_ms: int, window: int, shift: int, types: list[str],
                 part: str | None = None) -> DataFrame:
    """A6 counts within each slice of time; windows are numbered from the one ``ts_min`` of all slices.

    A row's slice comes from its time, not from the file or batch that brings it.
    """
    keys = ["_slice", *([part] if part else []), "isBot"]
    sliced = batch.withColumn("_slice", F.floor((F.col("TIMESTAMP") - F.lit(ts_min)) / F.lit(slice_ms)).cast("int"))
    packed = sliced.withColumn("_label", F.struct(*keys))
    out = sliding_counts(packed, window, shift, types, label="_label", ts_min=ts_min)
    return out.select("TS_PART", "USER_ID", *[F.col("_label")[k].alias(k) for k in keys], *types)


def run_slices(spark: SparkSession, source: str, schema: StructType, folder: str, ts_min: int, slice_ms: int, window: int,
               shift: int, types: list[str], part: str | None = None, max_files: int = 1) -> DataFrame:
    """T5: logins arrive file by file, in any order and cut anywhere; the slices' A6 counts over all batches.

    A batch leaves the counts of its own rows; a slice that several files bring
    is summed over them.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    table = run_batches(stream, folder, lambda batch: slice_counts(batch, ts_min, slice_ms, window, shift, types, part))
    keys = ["_slice", *([part] if part else []), "TS_PART", "USER_ID", "isBot"]
    return read_batches(spark, table).groupBy(*keys).agg(*[F.sum(t).alias(t) for t in types])
