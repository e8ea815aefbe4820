"""T3 with polls: verdicts counted since the last poll, given out once, and reset.

A poll covers a stretch of event time.  Its counts are state, by poll and
shard; when the watermark passes the poll's end its timer gives them out and
clears them, so what is held is bounded by the polls that are still open.  A
request that comes after its poll was closed cannot be in its counts any more: it
is counted as late, per micro-batch, from what Spark reports to have dropped.

Counts, timers and the log of late requests survive a restart with the run's
folder.  A hot poll is counted in ``shards`` parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = "spark.sql.streaming.numRecentProgressUpdates"


def _counter(width_ms: int):
    """The processor; made here so that it travels to the tasks by value."""
    class PollCounts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.counts = handle.getValueState("counts", "users long, bots long")

        def handleInputRows(self, key, rows, timerValues):
            users, bots = self.counts.get() if self.counts.exists() else (0, 0)
            if not users + bots:
                self.handle.registerTimer(key[0] + width_ms)
            for row in rows:
                users, bots = (users + 1, bots) if row["p"] < 0.5 else (users, bots + 1)
            self.counts.update((users, bots))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            users, bots = self.counts.get()
            self.counts.clear()
            yield Row(poll_start=key[0], shard=key[1], users=users, bots=bots)

        def close(self) -> None:
            pass
    return PollCounts()


def poll_counts(scored: DataFrame, ts: str, p: str, width_ms: int, delay: str = "1 hour", shards: int = 8) -> DataFrame:
    """The stream of closed polls, in parts: poll_start (epoch ms), shard, users (p < 0.5) and bots."""
    at = F.unix_millis(ts)
    rows = scored.withWatermark(ts, delay).select(F.col(ts).alias("ts"), F.col(p).alias("p"), (at - F.pmod(at, F.lit(width_ms))).alias("poll_start"),
                                                  F.pmod(F.xxhash64(ts, p), F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("poll_start", "shard").transformWithState(
        statefulProcessor=_counter(width_ms), outputStructType="poll_start long, shard int, users long, bots long", outputMode="Append", timeMode="EventTime")


def run_polls(counts: DataFrame, folder: str) -> str:
    """Run to completion: closed polls under ``folder``/table, late requests a micro-batch under ``folder``/late."""
    spark = counts.sparkSession
    before = {k: spark.conf.get(k, None) for k in (STORE, KEPT)}
    spark.conf.set(STORE, ROCKS)
    spark.conf.set(KEPT, "1000000")
    try:
        q = (counts.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        late = [(p["batchId"], sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])) for p in q.recentProgress]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for batch, n in late:
        if n:  # under the batch's number: a batch that is tried again writes over it
            spark.createDataFrame([(batch, n)], "batch long, late long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/late/_batch={batch}")
    return folder


def polls(spark: SparkSession, folder: str) -> DataFrame:
    """(poll_start, users, bots) of the polls that were given out."""
    parts = spark.read.schema("poll_start long, shard int, users long, bots long").parquet(f"{folder}/table")
    return parts.groupBy("poll_start").agg(F.sum("users").alias("users"), F.sum("bots").alias("bots"))


def late_requests(spark: SparkSession, folder: str) -> int:
    """How many requests came after their poll was closed."""
    from trafficlens.session import path_exists
    if not path_exists(spark, f"{folder}/late"):
        return 0
    return spark.read.parquet(f"{folder}/late/_batch=*").agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0]
