"""Polls are given out once and reset, over several runs; what comes too late is counted."""

from pyspark.sql import functions as F

from trafficlens.session import scratch_path
from trafficlens.streaming import polls as pl

MINUTE = 60_000


def test_polls_are_reset_and_survive_a_restart(spark):
    source, folder = scratch_path(spark, "requests"), scratch_path(spark, "polls")

    def arrive(*rows):
        spark.createDataFrame([(float(m), p) for m, p in rows], "minute double, p double") \
            .select(F.timestamp_millis((F.col("minute") * MINUTE).cast("long")).alias("ts"), "p").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, p double").parquet(source)
        pl.run_polls(pl.poll_counts(stream, "ts", "p", MINUTE, delay="2 minutes", shards=3), folder)
        return {r.poll_start // MINUTE: (r.users, r.bots) for r in pl.polls(spark, folder).collect()}, pl.late_requests(spark, folder)
    assert arrive((0.1, 0.2), (0.5, 0.9), (1.2, 0.7)) == ({}, 0)  # the watermark is before every poll's end
    assert arrive((0.7, 0.1), (3.5, 0.5)) == ({0: (2, 1)}, 0)  # a restart; minute 0 also has what came in the second run
    assert arrive((9.0, 0.4)) == ({0: (2, 1), 1: (0, 1), 3: (0, 1)}, 0)  # given out once: minute 0 is as it was
    assert arrive((0.9, 0.9), (1.1, 0.9), (8.5, 0.6)) == ({0: (2, 1), 1: (0, 1), 3: (0, 1)}, 2)
    closed, late = arrive((30.0, 0.4))
    assert closed == {0: (2, 1), 1: (0, 1), 3: (0, 1), 8: (0, 1), 9: (1, 0)} and late == 2
