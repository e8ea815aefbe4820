"""Randomised properties (hypothesis): P18/P19 invert each other; hash buckets stay in range."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trafficlens.functions.ip import int_to_ip, ip_to_int
from trafficlens.functions.scalars import hash_bucket


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=-2**31, max_value=2**31 - 1), min_size=1, max_size=200))
def test_ip_int_text_round_trip(spark, ints):
    df = spark.createDataFrame([(i,) for i in ints], "ip int")
    out = df.select("ip", int_to_ip("ip").alias("t")).select("ip", "t", ip_to_int("t").alias("back")).collect()
    for r in out:
        assert r["back"] == r["ip"]
        parts = r["t"].split(".")
        assert len(parts) == 4 and all(0 <= int(p) <= 255 for p in parts)
        assert (int(parts[0]) << 24 | int(parts[1]) << 16 | int(parts[2]) << 8 | int(parts[3])) == r["ip"] & 0xFFFFFFFF


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=100), st.integers(min_value=1, max_value=10**7))
def test_hash_bucket_range_and_stability(spark, texts, n):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a = [r[0] for r in df.select(hash_bucket("t", n)).collect()]
    b = [r[0] for r in df.select(hash_bucket(F.col("t"), n)).collect()]
    assert a == b and all(0 <= x < n for x in a)
