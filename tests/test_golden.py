"""Golden cases from the reference's own asserts and hand-worked arithmetic."""

from pyspark.sql import functions as F

from trafficlens.functions.ip import int_to_ip, ip_to_int
from trafficlens.operators.ordering import keep_first_browser, keep_first_owner, with_row_index
from trafficlens.operators.windows import sliding_counts


def _rows(df, cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("o").collect()]


def test_first_owner_keeps_unique_rows(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 3, 2)], "f string, s long, o long")
    assert _rows(keep_first_owner(df, "f", "s", "o"), ["f", "s"]) == [("a", 1), ("b", 2), ("c", 3)]


def test_first_owner_drops_later_users(spark):
    df = spark.createDataFrame([("a", 1, 0), ("c", 1, 1), ("b", 2, 2), ("d", 2, 3)], "f string, s long, o long")
    assert _rows(keep_first_owner(df, "f", "s", "o"), ["f", "s"]) == [("a", 1), ("b", 2)]


def test_first_browser(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 1, 2), ("a", 1, 3)], "f string, s long, o long")
    assert _rows(keep_first_browser(df, "f", "s", "o"), ["f", "s"]) == [("a", 1), ("a", 1), ("a", 1)]


def test_first_browser_keeps_unique_rows(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 3, 2)], "f string, s long, o long")
    assert _rows(keep_first_browser(df, "f", "s", "o"), ["f", "s"]) == [("a", 1), ("b", 2), ("c", 3)]


def test_window_part_numbers(spark):
    """Window 3, shift 1, x = 0..9: part numbers per pass i (worked out from the formula)."""
    df = spark.createDataFrame([(x, 1, 0, "LOGIN") for x in range(10)],
                               "TIMESTAMP long, USER_ID long, isBot int, LOGIN_CREDENTIAL_TYPE string")
    out = sliding_counts(df, 3, 1, ["LOGIN"])
    got = {r["TS_PART"]: r["LOGIN"] for r in out.collect()}
    expected_parts = {0: [0, 0, 0, 3, 3, 3, 6, 6, 6, 9], 1: [1, 1, 4, 4, 4, 7, 7, 7, 10, 10],
                      2: [2, 5, 5, 5, 8, 8, 8, 11, 11, 11]}
    want = {}
    for parts in expected_parts.values():
        for p in parts:
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_ip_golden(spark):
    df = spark.createDataFrame([(-1,), (0,), (2130706433,)], "ip int")
    got = [r[0] for r in df.select(int_to_ip("ip")).collect()]
    assert got == ["255.255.255.255", "0.0.0.0", "127.0.0.1"]


def test_ip_round_trip_and_errors(spark):
    df = spark.createDataFrame([("127.0.0.1",), ("255.255.255.255",), ("1...",), ("1.2.3",), ("1.2.3.256",),
                                ("a.b.c.d",), (None,)], "t string")
    got = [r[0] for r in df.select(ip_to_int("t")).collect()]
    assert got == [2130706433, -1, 16777216, None, None, None, None]


def test_row_index_is_global_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    idx = with_row_index(df, ["k"], "rn")
    assert idx.where(F.col("rn") != F.col("k")).count() == 0
    assert idx.count() == 5000
