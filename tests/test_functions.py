import math

from conftest import IN_TIME, at
from pyspark.sql import functions as F

from wardline.functions import (
    day_bin,
    hour_bin,
    is_finite,
    meld_na,
    micros_between,
    na_ifelse,
    no_nan,
    safe_ratio,
    strip_text,
    to_number,
)


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_offsets_do_not_depend_on_the_session_zone(spark):
    """Around the change of the clocks, and inside the hour that it leaves out."""
    times = ["2150-03-07 12:00:00", "2150-03-08 02:30:00", "2150-03-08 12:30:00.000001", "1950-01-01 00:00:00"]
    df = spark.sql(
        "SELECT i, TIMESTAMP_NTZ '2150-03-07 12:00:00' AS a, CAST(t AS timestamp_ntz) AS t, "
        "TIMESTAMP '2150-03-07 12:00:00Z' AS z FROM VALUES "
        + ", ".join(f"({i}, '{t}')" for i, t in enumerate(times)) + " AS v(i, t) ORDER BY i"
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    found = {}
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found[zone] = (
                column(df, micros_between("a", "t")), column(df, day_bin("a", "t")), column(df, micros_between("z", "t"))[0]
            )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    hour = 3_600_000_000
    assert found["UTC"][0][:3] == [0, 14.5 * hour, 24.5 * hour + 1]
    assert found["UTC"][1] == [None, 1, 2, None]
    assert found["UTC"] == found["America/New_York"] == found["Asia/Kolkata"]


def test_day_bins_are_right_closed(spark):
    hours = [-1, 0, 0.001, 24, 24.0001, 672, 672.01]
    df = spark.createDataFrame(
        [(i, IN_TIME, at(h)) for i, h in enumerate(hours)],
        "i int, a timestamp_ntz, t timestamp_ntz",
    ).orderBy("i")
    assert column(df, day_bin("a", "t")) == [None, None, 1, 1, 2, 28, None]
    assert column(df, day_bin("a", "t", 1)) == [None, None, 1, 1, None, None, None]


def test_hour_bins(spark):
    df = spark.createDataFrame([(0.0,), (24.0,), (24.0001,), (672.0,), (672.01,), (None,)], "h double")
    assert column(df, hour_bin("h")) == [None, 1, 2, 28, None, None]


def test_ratio_rules(spark):
    rows = [(8.0, 2.0), (5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (1.0, 8.0), (None, 2.0), (1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = column(df, safe_ratio("a", "b"))
    assert got == [4.0, math.inf, -math.inf, None, 0.12, None, None]


def test_missing_condition_gives_missing(spark):
    df = spark.createDataFrame([("L",), ("",), (None,)], "u string")
    assert column(df, na_ifelse(F.col("u") == "L", F.lit(1), F.lit(2))) == [1, 2, None]


def test_number_and_text_helpers(spark):
    df = spark.createDataFrame([("12.5 hours",), ("x",), (None,)], "s string")
    assert column(df, to_number(strip_text("s", " hours"))) == [12.5, None, None]
    nums = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,)], "x double")
    assert column(nums, no_nan("x")) == [1.0, None, math.inf, None]
    assert column(nums, is_finite("x")) == [True, False, False, False]


def test_meld(spark):
    df = spark.createDataFrame([(2.0, 130.0)], "m double, na double")
    (value,) = column(df, meld_na("m", "na"))
    assert value == 20 + 1.32 * 7 - 0.033 * 20 * 7
