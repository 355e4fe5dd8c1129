"""Micro-fixtures for the scalar column functions and the prepared columns."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skylane.functions import columns as C
from skylane.operators.prep import prepare
from conftest import rows


def test_distance_bins_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in (499.0, 500.0, 501.0, 1500.0, 1501.0, None)], "DISTANCE double")
    got = rows(df.select(C.distance_category("DISTANCE")))
    assert [g[0] for g in got] == ["Short-haul", "Short-haul", "Medium-haul", "Medium-haul", "Long-haul", None]


def test_hour_category_24_is_null(spark):
    df = spark.createDataFrame([(x,) for x in (0, 59, 100, 2359, 2400, None)], "CRS_DEP_TIME bigint")
    got = [r[0] for r in rows(df.select(C.hour_category("CRS_DEP_TIME")))]
    assert got == [0, 0, 1, 23, None, None]
    # the integer hour keeps 24
    assert [r[0] for r in rows(df.select(C.hour_of("CRS_DEP_TIME")))] == [0, 0, 1, 23, 24, None]


def test_weekdays_monday_one(spark):
    sunday = dt.date(2023, 1, 1)
    days = [sunday + dt.timedelta(days=i) for i in range(7)]
    df = spark.createDataFrame([(d,) for d in days], "FL_DATE date")
    got = rows(df.select(C.weekday_number("FL_DATE").alias("n"), C.weekday_name(C.weekday_number("FL_DATE"))))
    assert [g[0] for g in got] == [7, 1, 2, 3, 4, 5, 6]
    assert got[0][1] == "Sunday" and got[1][1] == "Monday"


def test_seasons_default_branch(spark):
    df = spark.createDataFrame([(m,) for m in list(range(1, 13)) + [None]], "MONTH int")
    got = [r[0] for r in rows(df.select(C.season("MONTH")))]
    assert got[:12] == ["Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer", "Summer",
                        "Fall", "Fall", "Fall", "Winter"]
    assert got[12] == "Fall"


def test_dates_two_formats_bad_text_null(spark):
    df = spark.createDataFrame([("2019-01-06",), ("20190106",), ("x",), (None,)], "FL_DATE string")
    got = [r[0] for r in rows(df.select(C.parse_date("FL_DATE")))]
    assert got == [dt.date(2019, 1, 6), dt.date(2019, 1, 6), None, None]


def test_prepare_parses_text_dates(spark):
    df = spark.createDataFrame([("20190106", 700, 1000.0)], "FL_DATE string, CRS_DEP_TIME bigint, DISTANCE double")
    r = prepare(df).first()
    assert (r.YEAR, r.MONTH, r.QUARTER, r.DAY_NUM, r.DAY_OF_WEEK, r.SEASON, r.DEP_HOUR, r.DISTANCE_CAT) == \
        (2019, 1, 1, 7, "Sunday", "Winter", 7, "Medium-haul")


def test_route_null_city_is_na(spark):
    df = spark.createDataFrame([("A", None), (None, "B")], "o string, d string")
    assert [r[0] for r in rows(df.select(C.route_label("o", "d")))] == ["A → NA", "NA → B"]


def test_finite_only(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, float("nan"), float("inf"), float("-inf"), None)], "x double")
    assert [r[0] for r in rows(df.filter(C.is_finite("x")))] == [1.0]


def test_cap_keeps_null(spark):
    df = spark.createDataFrame([(x,) for x in (250.0, 10.0, None)], "x double")
    assert [r[0] for r in rows(df.select(C.cap("x", 200)))] == [200.0, 10.0, None]
    # the trap the helper avoids: least() alone turns NULL into the cap
    assert rows(df.select(F.least("x", F.lit(200.0))))[2][0] == 200.0


def test_round_half_up(spark):
    df = spark.createDataFrame([(1, 32), (1287, 4000)], "a long, b long")
    got = [r[0] for r in rows(df.select(C.pct(F.col("a"), F.col("b"), 2)))]
    assert got == [3.13, 32.18]


def test_pct_zero_denominator_null(spark):
    df = spark.createDataFrame([(1, 0)], "a long, b long")
    assert rows(df.select(C.pct(F.col("a"), F.col("b"), 2)))[0][0] is None


def test_sanitize_names_and_collision():
    assert C.sanitize_columns(["A b-c", "x"]) == ["A_b_c", "x"]
    with pytest.raises(ValueError):
        C.sanitize_columns(["A b-c", "A_b_c"])


def test_hash_unit_deterministic(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, s string")
    got = [r[0] for r in rows(df.select(C.hash_unit("k", "s")))]
    assert got[0] == got[1] and 0 <= got[2] < 1 and not math.isnan(got[2])
