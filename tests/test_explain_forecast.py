"""Shapley / permutation importance on a linear score, and forecasts on
exact series."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skylane.operators import explain, forecast


def test_linear_shapley_closed_form(spark):
    w = {"x1": 2.0, "x2": -3.0}
    x = spark.createDataFrame([(1, 5.0, 1.0), (2, 0.0, 4.0)], "ROW_KEY int, x1 double, x2 double")
    bg = spark.createDataFrame([(9, 1.0, 2.0)], "ROW_KEY int, x1 double, x2 double")
    phi = explain.shapley(explain.linear_scorer(w), x, bg, {"x1": ["x1"], "x2": ["x2"]}, permutations=8)
    got = {(r.ROW_KEY, r.feature): r.phi for r in phi.collect()}
    assert got[(1, "x1")] == pytest.approx(2.0 * (5 - 1)) and got[(1, "x2")] == pytest.approx(-3.0 * (1 - 2))
    assert got[(2, "x1")] == pytest.approx(-2.0) and got[(2, "x2")] == pytest.approx(-6.0)
    # efficiency: sum of phi = f(x) - f(background)
    assert got[(1, "x1")] + got[(1, "x2")] == pytest.approx((2 * 5 - 3 * 1) - (2 * 1 - 3 * 2))


def test_shapley_background_mean(spark):
    w = {"a": 1.0}
    x = spark.createDataFrame([(1, 10.0)], "ROW_KEY int, a double")
    bg = spark.createDataFrame([(i, float(i)) for i in range(4)], "ROW_KEY int, a double")
    phi = explain.shapley(explain.linear_scorer(w), x, bg, {"a": ["a"]}, permutations=400, seed=3).first().phi
    assert phi == pytest.approx(10.0 - 1.5, abs=0.5)


def test_top_by_abs_keeps_ties(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", -1.0), (1, "c", 0.5)], "ROW_KEY int, feature string, phi double")
    got = explain.top_by_abs(df, n=1).collect()
    assert {r.feature for r in got} == {"a", "b"}


def test_permutation_importance_unused_feature(spark):
    rows = [(i, float(i % 7), float((i * 13) % 11), 1 if i % 7 >= 3 else 0) for i in range(700)]
    df = spark.createDataFrame(rows, "ROW_KEY int, used double, unused double, y int")
    score = explain.linear_scorer({"used": 1.0})
    imp = {r.feature: r for r in explain.permutation_importance(score, df, "y", {"used": ["used"], "unused": ["unused"]},
                                                                rows_per_bucket=200).collect()}
    assert imp["unused"].auc_drop == pytest.approx(0.0)
    assert imp["used"].base_auc == pytest.approx(1.0) and imp["used"].auc_drop > 0.3


def test_permutation_importance_whatever_the_partitions(spark):
    rows = [(float(i % 7), float((i * 13) % 11), 1 if (i * 5) % 9 >= 4 else 0) for i in range(300)] * 2 + [(1.0, 1.0, 1)] * 90
    df = spark.createDataFrame(rows, "a double, b double, y int")
    score = explain.linear_scorer({"a": 1.0, "b": 0.3})
    got = [sorted(map(tuple, explain.permutation_importance(score, df.repartition(n), "y", {"a": ["a"], "b": ["b"]}).collect()))
           for n in (2, 5)]
    assert got[0] == got[1] and len(got[0]) == 2


def test_row_ids_unique(spark):
    rows = [(1, "x")] * 50 + [(None, "x"), (1, None), (None, None)]
    out = explain.row_ids(spark.createDataFrame(rows, "a int, b string"), block=7)
    assert sorted(map(str, ((r.a, r.b) for r in out.collect()))) == sorted(map(str, rows))
    assert out.select("_rid").distinct().count() == len(rows)


def test_shapley_equal_keys_stay_apart(spark):
    x = spark.createDataFrame([(1, 5.0, 1.0), (1, 0.0, 4.0), (1, 0.0, 4.0)], "ROW_KEY int, x1 double, x2 double")
    bg = spark.createDataFrame([(9, 1.0, 2.0)], "ROW_KEY int, x1 double, x2 double")
    phi = explain.shapley(explain.linear_scorer({"x1": 2.0, "x2": -3.0}), x, bg, {"x1": ["x1"], "x2": ["x2"]}, permutations=8)
    assert sorted((r.feature, r.phi) for r in phi.collect()) == [("x1", -2.0), ("x1", 8.0), ("x2", -6.0), ("x2", 3.0)]
    assert explain.top_by_abs(phi, n=1).count() == 2


def test_fourier_short_series(spark):
    four = spark.createDataFrame([(dt.date(2020, m, 1), y) for m, y in ((1, 5.0), (2, 6.0), (3, 5.5), (4, 5.2))], "Month date, ARR_DELAY double")
    got = forecast.fourier_trend_forecast(four).orderBy("ds").collect()
    assert len(got) == 16 and all(r.yhat_lower < r.yhat < r.yhat_upper for r in got)
    one = forecast.fourier_trend_forecast(four.limit(1)).collect()
    assert len(one) == 13 and all(r.yhat == pytest.approx(5.0, abs=1e-3) and r.yhat_lower is None for r in one)


def test_permute_group_is_permutation(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(500)], "k int, v double")
    p = explain.permute_group(df, ["v"], seed=5, buckets=3, id_col="k")
    assert sorted(r.v for r in p.collect()) == [float(i) for i in range(500)]
    assert p.filter(F.col("v") != F.col("k").cast("double")).count() > 400


def test_permute_copies_spread_over_buckets(spark):
    """600 identical rows: the unique id, not the content, picks the bucket."""
    df = spark.createDataFrame([(1.0, 2.0)] * 600, "a double, b double").withColumn(
        "_rid", F.monotonically_increasing_id())
    b = df.select(F.pmod(F.xxhash64("_rid", F.lit(5)), F.lit(4)).alias("b")).groupBy("b").count().collect()
    assert len(b) == 4 and max(r["count"] for r in b) < 250
    p = explain.permute_group(df, ["a"], seed=5, buckets=4)
    assert p.count() == 600


def _monthly(spark, data):
    return spark.createDataFrame(data, "FL_DATE date, ARR_DELAY double")


def test_calendar_gap_and_horizon_across_year_end(spark):
    df = _monthly(spark, [(dt.date(2020, 10, 5), 1.0), (dt.date(2020, 12, 1), 3.0)])
    m = forecast.monthly_mean(df)
    cal = sorted((r.Month, r.ARR_DELAY) for r in forecast.calendar(m).collect())
    assert cal == [(dt.date(2020, 10, 1), 1.0), (dt.date(2020, 11, 1), None), (dt.date(2020, 12, 1), 3.0)]
    hz = [r.Month for r in forecast.horizon(m).orderBy("Month").collect()]
    assert hz[0] == dt.date(2021, 1, 1) and hz[-1] == dt.date(2021, 12, 1) and len(hz) == 12
    ff = forecast.future_frame(m).count()
    assert ff == 3 + 12


def test_capped_mean_null_stays_null(spark):
    df = _monthly(spark, [(dt.date(2020, 1, 1), 250.0), (dt.date(2020, 1, 2), None), (dt.date(2020, 1, 3), 10.0)])
    assert forecast.monthly_mean(df, cap=200.0).first().ARR_DELAY == pytest.approx(105.0)


def test_trend_season_exact(spark):
    """log1p(y) = 0.5 + 0.01 t + offset(month): the forecast continues the
    line exactly and the interval has zero width."""
    off = {m: 0.1 * math.sin(m) for m in range(1, 13)}
    data = []
    for t in range(36):
        y, mo = 2020 + t // 12, 1 + t % 12
        off_c = off[mo] - sum(off.values()) / 12
        data.append(("k", dt.date(y, mo, 1), math.expm1(0.5 + 0.01 * t + off_c)))
    m = spark.createDataFrame(data, "key string, Month date, ARR_DELAY double")
    fc = {r.Month: r for r in forecast.trend_season_forecast(m, ["key"]).collect()}
    r = fc[dt.date(2023, 1, 1)]
    expect = math.expm1(0.5 + 0.01 * 36 + off[1] - sum(off.values()) / 12)
    assert r.Predicted_DELAY == pytest.approx(expect, rel=1e-9)
    assert r.CI_lower == pytest.approx(expect, rel=1e-6) and r.CI_upper == pytest.approx(expect, rel=1e-6)
    assert len(fc) == 12


def test_fourier_forecast_shape(spark):
    data = [("k", dt.date(2020 + t // 12, 1 + t % 12, 1), 10.0 + t + 3 * math.sin(2 * math.pi * (1 + t % 12) / 12))
            for t in range(48)]
    m = spark.createDataFrame(data, "key string, Month date, ARR_DELAY double")
    out = forecast.fourier_trend_forecast(m, ["key"]).orderBy("ds").collect()
    assert len(out) == 48 + 12
    hist = [r for r in out if r.y is not None]
    err = max(abs(r.yhat - r.y) for r in hist)
    assert err < 1.0
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)


def test_calendar_fill_previous_and_constant(spark):
    df = _monthly(spark, [(dt.date(2020, 10, 5), 1.0), (dt.date(2020, 12, 1), 3.0)])
    m = forecast.monthly_mean(df)
    prev = sorted((r.Month, r.ARR_DELAY) for r in forecast.calendar(m, fill="previous").collect())
    assert prev[1] == (dt.date(2020, 11, 1), 1.0)
    const = sorted((r.Month, r.ARR_DELAY) for r in forecast.calendar(m, fill=0.0).collect())
    assert const[1] == (dt.date(2020, 11, 1), 0.0)


def test_ar_forecast_recovers_ar_series(spark):
    """y_t = 0.5 + 0.6 y_(t-1) exactly (no noise): the forecast continues it."""
    ys, y = [], 1.0
    for _ in range(60):
        ys.append(y)
        y = 0.5 + 0.6 * y
    data = [("k", dt.date(2015 + t // 12, 1 + t % 12, 1), ys[t]) for t in range(60)]
    m = spark.createDataFrame(data, "key string, Month date, ARR_DELAY double")
    out = forecast.ar_forecast(m, ["key"], lags=(1,), log=False).orderBy("Month").collect()
    assert len(out) == 12 and out[0].Month == dt.date(2020, 1, 1)
    assert out[0].Predicted_DELAY == pytest.approx(0.5 + 0.6 * ys[-1], rel=1e-6)
    assert out[0].CI_lower == pytest.approx(out[0].Predicted_DELAY, abs=1e-6)


def test_forecast_starts_after_the_series_and_loses_none(spark):
    import datetime
    from skylane.operators.forecast import trend_season_forecast
    month = lambda i: datetime.date(2020 + i // 12, i % 12 + 1, 1)
    rows = [("a", month(i), 5.0 + i if i < 23 else None) for i in range(24)] + [("b", month(i), -2.0) for i in range(6)]
    got = trend_season_forecast(spark.createDataFrame(rows, "k string, Month date, ARR_DELAY double"), ["k"], h=3).collect()
    assert min(r.Month for r in got if r.k == "a") == month(24)
    assert [r.Predicted_DELAY for r in got if r.k == "b"] == [None] * 3


def test_permutation_importance_scores_each_copy_of_a_row_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(a, b):
        calls.add(1)
        return a + 0.3 * b

    rows = [(float(i % 7), float((i * 13) % 11), 1 if (i * 5) % 9 >= 4 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    got = explain.permutation_importance(lambda d: d.withColumn("score", slow("a", "b")), df, "y", {"a": ["a"], "b": ["b"]}).collect()
    assert len(got) == 2 and calls.value == 300 * 3
