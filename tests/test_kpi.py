"""Aggregation, ranking, growth and reshape semantics on hand-made rows."""

from pyspark.sql import functions as F

from skylane.operators import diagnose, growth, kpi, reshape, routes
from conftest import rows


def _flights(spark, data):
    return spark.createDataFrame(data, "YEAR int, ARR_DELAY double, CANCELLED double, DIVERTED double")


def test_null_delay_boundary_and_rates(spark):
    df = _flights(spark, [(2019, 15.0, 0.0, 0.0), (2019, 16.0, 0.0, 0.0), (2019, None, 1.0, 0.0)])
    r = kpi.period_rates(df, ["YEAR"]).first()
    assert (r.Total_Flights, r.Delayed_Flights, r.OnTime_Flights, r.Cancelled_Flights) == (3, 1, 1, 1)
    assert r.Arrival_Delay_Rate == 33.33 and r.OnTime_Rate == 33.33
    assert r.Arrival_Delay_Rate + r.OnTime_Rate < 100


def test_empty_period_is_zero_not_missing(spark):
    df = _flights(spark, [(2019, 1.0, 1.0, 0.0), (2020, 1.0, 0.0, 0.0)])
    got = {r.YEAR: r.Cancelled_Flights for r in kpi.period_rates(df, ["YEAR"]).collect()}
    assert got == {2019: 1, 2020: 0}


def test_one_pass_equals_joined_form(spark, flights_small):
    where = kpi.equals("AIRLINE", "AIRLINE_15")
    a = sorted(rows(kpi.period_rates(flights_small, "month", where)))
    b = kpi.period_rates_joined(flights_small, "month", where)
    b = sorted(rows(b.select(*kpi.period_rates(flights_small, "month", where).columns)))
    assert a == b


def test_rate_invariant(spark, flights_small):
    """delay share + on-time share + NULL share = 100 % (before rounding)."""
    r = flights_small.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ARR_DELAY") > 15).alias("d"),
                          F.count_if(F.col("ARR_DELAY") <= 15).alias("o"),
                          F.count_if(F.col("ARR_DELAY").isNull()).alias("z")).first()
    assert r.d + r.o + r.z == r.n


def test_null_key_left_join_null_safe(spark):
    l = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    r = spark.createDataFrame([(None, 10), ("a", 20)], "k string, w int")
    got = sorted(rows(kpi.left_join_all([l, r], ["k"])), key=lambda t: (t[0] is None, t))
    assert got == [("a", 2, 20), (None, 1, 10)]


def test_growth_gap_years_use_present_years(spark):
    data = [(2019, "g"), (2019, "h"), (2020, "h"), (2020, "h"), (2021, "g"), (2021, "g"), (2021, "h")]
    df = spark.createDataFrame(data, "YEAR int, ORIGIN string")
    got = rows(growth.growth(df, "ORIGIN", "g").orderBy("YEAR"))
    # the group has 2019 (1) and 2021 (2): growth 100 %; industry 2 -> 3 over the same years
    assert got == [(2019, 1, 2, None, None), (2021, 2, 3, 100.0, 50.0)]
    alls = {(r.ORIGIN, r.YEAR): r.Group_Growth for r in growth.growth_all(df, "ORIGIN").collect()}
    assert alls[("g", 2021)] == 100.0 and alls[("h", 2020)] == 100.0


def test_top_rates_ties(spark):
    data = []
    # groups a, b: equal delay rates; c lower; b and c equal cancel rates
    for g, n, late, canc in [("a", 4, 2, 0), ("b", 4, 2, 1), ("c", 4, 1, 1), ("d", 4, 0, 0)]:
        for i in range(n):
            data.append((g, 10.0 if i < late else -1.0, 1.0 if i < canc else 0.0))
    df = spark.createDataFrame(data, "AIRLINE string, DEP_DELAY double, CANCELLED double")
    t = kpi.top_rates(df, "AIRLINE", 2)
    delay = [r.AIRLINE for r in t.filter("ranking = 'delay'").orderBy("position").collect()]
    cancel = [r.AIRLINE for r in t.filter("ranking = 'cancel'").orderBy("position").collect()]
    assert delay == ["a", "b"]          # tie on rate -> key order
    assert cancel == ["b", "c"]         # tie on cancel rate -> higher delay rate first


def test_all_null_mean_sorted_last(spark):
    df = spark.createDataFrame([("A", "X", 5.0), ("B", "Y", None), ("C", "Z", 1.0)],
                               "ORIGIN_CITY string, DEST_CITY string, DEP_DELAY double").withColumn("K", F.lit(1))
    got = rows(routes.top_route_delay(df, "K", 1, 5))
    assert got[-1] == ("B → Y", None) and got[0] == ("A → X", 5.0)


def test_pivot_holes_and_level_rows(spark):
    long = spark.createDataFrame([(2019, "Winter", 1.0), (2020, "Winter", 2.0), (2019, "Summer", 3.0)],
                                 "YEAR int, SEASON string, Avg_Departure_Delay double")
    wide = kpi.seasonal_matrix(long)
    got = rows(wide)
    assert [g[0] for g in got] == ["Winter", "Summer", "Spring", "Fall"]
    assert got[1][1:3] == (3.0, None)         # missing cell
    assert got[2][1:3] == (None, None)        # season without data


def test_unpivot_keeps_null(spark):
    df = spark.createDataFrame([(2019, 1.0, None)], "YEAR int, a double, b double")
    got = sorted(rows(reshape.unpivot_long(df, ["YEAR"], ["a", "b"])), key=str)
    assert got == [(2019, "a", 1.0), (2019, "b", None)]


def test_pivot_unpivot_identity(spark, flights_small):
    w = diagnose.weather_rates(flights_small)
    wide = diagnose.weather_matrix(w)
    years = [c for c in wide.columns if c != "MONTH"]
    back = reshape.unpivot_long(wide, ["MONTH"], years, "YEAR", "Delay_Rate").filter("Delay_Rate IS NOT NULL")
    a = sorted(rows(back.select(F.col("YEAR").cast("int"), "MONTH", "Delay_Rate")))
    b = sorted(rows(w.select("YEAR", "MONTH", "Delay_Rate")))
    assert a == b


def test_contingency_zero_cells(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (0, 1)], "Predicted int, Actual int")
    got = rows(reshape.contingency(df, "Predicted", "Actual", [0, 1], [0, 1]))
    assert got == [(0, 0, 1), (0, 1, 2), (1, 0, 0), (1, 1, 0)]


def test_histogram_bins(spark):
    df = spark.createDataFrame([(x,) for x in (16.0, 19.9, 20.0, None)], "ARR_DELAY double")
    got = sorted(rows(kpi.histogram(df, "ARR_DELAY", 5.0)))
    assert got == [(3, 2, 15.0, 20.0), (4, 1, 20.0, 25.0)]


def test_correlations_one_scan(spark, flights_raw):
    c = diagnose.correlations(flights_raw)
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 3         # lineitem, supplier, part read once each
    assert c.count() == 3
