"""Plan shape: one scan per table, no cartesian product, no Python in the
hot path, filters and columns pushed to the Parquet scan."""

from skylane.operators import kpi
from skylane.plans import sqlapi


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_rates_single_scan(spark, flights_raw):
    fl = flights_raw
    df = kpi.period_rates(fl, "year", kpi.equals("AIRLINE", "AIRLINE_15"))
    assert _optimized(df).count("Relation ") == 3          # each source table once


def test_joined_form_joins_stored_counts(spark, flights_raw):
    fl = flights_raw
    df = kpi.period_rates_joined(fl, "year", kpi.equals("AIRLINE", "AIRLINE_15"))
    # five tables and four joins over one stored aggregation: the sources are not read again
    assert _optimized(df).count("Join LeftOuter") == 4 and _optimized(df).count("Relation ") == 0
    one = kpi.period_rates(fl, "year", kpi.equals("AIRLINE", "AIRLINE_15"))
    assert sorted(df.select(one.columns).collect()) == sorted(one.collect())


def test_sql1_no_cartesian(spark, flights_raw):
    fl = flights_raw
    df = sqlapi.run(spark, "sql_1", fl)
    assert "CartesianProduct" not in _physical(df)
    assert _optimized(df).count("Relation ") == 3


def test_no_python_udf_in_kpis(spark, flights_raw):
    fl = flights_raw
    for df in (kpi.overview(fl), kpi.group_rates(fl, "AIRLINE"), kpi.period_rates(fl, "dow")):
        p = _physical(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_pushdown_and_pruning(spark, tmp_path):
    from skylane.operators.prep import prepare
    from skylane.sources.fixture import flights
    from skylane.sources.readers import save_table
    path = save_table(prepare(flights(spark, "/root/testdata/sf0.001")), str(tmp_path / "fl"))
    fl = spark.read.parquet(path)
    df = kpi.period_rates(fl.filter("YEAR = 1996"), "month", kpi.equals("AIRLINE", "AIRLINE_15"))
    p = _physical(df)
    assert "PushedFilters: [IsNotNull(AIRLINE), EqualTo(AIRLINE,AIRLINE_15)]" in p
    assert "PartitionFilters: [isnotnull(YEAR" in p
    # only the columns the query needs are read
    scan = p[p.index("ReadSchema"):].split("\n")[0]
    assert "DEP_DELAY" not in scan and "ARR_DELAY" in scan
