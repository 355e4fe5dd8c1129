"""Registered queries: (spark, sf_dir) -> DataFrame, with oracle SQL.

Each query body is a function of the prepared flights DataFrame, so the
same body runs over the driver tables (``load``), over a saved flights
table (benchmark) or over any user table with the flights schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnose, growth, kpi, routes
from ..operators.prep import prepare
from ..sources.fixture import flights
from . import sqlapi
from .oracle import FLIGHTS_WITH, pct, rnd

# --- fixed values: constants of the test queries ---
AIRLINE = "AIRLINE_15"      # the "one airline" of the per-period queries
ORIGIN = "AP000"            # the busiest origin code (the hot key of the data)

Body = Callable[[DataFrame], DataFrame]
BODIES: dict[str, Body] = {}
ORACLE: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared flights over the driver tables in ``sf_dir``."""
    return prepare(flights(spark, sf_dir))


def register(name: str, sql: str | None = None):
    def deco(fn: Body) -> Body:
        BODIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda body: (lambda spark, sf_dir: body(load(spark, sf_dir))))(body)
            for name, body in BODIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


_RATES_SQL = """
  count(*) AS Total_Flights,
  CAST(count_if(ARR_DELAY > 15) AS BIGINT) AS Delayed_Flights,
  CAST(count_if(ARR_DELAY <= 15) AS BIGINT) AS OnTime_Flights,
  CAST(count_if(CANCELLED = 1) AS BIGINT) AS Cancelled_Flights,
  CAST(count_if(DIVERTED = 1) AS BIGINT) AS Diverted_Flights,
  {r1} AS Arrival_Delay_Rate, {r2} AS OnTime_Rate, {r3} AS Cancel_Rate, {r4} AS Divert_Rate
""".format(r1=pct("count_if(ARR_DELAY > 15)", "count(*)", 2),
           r2=pct("count_if(ARR_DELAY <= 15)", "count(*)", 2),
           r3=pct("count_if(CANCELLED = 1)", "count(*)", 2),
           r4=pct("count_if(DIVERTED = 1)", "count(*)", 2))


def _period_sql(keys: str) -> str:
    return (f"{FLIGHTS_WITH}\nSELECT {keys}, {_RATES_SQL} FROM flights "
            f"WHERE AIRLINE = '{AIRLINE}' GROUP BY {keys}")


@register("q_year_rates", _period_sql("YEAR"))
def q_year_rates(fl: DataFrame) -> DataFrame:
    return kpi.period_rates(fl, "year", kpi.equals("AIRLINE", AIRLINE)).orderBy("YEAR")


@register("q_prep", f"{FLIGHTS_WITH}\nSELECT * FROM flights")
def q_prep(fl: DataFrame) -> DataFrame:
    return fl


@register("q_overview", f"""{FLIGHTS_WITH}
SELECT count(*) AS Total_Flights,
  CAST(count_if(ARR_DELAY > 15) AS BIGINT) AS Delayed_Flights,
  CAST(count_if(ARR_DELAY <= 15) AS BIGINT) AS OnTime_Flights,
  CAST(count_if(CANCELLED = 1) AS BIGINT) AS Cancelled_Flights,
  CAST(count_if(DIVERTED = 1) AS BIGINT) AS Diverted_Flights,
  CAST(count(DISTINCT AIRLINE) AS BIGINT) AS N_Airlines,
  CAST(count_if(DISTANCE_CAT = 'Short-haul') AS BIGINT) AS Short_Haul_Flights,
  CAST(count_if(DISTANCE_CAT = 'Medium-haul') AS BIGINT) AS Medium_Haul_Flights,
  CAST(count_if(DISTANCE_CAT = 'Long-haul') AS BIGINT) AS Long_Haul_Flights
FROM flights""")
def q_overview(fl: DataFrame) -> DataFrame:
    return kpi.overview(fl)


@register("q_airlines", f"{FLIGHTS_WITH}\nSELECT DISTINCT AIRLINE FROM flights WHERE AIRLINE IS NOT NULL ORDER BY AIRLINE")
def q_airlines(fl: DataFrame) -> DataFrame:
    return kpi.distinct_values(fl, "AIRLINE")


@register("q_hist", f"""{FLIGHTS_WITH}
, b AS (SELECT CAST(floor((ARR_DELAY - 0.0) / 5.0) AS BIGINT) AS bin FROM flights WHERE ARR_DELAY > 15)
SELECT bin, count(*) AS n, CAST(bin AS DOUBLE) * 5.0 + 0.0 AS bin_lo, CAST(bin + 1 AS DOUBLE) * 5.0 + 0.0 AS bin_hi
FROM b GROUP BY bin""")
def q_hist(fl: DataFrame) -> DataFrame:
    return kpi.delayed_histogram(fl, 5.0)


@register("q_quarter_rates", _period_sql("YEAR, QUARTER"))
def q_quarter_rates(fl: DataFrame) -> DataFrame:
    return kpi.period_rates(fl, "quarter", kpi.equals("AIRLINE", AIRLINE)).orderBy("YEAR", "QUARTER")


@register("q_month_rates", _period_sql("YEAR, MONTH"))
def q_month_rates(fl: DataFrame) -> DataFrame:
    return kpi.period_rates(fl, "month", kpi.equals("AIRLINE", AIRLINE)).orderBy("YEAR", "MONTH")


@register("q_dow_rates", _period_sql("YEAR, DAY_NUM, DAY_OF_WEEK"))
def q_dow_rates(fl: DataFrame) -> DataFrame:
    return kpi.period_rates(fl, "dow", kpi.equals("AIRLINE", AIRLINE)).orderBy("YEAR", "DAY_NUM")


def _mean_sql(keys: str) -> str:
    return (f"{FLIGHTS_WITH}\nSELECT {keys}, {rnd('avg(DEP_DELAY)', 1)} AS Avg_Departure_Delay "
            f"FROM flights WHERE AIRLINE = '{AIRLINE}' GROUP BY {keys}")


@register("q_hour_delay", _mean_sql("YEAR, DEP_HOUR"))
def q_hour_delay(fl: DataFrame) -> DataFrame:
    return kpi.hourly_delay(fl, kpi.equals("AIRLINE", AIRLINE))


@register("q_season_delay", _mean_sql("YEAR, SEASON"))
def q_season_delay(fl: DataFrame) -> DataFrame:
    return kpi.seasonal_delay(fl, kpi.equals("AIRLINE", AIRLINE))


# years of the fixture's flights: the columns of the two wide matrices
MATRIX_YEARS = list(range(1995, 2002))


def _year_columns(value: str) -> str:
    return ", ".join(f'max({value}) FILTER (WHERE YEAR = {y}) AS "{y}"' for y in MATRIX_YEARS)


@register("q_season_matrix", f"""{FLIGHTS_WITH},
m AS (SELECT YEAR, SEASON, {rnd('avg(DEP_DELAY)', 1)} AS v FROM flights WHERE AIRLINE = '{AIRLINE}' GROUP BY YEAR, SEASON),
p AS (SELECT SEASON, {_year_columns('v')} FROM m GROUP BY SEASON)
SELECT * FROM (VALUES ('Winter', 1), ('Summer', 2), ('Spring', 3), ('Fall', 4)) lv(SEASON, SEASON_ORDER)
LEFT JOIN p USING (SEASON)""")
def q_season_matrix(fl: DataFrame) -> DataFrame:
    return kpi.seasonal_matrix(kpi.seasonal_delay(fl, kpi.equals("AIRLINE", AIRLINE)), MATRIX_YEARS)


def _group_rates_sql(key: str) -> str:
    return f"""
  SELECT {key}, count(*) AS total_flights,
    CAST(count_if(DEP_DELAY > 0) AS BIGINT) AS delay_flights,
    CAST(coalesce(sum(CANCELLED), 0) AS DOUBLE) AS cancelled_flights,
    {pct('count_if(DEP_DELAY > 0)', 'count(*)', 3)} AS delay_rate,
    {pct('coalesce(sum(CANCELLED), 0)', 'count(*)', 3)} AS cancel_rate
  FROM flights GROUP BY {key}"""


def _top_sql(key: str, n: int = 5) -> str:
    o1 = f"delay_rate DESC NULLS LAST, {key} ASC NULLS LAST"
    o2 = f"cancel_rate DESC NULLS LAST, delay_rate DESC NULLS LAST, {key} ASC NULLS LAST"
    return f"""{FLIGHTS_WITH}
, r AS ({_group_rates_sql(key)})
(SELECT 'delay' AS ranking, CAST(row_number() OVER (ORDER BY {o1}) AS INTEGER) AS position, * FROM r ORDER BY {o1} LIMIT {n})
UNION ALL
(SELECT 'cancel' AS ranking, CAST(row_number() OVER (ORDER BY {o2}) AS INTEGER) AS position, * FROM r ORDER BY {o2} LIMIT {n})"""


@register("q_rates_airline", f"{FLIGHTS_WITH}\n{_group_rates_sql('AIRLINE')}")
def q_rates_airline(fl: DataFrame) -> DataFrame:
    return kpi.group_rates(fl, "AIRLINE")


@register("q_rates_origin", f"{FLIGHTS_WITH}\n{_group_rates_sql('ORIGIN')}")
def q_rates_origin(fl: DataFrame) -> DataFrame:
    return kpi.group_rates(fl, "ORIGIN")


@register("q_top_airline", _top_sql("AIRLINE"))
def q_top_airline(fl: DataFrame) -> DataFrame:
    return kpi.top_rates(fl, "AIRLINE", 5)


@register("q_top_origin", _top_sql("ORIGIN"))
def q_top_origin(fl: DataFrame) -> DataFrame:
    return kpi.top_rates(fl, "ORIGIN", 5)


_ROUTE_SQL = "concat(coalesce(ORIGIN_CITY, 'NA'), ' → ', coalesce(DEST_CITY, 'NA'))"


def _flights_sql(col: str, val: str, n: int = 5) -> str:
    return (f"{FLIGHTS_WITH}\nSELECT FL_NUMBER, count(*) AS Total_Flights FROM flights WHERE {col} = '{val}' "
            f"GROUP BY FL_NUMBER ORDER BY Total_Flights DESC, FL_NUMBER ASC NULLS LAST LIMIT {n}")


def _routes_sql(col: str, val: str, n: int = 5) -> str:
    return (f"{FLIGHTS_WITH}\nSELECT {_ROUTE_SQL} AS ROUTE, count(*) AS Total_Flights FROM flights "
            f"WHERE {col} = '{val}' GROUP BY ROUTE ORDER BY Total_Flights DESC, ROUTE ASC NULLS LAST LIMIT {n}")


def _route_delay_sql(col: str, val: str, n: int = 5) -> str:
    return (f"{FLIGHTS_WITH}\nSELECT {_ROUTE_SQL} AS ROUTE, {rnd('avg(DEP_DELAY)', 1)} AS Avg_Departure_Delay "
            f"FROM flights WHERE {col} = '{val}' GROUP BY ROUTE "
            f"ORDER BY Avg_Departure_Delay DESC NULLS LAST, ROUTE ASC NULLS LAST LIMIT {n}")


@register("q_flights_airline", _flights_sql("AIRLINE", AIRLINE))
def q_flights_airline(fl: DataFrame) -> DataFrame:
    return routes.top_flights(fl, "AIRLINE", AIRLINE, 5)


@register("q_flights_origin", _flights_sql("ORIGIN", ORIGIN))
def q_flights_origin(fl: DataFrame) -> DataFrame:
    return routes.top_flights(fl, "ORIGIN", ORIGIN, 5)


@register("q_routes_airline", _routes_sql("AIRLINE", AIRLINE))
def q_routes_airline(fl: DataFrame) -> DataFrame:
    return routes.top_routes(fl, "AIRLINE", AIRLINE, 5)


@register("q_routes_origin", _routes_sql("ORIGIN", ORIGIN))
def q_routes_origin(fl: DataFrame) -> DataFrame:
    return routes.top_routes(fl, "ORIGIN", ORIGIN, 5)


@register("q_route_delay_airline", _route_delay_sql("AIRLINE", AIRLINE))
def q_route_delay_airline(fl: DataFrame) -> DataFrame:
    return routes.top_route_delay(fl, "AIRLINE", AIRLINE, 5)


@register("q_route_delay_origin", _route_delay_sql("ORIGIN", ORIGIN))
def q_route_delay_origin(fl: DataFrame) -> DataFrame:
    return routes.top_route_delay(fl, "ORIGIN", ORIGIN, 5)


def _growth_cols(part: str = "") -> str:
    w = f"OVER ({part}ORDER BY YEAR)"
    return (f"{rnd(f'(CAST(Group_Flights AS DOUBLE) / lag(Group_Flights) {w} - 1) * 100', 2)} AS Group_Growth, "
            f"{rnd(f'(CAST(Industry_Flights AS DOUBLE) / lag(Industry_Flights) {w} - 1) * 100', 2)} AS Industry_Growth")


@register("q_growth_origin", f"""{FLIGHTS_WITH}
, g AS (SELECT YEAR, count(*) AS Group_Flights FROM flights WHERE ORIGIN = '{ORIGIN}' GROUP BY YEAR)
, i AS (SELECT YEAR, count(*) AS Industry_Flights FROM flights GROUP BY YEAR)
, o AS (SELECT g.YEAR, g.Group_Flights, i.Industry_Flights FROM g LEFT JOIN i ON g.YEAR = i.YEAR)
SELECT YEAR, Group_Flights, Industry_Flights, {_growth_cols()} FROM o""")
def q_growth_origin(fl: DataFrame) -> DataFrame:
    return growth.growth(fl, "ORIGIN", ORIGIN)


@register("q_growth_all_origins", f"""{FLIGHTS_WITH}
, g AS (SELECT ORIGIN, YEAR, count(*) AS Group_Flights FROM flights GROUP BY ORIGIN, YEAR)
, i AS (SELECT YEAR, count(*) AS Industry_Flights FROM flights GROUP BY YEAR)
, o AS (SELECT g.ORIGIN, g.YEAR, g.Group_Flights, i.Industry_Flights FROM g LEFT JOIN i ON g.YEAR = i.YEAR)
SELECT ORIGIN, YEAR, Group_Flights, Industry_Flights, {_growth_cols('PARTITION BY ORIGIN ')} FROM o""")
def q_growth_all_origins(fl: DataFrame) -> DataFrame:
    return growth.growth_all(fl, "ORIGIN")


_CAUSE_NAMES = ["DELAY_DUE_CARRIER", "DELAY_DUE_WEATHER", "DELAY_DUE_NAS", "DELAY_DUE_SECURITY",
                "DELAY_DUE_LATE_AIRCRAFT"]


@register("q_cause", FLIGHTS_WITH + "\n" + "\nUNION ALL\n".join(
    f"SELECT YEAR, '{c}' AS Reason, {rnd(f'avg({c})', 1)} AS Delay FROM flights GROUP BY YEAR"
    for c in _CAUSE_NAMES))
def q_cause(fl: DataFrame) -> DataFrame:
    return diagnose.cause_means(fl)


@register("q_corr", FLIGHTS_WITH + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{x}' AS x, '{y}' AS y, CAST(count_if({x} IS NOT NULL AND {y} IS NOT NULL) AS BIGINT) AS n, "
    f"{rnd(f'corr({x}, {y})', 9)} AS corr, {rnd(f'corr({x}, {y}) * corr({x}, {y})', 9)} AS r_squared FROM flights"
    for x, y in diagnose.DEFAULT_PAIRS))
def q_corr(fl: DataFrame) -> DataFrame:
    return diagnose.correlations(fl)


_SCATTER_W = [(5.0, 5.0), (5.0, 5.0), (100.0, 10.0)]


@register("q_scatter", FLIGHTS_WITH + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{x}' AS x, '{y}' AS y, CAST(floor({x} / {wx}) AS BIGINT) AS x_bin, CAST(floor({y} / {wy}) AS BIGINT) AS y_bin, "
    f"CAST(floor({x} / {wx}) AS DOUBLE) * {wx} AS x_lo, CAST(floor({y} / {wy}) AS DOUBLE) * {wy} AS y_lo, count(*) AS n "
    f"FROM flights WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6"
    for (x, y), (wx, wy) in zip(diagnose.DEFAULT_PAIRS, _SCATTER_W)))
def q_scatter(fl: DataFrame) -> DataFrame:
    return diagnose.scatter_bins(fl, widths=_SCATTER_W)


_WEATHER_SQL = f"""
, d AS (SELECT YEAR, MONTH, count(*) AS Total_Flights FROM flights WHERE ARR_DELAY > 15 GROUP BY YEAR, MONTH)
, w AS (SELECT YEAR, MONTH, count(*) AS Total_Flights_Weather FROM flights WHERE DELAY_DUE_WEATHER > 0 GROUP BY YEAR, MONTH)
, r AS (SELECT d.YEAR, d.MONTH, d.Total_Flights, coalesce(w.Total_Flights_Weather, 0) AS Total_Flights_Weather,
          {rnd('CAST(coalesce(w.Total_Flights_Weather, 0) AS DOUBLE) / d.Total_Flights * 100', 2)} AS Delay_Rate
        FROM d LEFT JOIN w ON d.YEAR = w.YEAR AND d.MONTH = w.MONTH)"""


@register("q_weather", f"{FLIGHTS_WITH}{_WEATHER_SQL}\nSELECT * FROM r")
def q_weather(fl: DataFrame) -> DataFrame:
    return diagnose.weather_rates(fl)


@register("q_weather_matrix", f"""{FLIGHTS_WITH}{_WEATHER_SQL}
SELECT MONTH, {_year_columns('Delay_Rate')} FROM r GROUP BY MONTH""")
def q_weather_matrix(fl: DataFrame) -> DataFrame:
    return diagnose.weather_matrix(diagnose.weather_rates(fl), MATRIX_YEARS)


# ----------------------------------------------------------- the SQL texts
_SQL_ORACLE = {
    "sql_1": """SELECT count(*) AS TOTAL_FLIGHTS, CAST(count_if(ARR_DELAY > 15) AS BIGINT) AS N_DELAYED_FLIGHTS,
  CAST(count_if(CANCELLED = 1) AS BIGINT) AS N_CANCELLED_FLIGHTS, CAST(count_if(DIVERTED = 1) AS BIGINT) AS N_DIVERTED_FLIGHTS,
  CAST(count_if(ARR_DELAY <= 15) AS BIGINT) AS N_ONTIME_FLIGHTS FROM flights""",
    "sql_2": "SELECT DISTINCT AIRLINE FROM flights ORDER BY AIRLINE",
    "sql_3": "SELECT YEAR, count(*) AS TOTAL_FLIGHTS FROM flights GROUP BY YEAR",
    "sql_4": "SELECT YEAR, MONTH, count(*) AS TOTAL_FLIGHTS FROM flights GROUP BY YEAR, MONTH",
}
for _k in ("YEAR", "YEAR, MONTH", "YEAR, QUARTER"):
    _SQL_ORACLE[{"YEAR": "sql_5", "YEAR, MONTH": "sql_6", "YEAR, QUARTER": "sql_7"}[_k]] = (
        f"SELECT {_k}, count(*) AS Total_Flights, "
        f"{pct('count_if(ARR_DELAY > 15)', 'count(*)', 2)} AS Delay_Rate, "
        f"{pct('count_if(ARR_DELAY <= 15)', 'count(*)', 2)} AS OnTime_Rate, "
        f"{pct('count_if(CANCELLED = 1)', 'count(*)', 2)} AS Cancel_Rate, "
        f"{pct('count_if(DIVERTED = 1)', 'count(*)', 2)} AS Divert_Rate "
        f"FROM flights WHERE AIRLINE = '{AIRLINE}' GROUP BY {_k}")


def _sql_body(name: str) -> Body:
    def body(fl: DataFrame) -> DataFrame:
        return sqlapi.run(fl.sparkSession, name, fl, airline=AIRLINE)
    return body


for _name in sqlapi.SQL:
    register(_name, f"{FLIGHTS_WITH}\n{_SQL_ORACLE[_name]}")(_sql_body(_name))


# ------------------------------------------------------ feature preparation
from ..llm.common import staged  # noqa: E402
from ..operators import design, evaluate, features  # noqa: E402
from ..operators.select import quantiles, sample_rows  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

_HASH_SQL = ("CAST(CAST(concat('0x', substr(md5(concat_ws('|', coalesce(CAST(FL_DATE AS VARCHAR), ''), "
             "coalesce(AIRLINE, ''), coalesce(CAST(FL_NUMBER AS VARCHAR), ''), coalesce(ORIGIN, ''), "
             "coalesce(DEST, ''), coalesce(CAST(CRS_DEP_TIME AS VARCHAR), ''), '42')), 1, 8)) AS BIGINT) AS DOUBLE)"
             " / 4294967296.0")

_DFE = f"""
, dfe AS (SELECT {_HASH_SQL} AS ROW_KEY, MONTH, AIRLINE, ORIGIN, DEST,
    CAST(floor(DEP_TIME / 100) AS BIGINT) AS DEP_HH, DISTANCE, CAST(floor(CRS_DEP_TIME / 100) AS BIGINT) AS CRS_DEP_HH,
    CAST(DEP_DELAY > 15 AS INTEGER) AS IS_DELAYED
  FROM flights WHERE DEP_DELAY IS NOT NULL)"""


@register("fp_medians", f"{FLIGHTS_WITH}{_DFE}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(median({c}) AS DOUBLE) AS value FROM dfe" for c in features.DELAY_NUMERIC))
def fp_medians(fl: DataFrame) -> DataFrame:
    return features.median_table(features.delay_features(fl), features.DELAY_NUMERIC)


_MODE_COLS = ["AIRLINE", "ORIGIN", "DEST", "DEST_CITY"]


@register("fp_modes", f"{FLIGHTS_WITH}\n" + "\nUNION ALL\n".join(
    f"(SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM flights WHERE {c} IS NOT NULL "
    f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in _MODE_COLS))
def fp_modes(fl: DataFrame) -> DataFrame:
    return features.mode_table(fl, _MODE_COLS)


@register("fp_impute_dest_city", f"""{FLIGHTS_WITH}
, m AS (SELECT DEST_CITY AS v FROM flights WHERE DEST_CITY IS NOT NULL GROUP BY DEST_CITY ORDER BY count(*) DESC, DEST_CITY LIMIT 1)
SELECT coalesce(DEST_CITY, (SELECT v FROM m)) AS DEST_CITY, count(*) AS n FROM flights GROUP BY 1""")
def fp_impute_dest_city(fl: DataFrame) -> DataFrame:
    d = features.impute_mode(fl.select("DEST_CITY"), ["DEST_CITY"])
    return d.groupBy("DEST_CITY").agg(F.count(F.lit(1)).alias("n"))


_LUMP = f"""{_DFE}
, st AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, count(*) AS n FROM dfe WHERE {c} IS NOT NULL GROUP BY {c}" for c in features.DELAY_CATEGORICAL)})
, sh AS (SELECT feature, level, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY feature) AS share FROM st)
, sm AS (SELECT feature, count_if(share <= 0.01) AS n_small FROM sh GROUP BY feature)
, lump AS (SELECT sh.feature, level, n, share, CASE WHEN share > 0.01 OR n_small <= 1 THEN level ELSE 'Other' END AS lumped
           FROM sh JOIN sm ON sh.feature = sm.feature)"""


@register("fp_lump", f"{FLIGHTS_WITH}{_LUMP}\nSELECT * FROM lump")
def fp_lump(fl: DataFrame) -> DataFrame:
    return features.lump_table(features.delay_features(fl), features.DELAY_CATEGORICAL, 0.01)


@register("fp_onehot", f"""{FLIGHTS_WITH}{_LUMP}
, m AS (SELECT feature, lumped, CAST(sum(n) AS BIGINT) AS ones FROM lump GROUP BY feature, lumped)
, b AS (SELECT feature, coalesce(min(lumped) FILTER (WHERE lumped <> 'Other'), 'Other') AS base FROM m GROUP BY feature)
SELECT m.feature || '_' || m.lumped AS dummy, m.ones FROM m JOIN b ON m.feature = b.feature WHERE m.lumped <> b.base""")
def fp_onehot(fl: DataFrame) -> DataFrame:
    rows = features.delay_features(fl)
    d = design.level_dictionary(rows, features.DELAY_CATEGORICAL, 0.01)
    ones = design.entries(rows, [], features.DELAY_CATEGORICAL, [], dictionary=d).groupBy("slot").agg(F.count(F.lit(1)).alias("ones"))
    names = d.filter(F.col("slot").isNotNull()).select("slot", F.concat_ws("_", "feature", "lumped").alias("dummy")).distinct()
    return names.join(ones, "slot").select("dummy", "ones")


_ENTRY_NUMBERS = "\nUNION ALL\n".join(
    f"SELECT ROW_KEY, {i} AS slot, coalesce(CAST({c} AS DOUBLE), m{i}) AS value FROM dfe, med WHERE coalesce(CAST({c} AS DOUBLE), m{i}) <> 0"
    for i, c in enumerate(features.DELAY_NUMERIC))
_ENTRY_LEVELS = "\nUNION ALL\n".join(
    f"SELECT ROW_KEY, slot, 1.0::DOUBLE AS value FROM dfe JOIN slots ON slots.feature = '{c}' AND slots.level = dfe.{c}" for c in features.DELAY_CATEGORICAL)


@register("fp_design_entries", f"""{FLIGHTS_WITH}{_LUMP}
, med AS (SELECT {', '.join(f'CAST(median({c}) AS DOUBLE) AS m{i}' for i, c in enumerate(features.DELAY_NUMERIC))} FROM dfe)
, lv AS (SELECT DISTINCT feature, lumped FROM lump)
, od AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY lumped = 'Other', lumped) AS place FROM lv)
, nb AS (SELECT feature, lumped, CAST({len(features.DELAY_NUMERIC)} - 1 + row_number() OVER (ORDER BY list_position({features.DELAY_CATEGORICAL!r}, feature), place) AS INTEGER) AS slot FROM od WHERE place > 1)
, slots AS (SELECT lump.feature, lump.level, nb.slot FROM lump JOIN nb ON lump.feature = nb.feature AND lump.lumped = nb.lumped)
{_ENTRY_NUMBERS}
UNION ALL
{_ENTRY_LEVELS}""")
def fp_design_entries(fl: DataFrame) -> DataFrame:
    """Every entry of the delay design that is not zero (slots: numbers, then levels by column and name)."""
    return design.entries(features.delay_features(fl), features.DELAY_NUMERIC, features.DELAY_CATEGORICAL, ["ROW_KEY"], 0.01)


@register("fp_design_vectors", ORACLE["fp_design_entries"])
def fp_design_vectors(fl: DataFrame) -> DataFrame:
    """The same entries read back from the assembled sparse vectors."""
    cells = design.delay_design(fl).rows.select("ROW_KEY", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return cells.filter(F.col("value") != 0)


_SANITISED = ["DISTANCE_CAT", "SEASON"]


@register("fp_sanitised_levels", f"""{FLIGHTS_WITH}
, lv AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level FROM flights WHERE {c} IS NOT NULL" for c in _SANITISED)})
SELECT regexp_replace(feature || '_' || level, '[^0-9A-Za-z_]', '_', 'g') AS dummy, count(*) AS ones FROM lv GROUP BY 1""")
def fp_sanitised_levels(fl: DataFrame) -> DataFrame:
    """0/1 columns of levels whose names hold other signs than letters, digits and underscores."""
    wide = features.one_hot(fl.select(*_SANITISED), _SANITISED, drop_first=False)
    sums = wide.agg(*[F.sum(c).alias(c) for c in wide.columns])
    return sums.unpivot([], wide.columns, "dummy", "ones")


@register("fp_split", f"""{FLIGHTS_WITH}{_DFE}
SELECT CASE WHEN ROW_KEY < 0.8 THEN 'train' ELSE 'test' END AS side, count(*) AS n FROM dfe GROUP BY 1""")
def fp_split(fl: DataFrame) -> DataFrame:
    train, test = features.split(features.delay_features(fl), 0.8)
    return (train.agg(F.count(F.lit(1)).alias("n")).select(F.lit("train").alias("side"), "n")
            .unionByName(test.agg(F.count(F.lit(1)).alias("n")).select(F.lit("test").alias("side"), "n")))


@register("fp_split_stratified", f"""{FLIGHTS_WITH}{_DFE}
, c AS (SELECT *, count(*) OVER (PARTITION BY IS_DELAYED ORDER BY ROW_KEY RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
               count(*) OVER (PARTITION BY IS_DELAYED) AS tot FROM dfe)
, t AS (SELECT IS_DELAYED, min(ROW_KEY) AS thr FROM c WHERE cum >= ceil(tot * 0.8) GROUP BY IS_DELAYED)
SELECT CASE WHEN dfe.ROW_KEY <= t.thr THEN 'train' ELSE 'test' END AS side, dfe.IS_DELAYED, count(*) AS n
FROM dfe JOIN t ON dfe.IS_DELAYED = t.IS_DELAYED GROUP BY 1, 2""")
def fp_split_stratified(fl: DataFrame) -> DataFrame:
    train, test = features.stratified_split(features.delay_features(fl), "IS_DELAYED", 0.8)
    return (train.groupBy("IS_DELAYED").agg(F.count(F.lit(1)).alias("n")).select(F.lit("train").alias("side"), "IS_DELAYED", "n")
            .unionByName(test.groupBy("IS_DELAYED").agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit("test").alias("side"), "IS_DELAYED", "n")))


@register("fp_split_quartile", f"""{FLIGHTS_WITH}
, a AS (SELECT {_HASH_SQL} AS ROW_KEY, ARR_DELAY FROM flights WHERE ARR_DELAY IS NOT NULL AND NOT isnan(ARR_DELAY) AND NOT isinf(ARR_DELAY))
, q AS (SELECT quantile_cont(ARR_DELAY, 0.25) AS q1, quantile_cont(ARR_DELAY, 0.5) AS q2, quantile_cont(ARR_DELAY, 0.75) AS q3 FROM a)
, s AS (SELECT ROW_KEY, CAST(ARR_DELAY > q1 AS INTEGER) + CAST(ARR_DELAY > q2 AS INTEGER) + CAST(ARR_DELAY > q3 AS INTEGER) AS quartile FROM a, q)
, c AS (SELECT *, count(*) OVER (PARTITION BY quartile ORDER BY ROW_KEY RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
               count(*) OVER (PARTITION BY quartile) AS tot FROM s)
, t AS (SELECT quartile, min(ROW_KEY) AS thr FROM c WHERE cum >= ceil(tot * 0.8) GROUP BY quartile)
SELECT CASE WHEN s.ROW_KEY <= t.thr THEN 'train' ELSE 'test' END AS side, s.quartile, count(*) AS n
FROM s JOIN t ON s.quartile = t.quartile GROUP BY 1, 2""")
def fp_split_quartile(fl: DataFrame) -> DataFrame:
    rows = staged(features.arrival_features(fl).select("ROW_KEY", "ARR_DELAY"), "quartile")      # two numbers a row, read seven times
    cuts = quantiles(rows, ["ARR_DELAY"], [0.25, 0.5, 0.75])["ARR_DELAY"]
    train, test = features.stratified_split(rows, "ARR_DELAY", 0.8, numeric_groups=4, cuts=cuts)
    quartile = sum((F.col("ARR_DELAY") > F.lit(x)).cast("int") for x in cuts)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side", quartile.alias("quartile")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------ evaluation (fixed score)
def _scored(fl: DataFrame) -> DataFrame:
    """A model-independent score: label = departure delayed (> 15 min),
    score = scheduled departure clock / 2500 (many tied values)."""
    d = fl.select(F.when(F.col("DEP_DELAY").isNotNull(), (F.col("DEP_DELAY") > 15).cast("int")).alias("label"),
                  (F.col("CRS_DEP_TIME") / F.lit(2500.0)).alias("score"))
    return evaluate.predict_class(evaluate.valid(d))


_SC = """
, sc AS (SELECT CAST(DEP_DELAY > 15 AS INTEGER) AS label, CRS_DEP_TIME / CAST(2500 AS DOUBLE) AS score,
           CAST(CRS_DEP_TIME / CAST(2500 AS DOUBLE) > 0.3 AS INTEGER) AS pred FROM flights WHERE DEP_DELAY IS NOT NULL)
, st AS (SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM sc GROUP BY score)
, cu AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_below, coalesce(sum(neg) OVER w, 0) AS neg_below,
           sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM st
         WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, a AS (SELECT *, P - pos_below AS tp, N - neg_below AS fp FROM cu)"""


@register("ev_confusion", f"""{FLIGHTS_WITH}{_SC}
, g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(Predicted, Actual))
, c AS (SELECT pred AS Predicted, label AS Actual, count(*) AS Freq FROM sc GROUP BY 1, 2)
SELECT g.Predicted, g.Actual, coalesce(c.Freq, 0) AS Freq FROM g LEFT JOIN c ON g.Predicted = c.Predicted AND g.Actual = c.Actual""")
def ev_confusion(fl: DataFrame) -> DataFrame:
    return evaluate.confusion(_scored(fl))


_M9 = ["ROC_AUC", "PR_AUC", "Accuracy", "Precision", "Recall", "F1_score"]


@register("ev_metrics", f"""{FLIGHTS_WITH}{_SC}
, auc AS (SELECT sum(pos * (neg_below + 0.5 * neg)) / (max(P) * max(N)) AS ROC_AUC,
    sum((pos / CAST(P AS DOUBLE)) * (CAST(tp AS DOUBLE) / (tp + fp)
        + CASE WHEN tp - pos + fp - neg = 0 THEN CAST(tp AS DOUBLE) / (tp + fp)
               ELSE CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) END) / 2) AS PR_AUC FROM a)
, cm AS (SELECT CAST(count_if(pred = 1 AND label = 1) AS DOUBLE) AS tp, CAST(count_if(pred = 1 AND label = 0) AS DOUBLE) AS fp,
    CAST(count_if(pred = 0 AND label = 1) AS DOUBLE) AS fn, CAST(count_if(pred = 0 AND label = 0) AS DOUBLE) AS tn FROM sc)
, m AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS Accuracy, tp / (tp + fp) AS Precision, tp / (tp + fn) AS Recall FROM cm)
SELECT 'fixed_score' AS model_name, {rnd('ROC_AUC', 9)} AS ROC_AUC, {rnd('PR_AUC', 9)} AS PR_AUC,
  {rnd('Accuracy', 9)} AS Accuracy, {rnd('Precision', 9)} AS Precision, {rnd('Recall', 9)} AS Recall,
  {rnd('2.0 * Precision * Recall / (Precision + Recall)', 9)} AS F1_score FROM auc, m""")
def ev_metrics(fl: DataFrame) -> DataFrame:
    r = evaluate.metrics_report(_scored(fl), "fixed_score")
    return r.select("model_name", *[F.round(c, 9).alias(c) for c in _M9])


@register("ev_metrics_interpolated", f"""{FLIGHTS_WITH}{_SC}
, g AS (SELECT P, CAST(pos AS DOUBLE) AS dt, CAST(neg AS DOUBLE) AS df, CAST(tp - pos AS DOUBLE) AS t0, CAST(fp - neg AS DOUBLE) AS f0 FROM a)
, h AS (SELECT P, dt, 1 + df / dt AS k, f0 - df / dt * t0 AS c, t0 + f0 AS n0, t0 + f0 + dt + df AS n1 FROM g WHERE dt > 0)
SELECT 'fixed_score' AS model_name, {rnd('sum(dt / k - CASE WHEN c = 0 THEN 0 ELSE c / (k * k) * ln(n1 / n0) END) / max(P)', 9)} AS PR_AUC_interpolated FROM h""")
def ev_metrics_interpolated(fl: DataFrame) -> DataFrame:
    area = evaluate.pr_auc_interpolated(evaluate.score_table(evaluate.valid(_scored(fl))))
    return area.select(F.lit("fixed_score").alias("model_name"), F.round("PR_AUC_interpolated", 9).alias("PR_AUC_interpolated"))


@register("ev_roc_curve", f"""{FLIGHTS_WITH}{_SC}
SELECT score AS threshold, CAST(fp AS DOUBLE) / N AS fpr, CAST(tp AS DOUBLE) / P AS tpr FROM a
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE""")
def ev_roc_curve(fl: DataFrame) -> DataFrame:
    return evaluate.roc_curve(evaluate.score_table(_scored(fl)))


@register("ev_pr_curve", f"""{FLIGHTS_WITH}{_SC}
SELECT score AS threshold, CAST(tp AS DOUBLE) / P AS recall, CAST(tp AS DOUBLE) / (tp + fp) AS precision FROM a""")
def ev_pr_curve(fl: DataFrame) -> DataFrame:
    return evaluate.pr_curve(evaluate.score_table(_scored(fl)))


@register("ev_regression", f"""{FLIGHTS_WITH}
, e AS (SELECT ARR_DELAY AS y, DEP_DELAY AS yhat, ARR_DELAY - DEP_DELAY AS e FROM flights
        WHERE ARR_DELAY IS NOT NULL AND DEP_DELAY IS NOT NULL)
SELECT {rnd('avg(abs(e))', 9)} AS MAE, {rnd('sqrt(avg(e * e))', 9)} AS RMSE,
  {rnd('1 - sum(e * e) / (var_pop(y) * count(*))', 9)} AS R2 FROM e""")
def ev_regression(fl: DataFrame) -> DataFrame:
    r = evaluate.regression_metrics(fl.select(F.col("ARR_DELAY").alias("y"), F.col("DEP_DELAY").alias("yhat")))
    return r.select(*[F.round(c, 9).alias(c) for c in ("MAE", "RMSE", "R2")])


# ------------------------------------------------------------- time series
from ..operators import forecast  # noqa: E402

_MONTH = "CAST(date_trunc('month', FL_DATE) AS DATE)"


def _capped(cap: float | None) -> str:
    return "ARR_DELAY" if cap is None else f"CASE WHEN ARR_DELAY IS NOT NULL THEN least(ARR_DELAY, {cap}) END"


def _monthly_sql(cap: float | None, keys: str = "", name: str = "ARR_DELAY") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}, {_MONTH}" if keys else f"GROUP BY {_MONTH}"
    return f"SELECT {k}{_MONTH} AS Month, avg({_capped(cap)}) AS {name} FROM flights {g}"


@register("ts_monthly_capped", f"{FLIGHTS_WITH}\n{_monthly_sql(200.0)}")
def ts_monthly_capped(fl: DataFrame) -> DataFrame:
    return forecast.monthly_mean(fl, "ARR_DELAY", cap=200.0)


@register("ts_monthly_capped20", f"{FLIGHTS_WITH}\n{_monthly_sql(20.0)}")
def ts_monthly_capped20(fl: DataFrame) -> DataFrame:
    return forecast.monthly_mean(fl, "ARR_DELAY", cap=20.0)


@register("ts_series_ds_y", f"{FLIGHTS_WITH}\nSELECT Month AS ds, ARR_DELAY AS y FROM ({_monthly_sql(None)})")
def ts_series_ds_y(fl: DataFrame) -> DataFrame:
    return forecast.monthly_mean(fl, "ARR_DELAY").withColumnsRenamed({"Month": "ds", "ARR_DELAY": "y"})


@register("ts_calendar_origin", f"""{FLIGHTS_WITH}
, m AS ({_monthly_sql(200.0, 'ORIGIN')})
, s AS (SELECT ORIGIN, min(Month) AS a, max(Month) AS b FROM m GROUP BY ORIGIN)
, g AS (SELECT ORIGIN, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS Month FROM s)
SELECT g.ORIGIN, g.Month, m.ARR_DELAY FROM g LEFT JOIN m ON g.ORIGIN = m.ORIGIN AND g.Month = m.Month""")
def ts_calendar_origin(fl: DataFrame) -> DataFrame:
    return forecast.calendar(forecast.monthly_mean(fl, "ARR_DELAY", 200.0, ["ORIGIN"]), ["ORIGIN"])


@register("ts_horizon", f"""{FLIGHTS_WITH}
, m AS ({_monthly_sql(200.0)})
SELECT CAST(unnest(generate_series(max(Month) + INTERVAL 1 MONTH, max(Month) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS DATE) AS Month FROM m""")
def ts_horizon(fl: DataFrame) -> DataFrame:
    return forecast.horizon(forecast.monthly_mean(fl, "ARR_DELAY", 200.0))


@register("ts_future_frame", f"""{FLIGHTS_WITH}
, m AS ({_monthly_sql(None)})
SELECT CAST(unnest(generate_series(min(Month), max(Month) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS DATE) AS ds FROM m""")
def ts_future_frame(fl: DataFrame) -> DataFrame:
    return forecast.future_frame(forecast.monthly_mean(fl, "ARR_DELAY"))


def _forecast_sql(key: str | None, cap: float = 200.0) -> str:
    k = key or "_series"
    src = (f"SELECT {key}, {_MONTH} AS Month, avg({_capped(cap)}) AS v FROM flights GROUP BY {key}, {_MONTH}" if key
           else f"SELECT 0 AS _series, {_MONTH} AS Month, avg({_capped(cap)}) AS v FROM flights GROUP BY {_MONTH}")
    z80, z95 = forecast.Z[0.80], forecast.Z[0.95]
    out_k = f"fx.{key}, " if key else ""
    return f"""{FLIGHTS_WITH}
, m AS ({src})
, f0 AS (SELECT {k}, min(Month) AS m0, max(Month) AS last_m FROM m GROUP BY {k})
, d AS (SELECT m.{k}, m.Month, CAST(date_diff('month', f0.m0, m.Month) AS DOUBLE) AS t, ln(1 + v) AS y,
          month(m.Month) AS moy FROM m JOIN f0 ON m.{k} = f0.{k} WHERE v IS NOT NULL AND v > -1)
, mm AS (SELECT {k}, moy, avg(t) AS tbar, avg(y) AS ybar FROM d GROUP BY {k}, moy)
, dv AS (SELECT d.*, t - tbar AS dt, y - ybar AS dy FROM d JOIN mm ON d.{k} = mm.{k} AND d.moy = mm.moy)
, fit AS (SELECT {k}, coalesce(regr_slope(dy, dt), regr_slope(y, t), 0) AS b FROM dv GROUP BY {k})
, lv AS (SELECT mm.{k}, moy, ybar - b * tbar AS lvl FROM mm JOIN fit ON mm.{k} = fit.{k})
, sp AS (SELECT d.{k}, stddev_samp(y - lvl - b * t) AS sigma, avg(lvl) AS lvl_all
         FROM d JOIN lv ON d.{k} = lv.{k} AND d.moy = lv.moy JOIN fit ON d.{k} = fit.{k} GROUP BY d.{k})
, fu AS (SELECT f0.{k}, b, m0, CAST(unnest(generate_series(last_m + INTERVAL 1 MONTH, last_m + INTERVAL 12 MONTH,
          INTERVAL 1 MONTH)) AS DATE) AS Month FROM f0 LEFT JOIN fit ON fit.{k} = f0.{k})
, fx AS (SELECT fu.*, coalesce(lv.lvl, sp.lvl_all) + b * CAST(date_diff('month', m0, fu.Month) AS DOUBLE) AS yhat,
          coalesce(sp.sigma, 0) AS sig
        FROM fu LEFT JOIN lv ON fu.{k} = lv.{k} AND month(fu.Month) = lv.moy LEFT JOIN sp ON fu.{k} = sp.{k})
SELECT {out_k}fx.Month, {rnd('CASE WHEN yhat IS NOT NULL THEN greatest(exp(yhat) - 1, 0) END', 6)} AS Predicted_DELAY,
  {rnd(f'CASE WHEN yhat IS NOT NULL THEN greatest(exp(yhat - {z80} * sig) - 1, 0) END', 6)} AS CI_lower,
  {rnd(f'CASE WHEN yhat IS NOT NULL THEN greatest(exp(yhat + {z95} * sig) - 1, 0) END', 6)} AS CI_upper FROM fx"""


def _round_fc(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("Predicted_DELAY", "CI_lower", "CI_upper") else F.col(c)
                       for c in df.columns])


@register("ts_forecast", _forecast_sql(None))
def ts_forecast(fl: DataFrame) -> DataFrame:
    return _round_fc(forecast.trend_season_forecast(forecast.monthly_mean(fl, "ARR_DELAY", 200.0)))


@register("ts_forecast_by_airline", _forecast_sql("AIRLINE"))
def ts_forecast_by_airline(fl: DataFrame) -> DataFrame:
    m = forecast.monthly_mean(fl, "ARR_DELAY", 200.0, ["AIRLINE"])
    return _round_fc(forecast.trend_season_forecast(m, ["AIRLINE"]))


@register("ts_fourier_by_airline")
def ts_fourier_by_airline(fl: DataFrame) -> DataFrame:
    return forecast.fourier_trend_forecast(forecast.monthly_mean(fl, "ARR_DELAY", keys=["AIRLINE"]), ["AIRLINE"])


@register("ts_fourier")
def ts_fourier(fl: DataFrame) -> DataFrame:
    return forecast.fourier_trend_forecast(forecast.monthly_mean(fl, "ARR_DELAY"))


def _residual_sql(key: str | None) -> str:
    by = f"{key}, " if key else ""
    return f"""{FLIGHTS_WITH}
, m AS (SELECT {by}{_MONTH} AS Month, avg(ARR_DELAY) AS v FROM flights GROUP BY {by}{_MONTH})
SELECT {by}date_diff('month', min(Month), max(Month)) + 13 AS n_months, count(v) AS n_known, 0.0::DOUBLE AS largest FROM m {f'GROUP BY {key}' if key else ''}"""


@register("ts_fourier_residual", _residual_sql(None))
def ts_fourier_residual(fl: DataFrame) -> DataFrame:
    """The normal equations at the fitted coefficients: largest residual, 0 for the least-squares fit."""
    r = forecast.fourier_residual(forecast.monthly_mean(fl, "ARR_DELAY"))
    return r.select("n_months", "n_known", F.round("largest", 6).alias("largest"))


@register("ts_fourier_residual_by_airline", _residual_sql("AIRLINE"))
def ts_fourier_residual_by_airline(fl: DataFrame) -> DataFrame:
    r = forecast.fourier_residual(forecast.monthly_mean(fl, "ARR_DELAY", keys=["AIRLINE"]), ["AIRLINE"])
    return r.select("AIRLINE", "n_months", "n_known", F.round("largest", 6).alias("largest"))


@register("ts_fourier_grid_by_airline", f"""{FLIGHTS_WITH}
, m AS (SELECT AIRLINE, {_MONTH} AS Month, avg(ARR_DELAY) AS v FROM flights GROUP BY AIRLINE, {_MONTH})
, g AS (SELECT AIRLINE, CAST(unnest(generate_series(min(Month), max(Month) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS DATE) AS ds FROM m GROUP BY AIRLINE)
SELECT g.AIRLINE, g.ds, {rnd('m.v', 9)} AS y, true AS in_band FROM g LEFT JOIN m ON m.AIRLINE = g.AIRLINE AND m.Month = g.ds""")
def ts_fourier_grid_by_airline(fl: DataFrame) -> DataFrame:
    """The forecast frame: its months and observations, and that every forecast lies inside its band."""
    f = forecast.fourier_trend_forecast(forecast.monthly_mean(fl, "ARR_DELAY", keys=["AIRLINE"]), ["AIRLINE"])
    return f.select("AIRLINE", "ds", F.round("y", 9).alias("y"), F.col("yhat").between(F.col("yhat_lower"), F.col("yhat_upper")).alias("in_band"))


# ------------------------------------------------------------------ models
from ..operators import explain, logistic, models, trees  # noqa: E402


def _delay_design(fl: DataFrame) -> design.Design:
    return design.delay_design(fl)


_CLASSIFIERS = [("ml_delay_logistic", design.delay_design, "IS_DELAYED", "logistic", "Logistic Regression"),
                ("ml_delay_forest", design.delay_design, "IS_DELAYED", "forest", "Random Forest"),
                ("ml_delay_boosted", design.delay_design, "IS_DELAYED", "boosted", "Boosted Trees"),
                ("ml_cancel_logistic", design.cancel_design, "IS_CANCELLED", "logistic", "Logistic Regression"),
                # a regression forest on the 0/1 target, thresholded at 0.3
                ("ml_cancel_forest", design.cancel_design, "IS_CANCELLED", "forest_regression", "Random Forest (regression)"),
                ("ml_cancel_boosted", design.cancel_design, "IS_CANCELLED", "boosted", "Boosted Trees")]

for _name, _build, _label, _kind, _title in _CLASSIFIERS:
    register(_name)(lambda fl, b=_build, y=_label, k=_kind, t=_title: models.classification_report(b(fl), y, k, t))

# confusion counts and curves of each classifier
for _name, _build, _label, _kind, _title in _CLASSIFIERS:
    register(f"{_name}_tables")(lambda fl, b=_build, y=_label, k=_kind: models.classification_tables(b(fl), y, k))


def _facts_sql(label: str, known: str, title: str) -> str:
    return f"""{FLIGHTS_WITH}
, t AS (SELECT CAST({label} AS INTEGER) AS y FROM flights WHERE {known} IS NOT NULL AND NOT {_HASH_SQL} < 0.8)
SELECT '{title}' AS model_name, count(*) AS n_rows, CAST(count_if(y = 1) AS BIGINT) AS n_positive, CAST(0 AS BIGINT) AS n_outside,
  count(*) AS confusion_total FROM t"""


for _name, _build, _label, _kind, _title in _CLASSIFIERS:
    if _kind != "boosted":
        _y = ("DEP_DELAY > 15", "DEP_DELAY") if _label == "IS_DELAYED" else ("CANCELLED = 1", "CANCELLED")
        register(f"{_name}_facts", _facts_sql(*_y, _title))(lambda fl, b=_build, y=_label, k=_kind, t=_title: models.classification_facts(b(fl), y, k, t))


def _gradient_sql(source: str, numeric: list[str], categorical: list[str]) -> str:
    """The slots of a design and the gradient that the maximum of the likelihood has."""
    levels = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY {c}" for c in categorical)
    numbers = " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in ("(Intercept)", *numeric))
    return f"""{FLIGHTS_WITH}, d AS ({source})
, st AS ({levels})
, sh AS (SELECT feature, level, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY feature) AS share FROM st)
, sm AS (SELECT feature, count_if(share <= 0.01) AS n_small FROM sh GROUP BY feature)
, lv AS (SELECT DISTINCT sh.feature, CASE WHEN share > 0.01 OR n_small <= 1 THEN level ELSE 'Other' END AS lumped FROM sh JOIN sm ON sh.feature = sm.feature)
, od AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY lumped = 'Other', TRY_CAST(lumped AS DOUBLE) NULLS LAST, lumped) AS place FROM lv)
SELECT feature, 0.0::DOUBLE AS gradient FROM ({numbers} UNION ALL SELECT feature || '_' || lumped FROM od WHERE place > 1)"""


def _gradient(d: design.Design) -> DataFrame:
    train, _ = d.split()
    return logistic.gradient(logistic.fit_logistic(train), train).select("feature", F.round("gradient", 8).alias("gradient"))


@register("ml_delay_logistic_gradient", _gradient_sql("SELECT MONTH, AIRLINE, ORIGIN, DEST FROM flights WHERE DEP_DELAY IS NOT NULL",
                                                      features.DELAY_NUMERIC, features.DELAY_CATEGORICAL))
def ml_delay_logistic_gradient(fl: DataFrame) -> DataFrame:
    """Mean gradient of the likelihood at the Newton fit, recomputed from rows and coefficients: 0 marks its only maximum."""
    return _gradient(design.delay_design(fl))


@register("ml_cancel_logistic_gradient", _gradient_sql("SELECT MONTH, ORIGIN, DEST FROM flights WHERE CANCELLED IS NOT NULL",
                                                       features.CANCEL_NUMERIC, features.CANCEL_CATEGORICAL))
def ml_cancel_logistic_gradient(fl: DataFrame) -> DataFrame:
    return _gradient(design.cancel_design(fl))


@register("ml_delay_logistic_coefficients")
def ml_delay_logistic_coefficients(fl: DataFrame) -> DataFrame:
    train, _ = design.delay_design(fl).split()
    return logistic.fit_logistic(train).table(fl.sparkSession)


@register("ml_arrival_forest")
def ml_arrival_forest(fl: DataFrame) -> DataFrame:
    return models.arrival_report(design.arrival_design(fl), "forest", "Random Forest")


@register("ml_arrival_forest_facts", f"""{ORACLE['fp_split_quartile'].rsplit('SELECT CASE', 1)[0]}
, l AS (SELECT CASE WHEN s.ROW_KEY <= t.thr THEN 0 ELSE 1 END AS test FROM s JOIN t ON s.quartile = t.quartile)
SELECT 'Random Forest' AS model_name, CAST(sum(test) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_outside FROM l""")
def ml_arrival_forest_facts(fl: DataFrame) -> DataFrame:
    """Rows of the test side, and forecasts outside the range of the training target (a forest has none)."""
    train, test = design.arrival_design(fl).split(strata_groups=4)
    m = models.fit(train, "ARR_DELAY", "forest", task="regression")
    low, high = train.rows.agg(F.min("ARR_DELAY"), F.max("ARR_DELAY")).first()
    s = F.col("score")
    outside = s.isNull() | F.isnan(s) | ~s.between(low - 1e-9, high + 1e-9)
    return m.score(test.rows).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(outside).alias("n_outside")).select(
        F.lit("Random Forest").alias("model_name"), "*")


@register("ml_arrival_boosted")
def ml_arrival_boosted(fl: DataFrame) -> DataFrame:
    return models.arrival_report(design.arrival_design(fl), "boosted", "Boosted Trees")


# ------------------------------------------------------ model explanations
def _fit_delay(fl: DataFrame, kind: str):
    train, test = _delay_design(fl).split()
    return models.fit(train, "IS_DELAYED", kind), train, test


def _importances(m: models.Fitted, spark: SparkSession) -> DataFrame:
    return trees.importance_table(trees.node_table(m.model, spark), m.feature_names, "forest" in m.kind)


@register("ex_importance_forest")
def ex_importance_forest(fl: DataFrame) -> DataFrame:
    m, _, _ = _fit_delay(fl, "forest")
    return _importances(m, fl.sparkSession)


@register("ex_importance_boosted")
def ex_importance_boosted(fl: DataFrame) -> DataFrame:
    m, _, _ = _fit_delay(fl, "boosted")
    return _importances(m, fl.sparkSession)


def _fit_arrival(fl: DataFrame, kind: str) -> models.Fitted:
    train, _ = design.arrival_design(fl).split(strata_groups=4)
    return models.fit(train, "ARR_DELAY", kind, task="regression")


@register("ex_importance_arrival_forest")
def ex_importance_arrival_forest(fl: DataFrame) -> DataFrame:
    return _importances(_fit_arrival(fl, "forest"), fl.sparkSession)


@register("ex_importance_arrival_boosted")
def ex_importance_arrival_boosted(fl: DataFrame) -> DataFrame:
    return _importances(_fit_arrival(fl, "boosted"), fl.sparkSession)


@register("ex_importance_agrees", f"""{FLIGHTS_WITH}{_LUMP}
, b AS (SELECT feature, count(DISTINCT lumped) - 1 AS slots FROM lump GROUP BY feature)
SELECT CAST({len(features.DELAY_NUMERIC)} + sum(slots) AS BIGINT) AS slots, 0.0::DOUBLE AS largest_gap,
  1.0::DOUBLE AS gain, 1.0::DOUBLE AS cover, 1.0::DOUBLE AS frequency FROM b""")
def ex_importance_agrees(fl: DataFrame) -> DataFrame:
    """The importances by aggregation over the nodes beside the fitted model's own: largest difference, and the sums."""
    m, _, _ = _fit_delay(fl, "forest")
    own = explain.importance(fl.sparkSession, m.model, m.feature_names)
    both = _importances(m, fl.sparkSession).join(own, "feature")
    return both.agg(F.count(F.lit(1)).alias("slots"), F.round(F.max(F.abs(F.col("gain") - F.col("importance"))), 9).alias("largest_gap"),
                    *[F.round(F.sum(c), 9).alias(c) for c in ("gain", "cover", "frequency")])


@register("ex_permutation_forest")
def ex_permutation_forest(fl: DataFrame) -> DataFrame:
    """Columns are permuted before encoding, so the copies stay narrow."""
    m, _, test = _fit_delay(fl, "forest")
    score = lambda d: m.score(test.encode(d, ["_perm", "IS_DELAYED"]))
    groups = {c: [c] for c in features.DELAY_FEATURES}
    return explain.permutation_importance(score, test.source.select(*features.DELAY_FEATURES, "IS_DELAYED"), "IS_DELAYED", groups, seed=42)


@register("ex_permutation_fixed", f"""{FLIGHTS_WITH}
, sc AS (SELECT CAST(DEP_DELAY > 15 AS INTEGER) AS label, CRS_DEP_TIME / CAST(2500 AS DOUBLE) AS score FROM flights WHERE DEP_DELAY IS NOT NULL)
, st AS (SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM sc GROUP BY score)
, cu AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM st)
, auc AS (SELECT {rnd('sum(pos * (neg_below + 0.5 * neg)) / (max(P) * max(N))', 9)} AS base FROM cu)
SELECT f AS feature, base AS base_auc, base AS permuted_auc, 0.0::DOUBLE AS auc_drop FROM auc, (VALUES ('MONTH'), ('DISTANCE')) v(f)""")
def ex_permutation_fixed(fl: DataFrame) -> DataFrame:
    """Permutation importances of columns that a fixed score does not use: the area stays, to the last digit shown."""
    d = fl.filter(F.col("DEP_DELAY").isNotNull()).select((F.col("DEP_DELAY") > 15).cast("int").alias("label"), "CRS_DEP_TIME", "MONTH", "DISTANCE")
    score = lambda x: x.withColumn("score", F.col("CRS_DEP_TIME") / F.lit(2500.0))
    r = explain.permutation_importance(score, d, "label", {"MONTH": ["MONTH"], "DISTANCE": ["DISTANCE"]}, seed=42)
    return r.select("feature", *[F.round(c, 9).alias(c) for c in ("base_auc", "permuted_auc")], F.abs(F.round("auc_drop", 9)).alias("auc_drop"))


@register("ex_shapley_forest")
def ex_shapley_forest(fl: DataFrame) -> DataFrame:
    """Exact Shapley values of every test row against all training rows, with the rank by |phi|."""
    m, train, test = _fit_delay(fl, "forest")
    return trees.forest_shapley(m.model, test.rows, train.rows, test.sources, ["ROW_KEY"])


@register("ex_shapley_additivity", f"""{FLIGHTS_WITH}{_DFE}
SELECT count(*) AS explained, CAST(0 AS BIGINT) AS n_off, CAST({len(features.DELAY_FEATURES)} * count(*) AS BIGINT) AS n_values FROM dfe WHERE NOT ROW_KEY < 0.8""")
def ex_shapley_additivity(fl: DataFrame) -> DataFrame:
    """Rows whose values do not add up to the model's own score less its mean over the training rows."""
    m, train, test = _fit_delay(fl, "forest")
    mean = m.score(train.rows).agg(F.avg("score")).first()[0]
    scored = m.score(test.rows).select("features", "score")
    phi = trees.forest_shapley(m.model, scored.withColumn("id", F.monotonically_increasing_id()), train.rows, test.sources, ["id", "score"])
    rows = phi.groupBy("id", "score").agg(F.sum("phi").alias("total"), F.count(F.lit(1)).alias("n"))
    off = F.abs(F.col("total") - (F.col("score") - F.lit(mean))) > 1e-9
    return rows.agg(F.count(F.lit(1)).alias("explained"), F.count_if(off).alias("n_off"), F.sum("n").alias("n_values"))


_LIN_W = {"MONTH": 0.5, "DEP_HH": 1.0, "CRS_DEP_HH": -0.25, "DISTANCE": 0.01}
_LIN_COLS = list(_LIN_W)


@register("ex_shapley_linear", f"""{FLIGHTS_WITH}
, af AS (SELECT {_HASH_SQL} AS ROW_KEY, MONTH, CAST(floor(DEP_TIME / 100) AS BIGINT) AS DEP_HH,
    CAST(floor(CRS_DEP_TIME / 100) AS BIGINT) AS CRS_DEP_HH, DISTANCE FROM flights
  WHERE ARR_DELAY IS NOT NULL AND NOT isnan(ARR_DELAY) AND NOT isinf(ARR_DELAY))
, ok AS (SELECT * FROM af WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _LIN_COLS)})
, x AS (SELECT * FROM ok ORDER BY ROW_KEY, {', '.join(_LIN_COLS)} LIMIT 5)
, z AS (SELECT * FROM ok ORDER BY ROW_KEY DESC, {', '.join(c + ' DESC' for c in _LIN_COLS)} LIMIT 1)
""" + "\nUNION ALL\n".join(
    f"SELECT x.ROW_KEY, '{c}' AS feature, {rnd(f'{w} * (x.{c} - z.{c})', 9)} AS phi FROM x, z"
    for c, w in _LIN_W.items()))
def ex_shapley_linear(fl: DataFrame) -> DataFrame:
    af = features.arrival_features(fl).select("ROW_KEY", *_LIN_COLS).na.drop("any")
    first = af.orderBy("ROW_KEY", *_LIN_COLS).limit(5)
    background = af.orderBy(F.desc("ROW_KEY"), *[F.desc(c) for c in _LIN_COLS]).limit(1)
    groups = {c: [c] for c in _LIN_COLS}
    phi = explain.shapley(explain.linear_scorer(_LIN_W), first, background, groups, permutations=16, seed=1)
    return phi.select("ROW_KEY", "feature", F.round("phi", 9).alias("phi"))


_LIN_MEAN = ", ".join(f"avg({c}) AS z_{c}" for c in _LIN_COLS)
_LIN_SIZE = "\n  UNION ALL\n".join(f"  SELECT i, ROW_KEY, {', '.join(_LIN_COLS)}, '{c}' AS feature, {rnd(f'{w} * ({c} - z_{c})', 6)} AS phi FROM ok, z" for c, w in _LIN_W.items())


@register("ex_top_by_abs", f"""{FLIGHTS_WITH}
, ok AS (SELECT *, row_number() OVER () AS i FROM (SELECT {_HASH_SQL} AS ROW_KEY, MONTH, CAST(floor(DEP_TIME / 100) AS BIGINT) AS DEP_HH,
    CAST(floor(CRS_DEP_TIME / 100) AS BIGINT) AS CRS_DEP_HH, DISTANCE FROM flights
  WHERE ARR_DELAY IS NOT NULL AND NOT isnan(ARR_DELAY) AND NOT isinf(ARR_DELAY)) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _LIN_COLS)})
, z AS (SELECT {_LIN_MEAN} FROM ok)
, phi AS (
{_LIN_SIZE})
, k AS (SELECT *, abs(phi) AS abs_phi, CAST(rank() OVER (PARTITION BY i ORDER BY abs(phi) DESC) AS INTEGER) AS rank FROM phi)
SELECT ROW_KEY, {', '.join(_LIN_COLS)}, feature, phi, abs_phi, rank FROM k WHERE rank <= 2""")
def ex_top_by_abs(fl: DataFrame) -> DataFrame:
    """The two largest contributions by size (ties kept) of a fixed linear score, for every row against the mean row."""
    af = features.arrival_features(fl).select("ROW_KEY", *_LIN_COLS).na.drop("any")
    mean = af.agg(*[F.avg(c).alias(f"z_{c}") for c in _LIN_COLS])                       # one row
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.lit(w) * (F.col(c) - F.col(f"z_{c}")), 6).alias("phi")) for c, w in _LIN_W.items()])
    phi = af.join(F.broadcast(mean)).select("ROW_KEY", *_LIN_COLS, cells.alias("cells"))
    return explain.top_cells(phi, ["ROW_KEY", *_LIN_COLS], "cells", 2)


# ------------------------------------------------ further inventory items
from ..session import new_folder  # noqa: E402
from ..sources.readers import hash_sample, read_flights_csv  # noqa: E402

_OVERVIEW_COLS = ["Total_Flights", "Delayed_Flights", "OnTime_Flights", "Cancelled_Flights", "Diverted_Flights",
                  "N_Airlines", "Short_Haul_Flights", "Medium_Haul_Flights", "Long_Haul_Flights"]


_CSV_COLS = ["FL_DATE", "AIRLINE", "ORIGIN", "DEST", "CRS_DEP_TIME", "DEP_DELAY", "ARR_DELAY", "CANCELLED", "DIVERTED", "DISTANCE"]


@register("src_csv_scan", f"""{FLIGHTS_WITH}
SELECT AIRLINE, YEAR, MONTH, DAY_OF_WEEK, count(*) AS n, CAST(count(ARR_DELAY) AS BIGINT) AS n_arrived, sum(ARR_DELAY) AS arr_delay, sum(DEP_DELAY) AS dep_delay,
  sum(CANCELLED) AS cancelled, sum(DISTANCE) AS distance, min(FL_DATE) AS first_day, max(FL_DATE) AS last_day
FROM flights GROUP BY AIRLINE, YEAR, MONTH, DAY_OF_WEEK""")
def src_csv_scan(fl: DataFrame) -> DataFrame:
    """The flights written as CSV files of two column orders and date forms, read back by header, typed, prepared and summed."""
    spark = fl.sparkSession
    folder = new_folder(spark, "flights-csv")
    rows, even = fl.select(*_CSV_COLS), F.col("CRS_DEP_TIME") % 2 == 0
    text = lambda d, form: d.withColumn("FL_DATE", F.date_format("FL_DATE", form))
    text(rows.filter(even), "yyyyMMdd").write.option("header", True).option("nullValue", "NA").csv(f"{folder}/a")
    text(rows.filter(~even), "yyyy-MM-dd").select(*_CSV_COLS[::-1]).write.option("header", True).csv(f"{folder}/b")
    back = prepare(read_flights_csv(spark, [f"{folder}/a", f"{folder}/b"], required=_CSV_COLS))
    return back.groupBy("AIRLINE", "YEAR", "MONTH", "DAY_OF_WEEK").agg(
        F.count(F.lit(1)).alias("n"), F.count("ARR_DELAY").alias("n_arrived"), F.sum("ARR_DELAY").alias("arr_delay"), F.sum("DEP_DELAY").alias("dep_delay"),
        F.sum("CANCELLED").alias("cancelled"), F.sum("DISTANCE").alias("distance"), F.min("FL_DATE").alias("first_day"), F.max("FL_DATE").alias("last_day"))


@register("src_sample_10pct", f"{FLIGHTS_WITH}\nSELECT * FROM flights WHERE {_HASH_SQL} < 0.1")
def src_sample_10pct(fl: DataFrame) -> DataFrame:
    return hash_sample(fl, 0.1, features.FLIGHT_KEY)


SAMPLE_N = 5_000        # fixed value: rows of the sample of a given size


@register("src_sample_n", f"""{FLIGHTS_WITH}
SELECT * FROM flights ORDER BY {_HASH_SQL}, {', '.join(f'{c} NULLS FIRST' for c in features.FLIGHT_KEY)} LIMIT {SAMPLE_N}""")
def src_sample_n(fl: DataFrame) -> DataFrame:
    return sample_rows(fl, SAMPLE_N, features.FLIGHT_KEY)


@register("q_overview_report", f"""{ORACLE['q_overview'].rsplit('SELECT', 1)[0]}
, o AS (SELECT{ORACLE['q_overview'].rsplit('SELECT', 1)[1]})
SELECT *, {', '.join(f"format('{{:,}}', {c}) AS {c}_text" for c in _OVERVIEW_COLS)} FROM o""")
def q_overview_report(fl: DataFrame) -> DataFrame:
    return kpi.overview_report(kpi.overview(fl))


@register("q_year_rates_joined", _period_sql("YEAR"))
def q_year_rates_joined(fl: DataFrame) -> DataFrame:
    return kpi.period_rates_joined(fl, "year", kpi.equals("AIRLINE", AIRLINE))


@register("fp_delay_features", f"{FLIGHTS_WITH}{_DFE}\nSELECT * FROM dfe")
def fp_delay_features(fl: DataFrame) -> DataFrame:
    return features.delay_features(fl)


@register("fp_cancel_features", f"""{FLIGHTS_WITH}
SELECT {_HASH_SQL} AS ROW_KEY, MONTH, ORIGIN, DEST, CAST(floor(CRS_DEP_TIME / 100) AS BIGINT) AS CRS_DEP_HH,
  CAST(CANCELLED = 1 AS INTEGER) AS IS_CANCELLED FROM flights WHERE CANCELLED IS NOT NULL""")
def fp_cancel_features(fl: DataFrame) -> DataFrame:
    return features.cancel_features(fl)


@register("fp_arrival_features", f"""{FLIGHTS_WITH}
SELECT {_HASH_SQL} AS ROW_KEY, MONTH, CAST(floor(DEP_TIME / 100) AS BIGINT) AS DEP_HH,
  CAST(floor(CRS_DEP_TIME / 100) AS BIGINT) AS CRS_DEP_HH, ORIGIN, DEST, DISTANCE, ARR_DELAY
FROM flights WHERE ARR_DELAY IS NOT NULL AND NOT isnan(ARR_DELAY) AND NOT isinf(ARR_DELAY)""")
def fp_arrival_features(fl: DataFrame) -> DataFrame:
    return features.arrival_features(fl)


@register("ts_ar_forecast_by_airline")
def ts_ar_forecast_by_airline(fl: DataFrame) -> DataFrame:
    """Seasonal autoregression per airline (capped monthly means)."""
    return forecast.ar_forecast(forecast.monthly_mean(fl, "ARR_DELAY", 200.0, ["AIRLINE"]), ["AIRLINE"])
