"""The seven SQL queries over a registered ``flights`` view.

The texts are the analysis queries re-expressed for Spark SQL: the overview
is one conditional aggregation instead of five joined sub-queries, and the
percentage factor is a DOUBLE (``100.0`` would be a DECIMAL literal in
Spark SQL). Run with :func:`run`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import register_view


def _rates(keys: str, airline_param: str = ":airline") -> str:
    return f"""
SELECT {keys},
       COUNT(*) AS Total_Flights,
       ROUND(CAST(100 AS DOUBLE) * COUNT_IF(ARR_DELAY > 15) / COUNT(*), 2) AS Delay_Rate,
       ROUND(CAST(100 AS DOUBLE) * COUNT_IF(ARR_DELAY <= 15) / COUNT(*), 2) AS OnTime_Rate,
       ROUND(CAST(100 AS DOUBLE) * COUNT_IF(CANCELLED = 1) / COUNT(*), 2) AS Cancel_Rate,
       ROUND(CAST(100 AS DOUBLE) * COUNT_IF(DIVERTED = 1) / COUNT(*), 2) AS Divert_Rate
FROM flights
WHERE AIRLINE = {airline_param}
GROUP BY {keys}
ORDER BY {keys}"""


SQL = {
    "sql_1": """
SELECT COUNT(*) AS TOTAL_FLIGHTS,
       COUNT_IF(ARR_DELAY > 15) AS N_DELAYED_FLIGHTS,
       COUNT_IF(CANCELLED = 1) AS N_CANCELLED_FLIGHTS,
       COUNT_IF(DIVERTED = 1) AS N_DIVERTED_FLIGHTS,
       COUNT_IF(ARR_DELAY <= 15) AS N_ONTIME_FLIGHTS
FROM flights""",
    "sql_2": "SELECT DISTINCT AIRLINE FROM flights ORDER BY AIRLINE",
    "sql_3": "SELECT YEAR, COUNT(*) AS TOTAL_FLIGHTS FROM flights GROUP BY YEAR",
    "sql_4": "SELECT YEAR, MONTH, COUNT(*) AS TOTAL_FLIGHTS FROM flights GROUP BY YEAR, MONTH",
    "sql_5": _rates("YEAR"),
    "sql_6": _rates("YEAR, MONTH"),
    "sql_7": _rates("YEAR, QUARTER"),
}


def run(spark: SparkSession, name: str, flights: DataFrame | None = None,
        airline: str | None = None) -> DataFrame:
    """Run one of the seven queries; registers ``flights`` first if given.

    ``airline`` binds the ``:airline`` parameter of the rate queries.
    """
    if flights is not None:
        register_view(flights, "flights")
    text = SQL[name]
    args = {"airline": airline} if ":airline" in text else None
    if args and airline is None:
        raise ValueError(f"{name} needs an airline")
    return spark.sql(text, args=args)
