"""Top-n flights and routes for one value of any column.

Each list is a filter pushed to the scan, one partial+final aggregation and
a ``TakeOrderedAndProject`` (every task keeps its own top n; only n rows per
task reach the final merge). Ties are broken by the ascending key so the
top n is reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _subset(df: DataFrame, group_col: str, group_value) -> DataFrame:
    if group_col not in df.columns:
        raise ValueError(f"unknown column {group_col!r}")
    return df.filter(F.col(group_col) == F.lit(group_value))


def with_route(df: DataFrame, name: str = "ROUTE") -> DataFrame:
    """``ORIGIN_CITY → DEST_CITY``; a missing city is written ``NA``."""
    return df.withColumn(name, C.route_label("ORIGIN_CITY", "DEST_CITY"))


def top_counts(df: DataFrame, key: str, n: int, name: str = "Total_Flights") -> DataFrame:
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc_nulls_last(key)).limit(n))


def top_flights(df: DataFrame, group_col: str, group_value, n: int = 5) -> DataFrame:
    """Most frequent flight numbers within ``group_col == group_value``."""
    return top_counts(_subset(df, group_col, group_value), "FL_NUMBER", n)


def top_routes(df: DataFrame, group_col: str, group_value, n: int = 5) -> DataFrame:
    """Most frequent city-to-city routes within the subset."""
    return top_counts(with_route(_subset(df, group_col, group_value)).select("ROUTE"), "ROUTE", n)


def top_route_delay(df: DataFrame, group_col: str, group_value, n: int = 5) -> DataFrame:
    """Routes with the highest mean departure delay (1 digit; sorted on the
    rounded value, then route). No minimum flight count, as in the analysis."""
    d = with_route(_subset(df, group_col, group_value)).select("ROUTE", "DEP_DELAY")
    return (d.groupBy("ROUTE").agg(F.round(F.avg("DEP_DELAY"), 1).alias("Avg_Departure_Delay"))
            .orderBy(F.desc_nulls_last("Avg_Departure_Delay"), F.asc_nulls_last("ROUTE")).limit(n))
