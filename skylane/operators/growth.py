"""Year-on-year growth of a group against the whole market (industry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _growth(x: str, w: Window) -> Column:
    prev = F.lag(F.col(x)).over(w)
    return F.round((F.col(x) / prev - F.lit(1)) * F.lit(100), 2)


def growth(df: DataFrame, group_col: str, group_value) -> DataFrame:
    """YEAR, Group_Flights, Industry_Flights, Group_Growth, Industry_Growth.

    One scan, one aggregation by YEAR counting both the group and all
    flights; years without a group flight are dropped (the group's years
    drive the table), and both growths use the previous *present* year.
    The window runs over at most one row per year.
    """
    if group_col not in df.columns:
        raise ValueError(f"unknown column {group_col!r}")
    per_year = (df.groupBy("YEAR")
                .agg(F.count_if(F.col(group_col) == F.lit(group_value)).alias("Group_Flights"),
                     F.count(F.lit(1)).alias("Industry_Flights"))
                .filter(F.col("Group_Flights") > 0))
    w = Window.orderBy("YEAR")
    return per_year.select("YEAR", "Group_Flights", "Industry_Flights",
                           _growth("Group_Flights", w).alias("Group_Growth"),
                           _growth("Industry_Flights", w).alias("Industry_Growth"))


def growth_all(df: DataFrame, group_col: str) -> DataFrame:
    """The same table for every value of ``group_col`` in one job.

    One lazy plan: both sides read the same per (group, YEAR) counts, whose
    exchange Spark runs once. The industry side has one row per year, so AQE
    turns the join into a broadcast from its runtime size. The lag window is
    partitioned by group: each task holds one group's years.
    """
    if group_col not in df.columns:
        raise ValueError(f"unknown column {group_col!r}")
    g = df.groupBy(group_col, "YEAR").agg(F.count(F.lit(1)).alias("Group_Flights"))
    ind = g.groupBy("YEAR").agg(F.sum("Group_Flights").alias("Industry_Flights"))
    j = g.join(ind, "YEAR", "left")
    w = Window.partitionBy(group_col).orderBy("YEAR")
    return j.select(group_col, "YEAR", "Group_Flights", "Industry_Flights",
                    _growth("Group_Flights", w).alias("Group_Growth"),
                    _growth("Industry_Flights", w).alias("Industry_Growth"))
