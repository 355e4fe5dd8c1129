"""Derived calendar, distance, hour and season columns (one projection)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C


def as_date(df: DataFrame, c: str = "FL_DATE") -> DataFrame:
    """Make ``c`` a DATE: parse text (two formats), truncate timestamps."""
    t = df.schema[c].dataType
    if isinstance(t, T.DateType):
        return df
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(c, F.col(c).cast("date"))
    return df.withColumn(c, C.parse_date(F.col(c).cast("string")))


def prepare(df: DataFrame) -> DataFrame:
    """Add YEAR, MONTH, QUARTER, DAY_NUM (Mon=1), DAY_OF_WEEK, DISTANCE_CAT,
    DEP_HOUR (0..23, else NULL) and SEASON.

    Everything is a narrow projection fused into the scan's codegen stage;
    nothing here shuffles.
    """
    df = as_date(df)
    d = F.col("FL_DATE")
    df = df.withColumns({
        "YEAR": F.year(d),
        "MONTH": F.month(d),
        "QUARTER": F.quarter(d),
        "DAY_NUM": C.weekday_number(d),
    })
    extra = {"DAY_OF_WEEK": C.weekday_name("DAY_NUM"), "SEASON": C.season("MONTH")}
    if "DISTANCE" in df.columns:
        extra["DISTANCE_CAT"] = C.distance_category("DISTANCE")
    if "CRS_DEP_TIME" in df.columns:
        extra["DEP_HOUR"] = C.hour_category("CRS_DEP_TIME")
    return df.withColumns(extra)
