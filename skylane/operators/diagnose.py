"""Delay causes, correlations, weather-delay rate and 2-D bin counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import ARRIVAL_DELAY_THRESHOLD, delay_cause_columns
from .reshape import pivot_wide

# --- fixed values: the three relationships examined ---
DEFAULT_PAIRS = [("ARR_DELAY", "DELAY_DUE_LATE_AIRCRAFT"),
                 ("ARR_DELAY", "DELAY_DUE_WEATHER"),
                 ("DISTANCE", "AIR_TIME")]


def cause_means(df: DataFrame, digits: int = 1) -> DataFrame:
    """Mean minutes per cause column (``DELAY_DUE_*``) per YEAR, long form
    (YEAR, Reason, Delay). One aggregation, then an unpivot of the small
    per-year result; a NULL mean stays a row."""
    cols = delay_cause_columns(df.columns)
    if not cols:
        raise ValueError("no DELAY_DUE_* columns")
    wide = df.groupBy("YEAR").agg(*[F.round(F.avg(c), digits).alias(c) for c in cols])
    return wide.unpivot(["YEAR"], cols, "Reason", "Delay")


def correlations(df: DataFrame, pairs: list[tuple[str, str]] | None = None,
                 digits: int | None = 9) -> DataFrame:
    """Pearson r, r² and the number of complete pairs for each pair, in ONE
    scan (``corr`` skips rows where either side is NULL, which equals
    selecting the pair and dropping incomplete rows)."""
    pairs = pairs or DEFAULT_PAIRS
    aggs = []
    for i, (x, y) in enumerate(pairs):
        aggs += [F.corr(x, y).alias(f"r{i}"),
                 F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias(f"n{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"),
                     F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)]
    long = one.select(F.inline(F.array(*rows)))
    r = F.col("r")
    r2 = r * r
    if digits is not None:
        r, r2 = F.round(r, digits), F.round(r2, digits)
    return long.select("x", "y", "n", r.alias("corr"), r2.alias("r_squared"))


def weather_rates(df: DataFrame) -> DataFrame:
    """Per (YEAR, MONTH): delayed arrivals (``ARR_DELAY > 15``), flights with
    weather delay minutes (``DELAY_DUE_WEATHER > 0``, any arrival delay) and
    the ratio in percent (2 digits). One pass; a month without a delayed
    arrival is absent, as when the counts are joined to the delayed ones."""
    agg = df.groupBy("YEAR", "MONTH").agg(
        F.count_if(F.col("ARR_DELAY") > ARRIVAL_DELAY_THRESHOLD).alias("Total_Flights"),
        F.count_if(F.col("DELAY_DUE_WEATHER") > 0).alias("Total_Flights_Weather"))
    agg = agg.filter(F.col("Total_Flights") > 0)
    return agg.withColumn("Delay_Rate", F.round(
        F.col("Total_Flights_Weather") / F.col("Total_Flights") * F.lit(100.0), 2))


def weather_matrix(rates: DataFrame, years: list[int] | None = None) -> DataFrame:
    """MONTH rows (ascending) x one column per YEAR of ``Delay_Rate``."""
    wide = pivot_wide(rates, ["MONTH"], "YEAR", "Delay_Rate", values=years)
    return wide.orderBy(F.asc_nulls_last("MONTH"))


def scatter_bins(df: DataFrame, pairs: list[tuple[str, str]] | None = None,
                 widths: list[tuple[float, float]] | None = None) -> DataFrame:
    """2-D fixed-width bin counts for each pair (the data behind a scatter
    plot, at a size independent of the row count). Rows with a NULL on
    either side are dropped. Columns: x, y, x_bin, y_bin, x_lo, y_lo, n."""
    pairs = pairs or DEFAULT_PAIRS
    widths = widths or [(5.0, 5.0)] * len(pairs)
    parts = []
    for (x, y), (wx, wy) in zip(pairs, widths):
        parts.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"),
                              F.floor(F.col(x) / F.lit(wx)).alias("x_bin"),
                              F.floor(F.col(y) / F.lit(wy)).alias("y_bin"),
                              F.lit(wx).alias("wx"), F.lit(wy).alias("wy"),
                              (F.col(x).isNotNull() & F.col(y).isNotNull()).alias("ok")))
    cols = sorted({c for p in pairs for c in p})
    # one scan: each row yields one point per pair, then a single aggregation
    pts = df.select(*cols).select(F.inline(F.array(*parts))).filter("ok")
    return (pts.groupBy("x", "y", "x_bin", "y_bin", "wx", "wy").agg(F.count(F.lit(1)).alias("n"))
            .select("x", "y", "x_bin", "y_bin", (F.col("x_bin") * F.col("wx")).alias("x_lo"),
                    (F.col("y_bin") * F.col("wy")).alias("y_lo"), "n"))
