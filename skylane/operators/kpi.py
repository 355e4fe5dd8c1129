"""Dataset KPIs, per-period rates, mean delays, rate rankings, histogram.

Every operator is ONE aggregation over ONE scan: the five filtered
sub-aggregations joined back together (the way the analyses are usually
written) become conditional counts in a single ``groupBy().agg()``; Spark
plans partial aggregation map-side, so a hot group (one airline holding a
third of the flights) is pre-summed in every task before the shuffle and
costs nothing extra.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from ..sources.schema import ARRIVAL_DELAY_THRESHOLD, DISTANCE_LEVELS, SEASON_DISPLAY_ORDER

GRAINS = {
    "year": ["YEAR"],
    "quarter": ["YEAR", "QUARTER"],
    "month": ["YEAR", "MONTH"],
    "dow": ["YEAR", "DAY_NUM", "DAY_OF_WEEK"],
}

_THR = ARRIVAL_DELAY_THRESHOLD


def _keys(grain: str | list[str]) -> list[str]:
    return list(GRAINS[grain]) if isinstance(grain, str) else list(grain)


def equals(column: str, value) -> Column:
    return F.col(column) == F.lit(value)


def _check(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {missing}")


# ---------------------------------------------------------------- overview
def overview(df: DataFrame) -> DataFrame:
    """One row of dataset counts in a single pass.

    The distinct airline count is computed with the same scan (Spark
    expands it into a distinct-then-count aggregation, still one read).
    """
    a, dc = F.col("ARR_DELAY"), F.col("DISTANCE_CAT")
    return df.agg(
        F.count(F.lit(1)).alias("Total_Flights"),
        F.count_if(a > _THR).alias("Delayed_Flights"),
        F.count_if(a <= _THR).alias("OnTime_Flights"),
        F.count_if(F.col("CANCELLED") == 1).alias("Cancelled_Flights"),
        F.count_if(F.col("DIVERTED") == 1).alias("Diverted_Flights"),
        F.count_distinct("AIRLINE").alias("N_Airlines"),
        F.count_if(dc == DISTANCE_LEVELS[0]).alias("Short_Haul_Flights"),
        F.count_if(dc == DISTANCE_LEVELS[1]).alias("Medium_Haul_Flights"),
        F.count_if(dc == DISTANCE_LEVELS[2]).alias("Long_Haul_Flights"),
    )


def overview_report(df_overview: DataFrame) -> DataFrame:
    """Display columns with thousands separators next to the numbers."""
    return df_overview.select("*", *[F.format_number(F.col(c), 0).alias(f"{c}_text")
                                     for c in df_overview.columns])


def distinct_values(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """Sorted distinct values; ``dropna=False`` keeps a NULL row (SQL form)."""
    _check(df, [column])
    d = df.select(column).distinct()
    if dropna:
        d = d.filter(F.col(column).isNotNull())
    return d.orderBy(F.asc_nulls_last(column))


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    e = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(e.alias(f"N_{column}"))


# ------------------------------------------------------------- per period
def period_counts(df: DataFrame, grain: str | list[str], name: str = "Total_Flights",
                  where: Column | None = None) -> DataFrame:
    """Rows per period (or any key list) under an output name of choice."""
    d = df if where is None else df.filter(where)
    return d.groupBy(*_keys(grain)).agg(F.count(F.lit(1)).alias(name))


def period_rates(df: DataFrame, grain: str | list[str], where: Column | None = None) -> DataFrame:
    """Totals and four rates per period in one aggregation.

    Delayed = ``ARR_DELAY > 15``, on time = ``<= 15``; a NULL delay is in
    neither, so the two rates need not add up to 100. Rates are percent of
    all rows of the period, rounded half-up to 2 digits.
    """
    keys = _keys(grain)
    d = df if where is None else df.filter(where)
    a = F.col("ARR_DELAY")
    agg = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("Total_Flights"),
        F.count_if(a > _THR).alias("Delayed_Flights"),
        F.count_if(a <= _THR).alias("OnTime_Flights"),
        F.count_if(F.col("CANCELLED") == 1).alias("Cancelled_Flights"),
        F.count_if(F.col("DIVERTED") == 1).alias("Diverted_Flights"),
    )
    t = F.col("Total_Flights")
    return agg.withColumns({
        "Arrival_Delay_Rate": C.pct(F.col("Delayed_Flights"), t, 2),
        "OnTime_Rate": C.pct(F.col("OnTime_Flights"), t, 2),
        "Cancel_Rate": C.pct(F.col("Cancelled_Flights"), t, 2),
        "Divert_Rate": C.pct(F.col("Diverted_Flights"), t, 2),
    })


def left_join_all(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Fold of left joins on ``on`` with NULL-safe key equality.

    For tables of one row per period; where all columns come from the same
    rows, one conditional aggregation (:func:`period_rates`) needs no join.
    """
    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.select(*[F.col(k).alias(f"_r_{k}") for k in on],
                         *[c for c in right.columns if c not in on])
        cond = reduce(lambda x, y: x & y, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in on])
        return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in on])
    return reduce(step, frames)


def period_rates_joined(df: DataFrame, grain: str | list[str], where: Column | None = None) -> DataFrame:
    """Same answer as :func:`period_rates` as a fold of left joins of five
    tables (a period without a count has no row in that count's table). All
    five come from one aggregation, stored once: a row per period."""
    keys = _keys(grain)
    d = df if where is None else df.filter(where)
    a = F.col("ARR_DELAY")
    classes = {"Delayed_Flights": a > _THR, "OnTime_Flights": a <= _THR, "Cancelled_Flights": F.col("CANCELLED") == 1, "Diverted_Flights": F.col("DIVERTED") == 1}
    counts = materialize(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("Total_Flights"), *[F.count_if(c).alias(n) for n, c in classes.items()]))
    parts = [counts.select(*keys, "Total_Flights"), *[counts.filter(F.col(n) > 0).select(*keys, n) for n in classes]]
    j = left_join_all(parts, keys).na.fill(0, subset=list(classes))
    t = F.col("Total_Flights")
    return j.withColumns({
        "Arrival_Delay_Rate": C.pct(F.col("Delayed_Flights"), t, 2),
        "OnTime_Rate": C.pct(F.col("OnTime_Flights"), t, 2),
        "Cancel_Rate": C.pct(F.col("Cancelled_Flights"), t, 2),
        "Divert_Rate": C.pct(F.col("Diverted_Flights"), t, 2),
    })


def mean_by(df: DataFrame, keys: list[str], value: str = "DEP_DELAY", digits: int = 1,
            name: str = "Avg_Departure_Delay", where: Column | None = None) -> DataFrame:
    """Rounded mean ignoring NULLs per key list; an all-NULL group is NULL."""
    d = df if where is None else df.filter(where)
    return d.groupBy(*keys).agg(F.round(F.avg(value), digits).alias(name))


def hourly_delay(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Mean departure delay per (YEAR, DEP_HOUR); hour 24 is the NULL group."""
    return mean_by(df, ["YEAR", "DEP_HOUR"], where=where)


def seasonal_delay(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Mean departure delay per (YEAR, SEASON), long form."""
    return mean_by(df, ["YEAR", "SEASON"], where=where)


def seasonal_matrix(long: DataFrame, years: list[int] | None = None) -> DataFrame:
    """SEASON rows (Winter, Summer, Spring, Fall) x one column per year.

    The year list is collected once from the (tiny) aggregated frame, so
    the pivot has a fixed schema; a season without data is a row of NULLs.
    """
    from .reshape import level_order_join, pivot_wide
    wide = pivot_wide(long, ["SEASON"], "YEAR", "Avg_Departure_Delay", values=years)
    return level_order_join(wide, "SEASON", SEASON_DISPLAY_ORDER)


# ------------------------------------------------------------ group rates
def group_rates(df: DataFrame, group_cols: str | list[str]) -> DataFrame:
    """Per group: flights, departures late (``DEP_DELAY > 0``), cancellations
    and the two rates (3 digits), ordered by delay rate then key."""
    keys = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    return _group_rates(df, keys).orderBy(F.desc_nulls_last("delay_rate"), *[F.asc_nulls_last(k) for k in keys])


def _group_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    _check(df, keys)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.count_if(F.col("DEP_DELAY") > 0).alias("delay_flights"),
        F.coalesce(F.sum("CANCELLED"), F.lit(0.0)).alias("cancelled_flights"),
    )
    t = F.col("total_flights")
    return agg.withColumns({
        "delay_rate": C.pct(F.col("delay_flights"), t, 3),
        "cancel_rate": C.pct(F.col("cancelled_flights"), t, 3),
    })


def top_rates(df: DataFrame, group_col: str, n: int = 5) -> DataFrame:
    """Top ``n`` groups by delay rate and top ``n`` by cancel rate.

    ``ranking`` says which list a row belongs to, ``position`` its place.
    Ties: by key for the delay list; by delay rate then key for the cancel
    list (it is a re-sort of the delay-ordered table). Each list is a
    ``TakeOrderedAndProject`` over the unsorted per-group aggregate, whose
    exchange both lists share.
    """
    rates = _group_rates(df, [group_col])
    k = F.asc_nulls_last(group_col)
    by_delay = rates.orderBy(F.desc_nulls_last("delay_rate"), k).limit(n)
    by_cancel = rates.orderBy(F.desc_nulls_last("cancel_rate"), F.desc_nulls_last("delay_rate"), k).limit(n)

    def tag(d: DataFrame, name: str, order: list[Column]) -> DataFrame:
        w = Window.orderBy(*order)   # at most n rows: a single small partition
        return d.select(F.lit(name).alias("ranking"), F.row_number().over(w).alias("position"), "*")

    return tag(by_delay, "delay", [F.desc_nulls_last("delay_rate"), k]).unionByName(
        tag(by_cancel, "cancel", [F.desc_nulls_last("cancel_rate"), F.desc_nulls_last("delay_rate"), k]))


# --------------------------------------------------------------- histogram
def histogram(df: DataFrame, value: str = "ARR_DELAY", width: float = 5.0, origin: float = 0.0,
              where: Column | None = None) -> DataFrame:
    """Fixed-width bin counts ``[lo, lo+width)``; bins without rows are absent."""
    d = df if where is None else df.filter(where)
    b = F.floor((F.col(value) - F.lit(float(origin))) / F.lit(float(width)))
    return (d.filter(F.col(value).isNotNull())
            .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"bin_lo": F.col("bin") * float(width) + float(origin),
                          "bin_hi": (F.col("bin") + 1) * float(width) + float(origin)}))


def delayed_histogram(df: DataFrame, width: float = 5.0) -> DataFrame:
    """Distribution of arrival delay among delayed flights (> 15 min)."""
    return histogram(df, "ARR_DELAY", width, 0.0, F.col("ARR_DELAY") > _THR)
