"""Ordered prefix sums without a single-partition window.

``Window.orderBy(x)`` with no partition moves every row to one task. Running
sums (ROC/PR curves, row numbers) are a parallel scan here:

1. aggregate to one row per distinct (group, key) (partial aggregation, so
   a key holding a third of all rows is one row with a big weight);
2. deal these rows out by ranges of (group, key), each range to a partition
   of about ``RANGE_ROWS`` rows, and sum the weights of each range;
3. a running sum inside each range, plus the sum of the group's ranges
   before it (groups + ranges rows at most: broadcast while that is within
   ``MAX_BROADCAST_ROWS``, joined by key beyond it).
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

MAX_BROADCAST_ROWS = 1_000_000  # larger statistics are joined by key
RANGE_ROWS = 1_000_000          # distinct keys of a range


def value_counts(df: DataFrame, key: str, weights: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per distinct (``by``..., ``key``) with summed weights,
    materialised once (the only pass over ``df``)."""
    by = list(by or [])
    d = (df.filter(F.col(key).isNotNull())
         .groupBy(*by, key).agg(*[F.sum(w).alias(w) for w in weights]))
    return materialize(d)


def join_stats(df: DataFrame, stats: DataFrame, on: list[str], rows: int) -> DataFrame:
    """``df`` with the one row of ``stats`` for its ``on`` values (NULL meets
    NULL). ``rows`` bounds the rows of ``stats``: they are broadcast up to
    ``MAX_BROADCAST_ROWS``, so that ``df`` is not shuffled."""
    s = stats.withColumnsRenamed({c: f"_on_{c}" for c in on})
    s = F.broadcast(s) if rows <= MAX_BROADCAST_ROWS else s
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return df.join(s, same).drop(*[f"_on_{c}" for c in on])


def prefix_sums(df: DataFrame, key: str, weights: list[str], by: list[str] | None = None,
                buckets: int | None = None) -> DataFrame:
    """One row per distinct (``by``..., ``key``) with, for each weight ``w``:
    ``w`` (sum at this key), ``w_below`` (sum over smaller keys of the
    group) and ``w_total`` (group total). NULL keys are dropped."""
    by = list(by or [])
    d = value_counts(df, key, weights, by)
    ranges = buckets or max(1, math.ceil(d.count() / RANGE_ROWS))
    order = [*by, key]
    # written down once: the ranges rest on a sample, a second evaluation may cut them elsewhere
    x = d.withColumn("_r", F.lit(0)) if ranges == 1 else materialize(
        d.repartitionByRange(ranges, *order).withColumn("_r", F.spark_partition_id()))
    groups = [*by, "_g"]
    x = x.withColumn("_g", F.lit(0))
    sums = x.groupBy(*groups, "_r").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    before = Window.partitionBy(*groups).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = sums.select(*groups, "_r",
                          *[F.coalesce(F.sum(f"_s_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weights],
                          *[F.sum(f"_s_{w}").over(whole).alias(f"{w}_total") for w in weights])
    inner = Window.partitionBy(*groups, "_r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    x = x.select(*groups, key, "_r", *weights,
                 *[F.coalesce(F.sum(w).over(inner), F.lit(0)).alias(f"_in_{w}") for w in weights])
    n = ranges + (d.select(*by).distinct().count() if by else 1)
    out = join_stats(x, offsets, [*groups, "_r"], n)
    cols = [*by, key, *weights,
            *[(F.col(f"_off_{w}") + F.col(f"_in_{w}")).alias(f"{w}_below") for w in weights],
            *[F.col(f"{w}_total") for w in weights]]
    return out.select(*cols)


def approx_quantile_table(df: DataFrame, columns: list[str], q: float = 0.5,
                          accuracy: int = 10_000) -> DataFrame:
    """(feature, value) from ``percentile_approx`` (bounded sketch per
    column, one pass); opt-in where an exact quantile is not needed."""
    one = df.agg(*[F.percentile_approx(F.col(c).cast("double"), float(q), accuracy).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "value")


def quantile_table(df: DataFrame, columns: list[str], q: float = 0.5) -> DataFrame:
    """(feature, value): exact ``q``-quantile of each numeric column, NULLs and
    NaN ignored, linear interpolation between the two neighbouring order
    statistics (the median of an even count is the mean of the middle two).
    A column without values has no row. By radix selection (:mod:`.select`)."""
    found = [(c, v) for c, v in exact_quantiles(df, columns, q).items() if v is not None]
    return df.sparkSession.createDataFrame(found, "feature string, value double")


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5) -> dict[str, float | None]:
    """:func:`quantile_table` as {column: value} (a column with no value maps to None)."""
    from .select import quantiles
    return {c: v[0] for c, v in quantiles(df, columns, [float(q)]).items()}
