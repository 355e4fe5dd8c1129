"""Monthly delay series and per-series forecasts, many series in one job.

* :func:`monthly_mean` - mean of a (optionally capped) value per month and key.
* :func:`calendar` / :func:`horizon` / :func:`future_frame` - month grids
  from ``sequence`` + ``explode`` (one small row per key expands to its
  months), so gaps are explicit NULL months instead of silently shifted
  points.
* :func:`trend_season_forecast` - per key, on the log1p scale: the joint
  least-squares fit of a linear trend over the month index plus a level
  per month of year (slope from within-month deviations, ``regr_slope``),
  and the residual spread for the intervals. Only aggregations and joins
  on (key, month): no Python.
* :func:`fourier_trend_forecast` - per key, a piecewise-linear trend plus
  yearly Fourier terms; the normal equations are sums over the rows, and
  one small row per series is solved.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..session import materialize

# --- fixed values: normal quantiles of the two default interval levels ---
Z = {0.80: 1.2815515655446004, 0.95: 1.959963984540054}


def monthly_mean(df: DataFrame, value: str = "ARR_DELAY", cap: float | None = None,
                 keys: list[str] | None = None, name: str | None = None) -> DataFrame:
    """(keys..., Month, <name>): mean per calendar month, NULLs ignored;
    ``cap`` replaces values above it by the cap (NULL stays NULL)."""
    keys = list(keys or [])
    v = C.cap(value, cap) if cap is not None else F.col(value)
    return (df.select(*keys, C.month_start("FL_DATE").alias("Month"), v.alias("_v"))
            .groupBy(*keys, "Month").agg(F.avg("_v").alias(name or value)))


def _months(start, stop) -> F.Column:
    return F.explode(F.sequence(start, stop, F.expr("INTERVAL 1 MONTH")))


def calendar(monthly: DataFrame, keys: list[str] | None = None, value: str = "ARR_DELAY",
             fill: float | str | None = None) -> DataFrame:
    """Every month from each key's first to its last observed month; months
    without data carry a NULL value, or with ``fill`` a constant or
    ``"previous"`` (last observed value of the series; the window holds one
    series' months)."""
    from pyspark.sql import Window
    keys = list(keys or [])
    monthly = materialize(monthly)          # (series x months) rows, read twice below
    span = monthly.groupBy(*keys).agg(F.min("Month").alias("_a"), F.max("Month").alias("_b"))
    grid = span.select(*keys, _months(F.col("_a"), F.col("_b")).alias("Month"))
    out = grid.join(monthly.select(*keys, "Month", value), [*keys, "Month"], "left")
    if fill is None:
        return out
    if fill == "previous":
        if not keys:
            out, part = out.withColumn("_series", F.lit(0)), ["_series"]
        else:
            part = keys
        w = Window.partitionBy(*part).orderBy("Month").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(value, F.last(value, ignorenulls=True).over(w))
        return out.drop("_series") if not keys else out
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(float(fill))))


def horizon(monthly: DataFrame, keys: list[str] | None = None, h: int = 12) -> DataFrame:
    """The ``h`` months after each key's last observed month."""
    keys = list(keys or [])
    last = monthly.groupBy(*keys).agg(F.max("Month").alias("_b"))
    return last.select(*keys, _months(F.add_months("_b", 1), F.add_months("_b", h)).alias("Month"))


def future_frame(monthly: DataFrame, keys: list[str] | None = None, h: int = 12) -> DataFrame:
    """History plus ``h`` months: first observed month to last + h."""
    keys = list(keys or [])
    span = monthly.groupBy(*keys).agg(F.min("Month").alias("_a"), F.max("Month").alias("_b"))
    return span.select(*keys, _months(F.col("_a"), F.add_months("_b", h)).alias("ds"))


def trend_season_forecast(monthly: DataFrame, keys: list[str] | None = None, value: str = "ARR_DELAY",
                          h: int = 12, lower_level: float = 0.80, upper_level: float = 0.95,
                          log: bool = True) -> DataFrame:
    """(keys..., Month, Predicted_DELAY, CI_lower, CI_upper) for the ``h``
    months after each key's history.

    The lower bound uses ``lower_level`` and the upper bound
    ``upper_level`` (by default 80 % and 95 %, so the band is asymmetric,
    as in the analysis). Values are back-transformed with ``expm1`` and
    floored at 0. Month index t counts months from the key's first month,
    so gaps keep their true distance; a month whose mean is <= -1 has no
    log1p and is left out of the fit.
    """
    keys = list(keys or [])
    single = not keys
    if single:                      # the whole table is one series
        monthly, keys = monthly.withColumn("_series", F.lit(0)), ["_series"]
    # the series (keys x months) is read by every step below: compute it once
    monthly = materialize(monthly)
    # the first and last month of the series itself, fitted or not
    first = monthly.groupBy(*keys).agg(F.min("Month").alias("_m0"), F.max("Month").alias("_last"))
    d = monthly.filter(F.col(value).isNotNull()).join(first.drop("_last"), keys)
    t = F.months_between("Month", "_m0").cast("int").cast("double")
    y = F.log1p(F.col(value)) if log else F.col(value)
    # months whose log1p is undefined (mean <= -1) are left out of the fit
    d = (d.select(*keys, "Month", t.alias("t"), y.alias("y"), F.month("Month").alias("moy"))
         .filter(F.col("y").isNotNull() & ~F.isnan("y")))
    # joint least squares of y = level(month of year) + b * t: the slope
    # comes from deviations around each month-of-year mean (so seasonal
    # offsets cannot leak into the trend); every frame below is per
    # series or per (series, month of year)
    mm = d.groupBy(*keys, "moy").agg(F.avg("t").alias("tbar"), F.avg("y").alias("ybar"))
    dev = d.join(mm, [*keys, "moy"]).select(*keys, "Month", (F.col("t") - F.col("tbar")).alias("dt"),
                                            (F.col("y") - F.col("ybar")).alias("dy"), "t", "y")
    fit = dev.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("dy", "dt"), F.regr_slope("y", "t"), F.lit(0.0)).alias("b"))
    lvl = mm.join(fit, keys).select(*keys, "moy", (F.col("ybar") - F.col("b") * F.col("tbar")).alias("lvl"))
    spread = (d.join(lvl, [*keys, "moy"]).join(fit.select(*keys, "b"), keys)
              .groupBy(*keys).agg(F.stddev_samp(F.col("y") - F.col("lvl") - F.col("b") * F.col("t"))
                                  .alias("sigma"), F.avg("lvl").alias("lvl_all")))
    # a series without any fitted month keeps its rows, with NULL predictions
    fut = (first.join(fit, keys, "left")
           .select(*keys, "b", "_m0",
                   _months(F.add_months("_last", 1), F.add_months("_last", h)).alias("Month")))
    fut = fut.withColumns({"t": F.months_between("Month", "_m0").cast("int").cast("double"),
                           "moy": F.month("Month")})
    fut = fut.join(lvl, [*keys, "moy"], "left").join(spread, keys, "left")
    # a month of year never observed takes the mean level
    yhat = F.coalesce(F.col("lvl"), F.col("lvl_all")) + F.col("b") * F.col("t")
    sig = F.coalesce(F.col("sigma"), F.lit(0.0))
    back = (lambda e: F.expm1(e)) if log else (lambda e: e)
    zl, zu = _z(lower_level), _z(upper_level)
    out_keys = [] if single else keys
    return fut.select(*out_keys, "Month",
                      C.floor_at(back(yhat), 0.0).alias("Predicted_DELAY"),
                      C.floor_at(back(yhat - F.lit(zl) * sig), 0.0).alias("CI_lower"),
                      C.floor_at(back(yhat + F.lit(zu) * sig), 0.0).alias("CI_upper"))


def _z(level: float) -> float:
    if level in Z:
        return Z[level]
    from statistics import NormalDist
    return NormalDist().inv_cdf(0.5 + level / 2.0)


def fourier_design(monthly: DataFrame, keys: list[str] | None = None, value: str = "ARR_DELAY", h: int = 12, order: int = 3,
                   n_changepoints: int = 5, changepoint_range: float = 0.8, penalty: float = 1.0) -> DataFrame:
    """(keys..., ds, y, x, ridge, n_terms): a row per month of the history
    (gaps too, y NULL) and of ``h`` months beyond, with the values ``x`` of
    all terms: 1, the slope, ``n_changepoints`` hinges, ``order`` sine/cosine
    pairs. Terms that a short series does without are 0 throughout.

    Terms in use (``n_terms``): each has two observations at least; first the
    slope, then pairs of the season, then hinges, evenly spaced over the
    first ``changepoint_range`` of the history. ``ridge`` is the penalty of
    each term (hinges only)."""
    keys = list(keys or [])
    d = calendar(monthly, keys, value)
    by = keys or ["_series"]
    d = d if keys else d.withColumn("_series", F.lit(0))
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    months = lambda a, b: ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("double")
    # a row per series
    one = d.groupBy(*by).agg(F.min("Month").alias("first"), F.max("Month").alias("last"), F.max(F.when(ok, F.col("Month"))).alias("seen"),
                             F.count_if(ok).cast("int").alias("n"))
    room = F.floor(F.col("n") / 2).cast("int")
    pairs = F.least(F.lit(order), F.greatest(F.lit(0), F.floor((room - 2) / 2).cast("int")))
    one = one.select(*by, "first", "last", (room >= 2).alias("slope"), pairs.alias("pairs"),
                     F.greatest(F.lit(1.0), F.coalesce(months(F.col("seen"), F.col("first")), F.lit(1.0))).alias("span"),
                     F.when(pairs == order, F.least(F.lit(n_changepoints), F.greatest(F.lit(0), room - 2 - 2 * pairs))).otherwise(0).alias("hinges"))
    grid = one.select("*", F.explode(F.sequence("first", F.add_months("last", h), F.expr("interval 1 month"))).alias("ds"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"g.{k}")) for k in by] + [F.col("m.Month") == F.col("g.ds")]
    rows = grid.alias("g").join(d.alias("m"), reduce(and_, same), "left").select("g.*", F.when(ok, F.col(f"m.{value}")).alias("y"))
    t, span, turn = months(F.col("ds"), F.col("first")), F.col("span"), F.month("ds") * (math.pi / 6.0)
    hinge = [F.when(F.col("hinges") >= i, F.greatest(F.lit(0.0), t - F.lit(changepoint_range) * span * (i / (F.col("hinges") + 1.0))) / span).otherwise(0.0)
             for i in range(1, n_changepoints + 1)]
    waves = [F.when(F.col("pairs") >= k, f(turn * k)).otherwise(0.0) for k in range(1, order + 1) for f in (F.sin, F.cos)]
    x = [F.lit(1.0), F.when(F.col("slope"), t / span).otherwise(0.0), *hinge, *waves]
    ridge = [0.0, 0.0, *[float(penalty)] * n_changepoints, *[0.0] * (2 * order)]
    n_terms = F.lit(1) + F.col("slope").cast("int") + F.col("hinges") + 2 * F.col("pairs")
    return rows.select(*keys, "ds", "y", F.array(*x).alias("x"), F.array(*[F.lit(r) for r in ridge]).alias("ridge"), n_terms.cast("int").alias("n_terms"))


def fourier_fit(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., beta, n, n_terms): least squares with the ridge of each term, per
    series, from the summed normal equations (a small row per series, solved by itself).

    A series without observations has no row."""
    @F.pandas_udf("array<double>")
    def solved(xx: pd.Series, xy: pd.Series, ridge: pd.Series) -> pd.Series:
        out = []
        for a, b, r in zip(xx, xy, ridge, strict=True):
            size = len(b)
            m = np.zeros((size, size))
            m[np.triu_indices(size)] = a
            m = m + np.triu(m, 1).T + np.diag(r) + np.diag((np.diagonal(m) == 0).astype(float))       # terms not in use: 0
            out.append(np.linalg.lstsq(m, np.asarray(b), rcond=1e-13)[0])
        return pd.Series(out)

    keys = list(keys or [])
    size = len(rows.select("ridge").first()[0]) if rows.select("ridge").head(1) else 0
    x = [F.col("x")[i] for i in range(size)]
    known = rows.filter(F.col("y").isNotNull())
    sums = known.groupBy(*keys).agg(F.array(*[F.sum(x[i] * x[j]) for i in range(size) for j in range(i, size)]).alias("xx"),
                                    F.array(*[F.sum(a * F.col("y")) for a in x]).alias("xy"), F.first("ridge").alias("ridge"),
                                    F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"))
    return sums.filter(F.col("n") > 0).select(*keys, solved("xx", "xy", "ridge").alias("beta"), "n", "n_terms")


def _with_fit(rows: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with beta, n and the value fitted; NULL where a series has no fit."""
    f = fit.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "beta", "n")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]) if keys else F.lit(True)
    d = rows.join(f, same, "left").drop(*[f"_of_{k}" for k in keys]) if keys else rows.join(F.broadcast(f), same, "left")    # one row
    products = F.zip_with("x", "beta", lambda a, b: a * b)
    return d.withColumn("yhat", F.when(F.col("beta").isNotNull(), F.aggregate(products, F.lit(0.0), lambda s, p: s + p)))


def fourier_trend_forecast(monthly: DataFrame, keys: list[str] | None = None, value: str = "ARR_DELAY",
                           h: int = 12, order: int = 3, n_changepoints: int = 5,
                           changepoint_range: float = 0.8, penalty: float = 1.0,
                           interval: float = 0.80) -> DataFrame:
    """Additive trend + yearly seasonality per key, history and ``h`` future
    months (keys..., ds, y, yhat, yhat_lower, yhat_upper).

    Trend: slope plus ridge-penalised hinges; seasonality: sine/cosine pairs
    (:func:`fourier_design`), fitted from sums over the rows
    (:func:`fourier_fit`), so a series is never gathered in one task.

    A short series gets fewer terms: with under four observations the
    forecast is the mean. The band uses the residual degrees of freedom and
    is NULL where there are none; a series without any observation has NULL
    forecasts.
    """
    keys = list(keys or [])
    rows = materialize(fourier_design(monthly, keys, value, h, order, n_changepoints, changepoint_range, penalty))     # a row per series and month
    d = _with_fit(rows, fourier_fit(rows, keys), keys)
    error = F.col("y") - F.col("yhat")
    free = F.col("n") - F.col("n_terms")
    spread = d.groupBy(*keys).agg(F.sum(error * error).alias("_sse"), F.first(free, True).alias("_free"))
    spread = spread.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.when(F.col("_free") > 0, F.sqrt(F.col("_sse") / F.col("_free"))).alias("_sd"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]) if keys else F.lit(True)
    d = d.join(spread, same, "left") if keys else d.join(F.broadcast(spread), same, "left")                            # one row
    band = F.lit(_z(interval)) * F.col("_sd")
    return d.select(*keys, "ds", "y", "yhat", (F.col("yhat") - band).alias("yhat_lower"), (F.col("yhat") + band).alias("yhat_upper"))


def fourier_residual(monthly: DataFrame, keys: list[str] | None = None, value: str = "ARR_DELAY", h: int = 12) -> DataFrame:
    """(keys..., n_months, n_known, largest): rows of the grid, observations, and
    the largest size of a normal equation X'(y - Xb) - ridge b at the fitted b,
    relative to the largest X'y; 0 for the least-squares solution."""
    keys = list(keys or [])
    rows = materialize(fourier_design(monthly, keys, value, h))
    d = _with_fit(rows, fourier_fit(rows, keys), keys)
    size = len(rows.select("ridge").first()[0])
    e = F.col("y") - F.col("yhat")
    gaps = [F.sum(F.col("x")[i] * e) - F.first(F.col("ridge")[i] * F.col("beta")[i], True) for i in range(size)]
    scale = [F.abs(F.sum(F.col("x")[i] * F.col("y"))) for i in range(size)]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_months"), F.count("y").alias("n_known"),
                                (F.array_max(F.array(*[F.abs(g) for g in gaps])) / F.greatest(F.lit(1.0), F.array_max(F.array(*scale)))).alias("largest"))


AR_FIELDS = [T.StructField("Month", T.DateType()), T.StructField("Predicted_DELAY", T.DoubleType()),
             T.StructField("CI_lower", T.DoubleType()), T.StructField("CI_upper", T.DoubleType())]


def ar_forecast(monthly: DataFrame, keys: list[str] | None = None, value: str = "ARR_DELAY", h: int = 12,
                lags: tuple[int, ...] = (1, 12), lower_level: float = 0.80, upper_level: float = 0.95,
                log: bool = True) -> DataFrame:
    """Seasonal autoregression per key: y_t = c + sum_l phi_l * y_(t-l) on
    the log1p scale (default lags 1 and 12), least squares in numpy inside
    ``applyInPandas`` (one monthly series per group), iterated ``h`` months
    ahead. The band widens with the horizon as sigma * sqrt(sum of squared
    impulse responses); lower bound at ``lower_level``, upper at
    ``upper_level``; back-transformed and floored at 0. A series too short
    for the lags falls back to its mean."""
    keys = list(keys or [])
    out_schema = T.StructType([monthly.schema[k] for k in keys] + AR_FIELDS)
    zl, zu = _z(lower_level), _z(upper_level)
    L = max(lags)

    def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("Month")
        y = pdf[value].to_numpy(float)
        if log:
            with np.errstate(invalid="ignore", divide="ignore"):
                y = np.where(y > -1, np.log1p(y), np.nan)
        # months without data: carry the previous value (the lags need a grid)
        y = pd.Series(y).ffill().bfill().to_numpy()
        last = pd.Timestamp(pdf["Month"].iloc[-1])
        months = pd.date_range(last + pd.offsets.MonthBegin(1), periods=h, freq="MS")
        n = len(y)
        if n > L + len(lags) + 1 and np.isfinite(y).all():
            X = np.column_stack([np.ones(n - L)] + [y[L - l: n - l] for l in lags])
            beta, *_ = np.linalg.lstsq(X, y[L:], rcond=None)
            resid = y[L:] - X @ beta
            sd = float(np.std(resid, ddof=len(beta))) if len(resid) > len(beta) else 0.0
            hist = list(y)
            psi = [1.0]                               # impulse responses for the band
            for k in range(1, h):
                psi.append(sum(beta[1 + i] * (psi[k - l] if k - l >= 0 else 0.0) for i, l in enumerate(lags)))
            preds = []
            for _ in range(h):
                nxt = beta[0] + sum(beta[1 + i] * hist[-l] for i, l in enumerate(lags))
                hist.append(nxt)
                preds.append(nxt)
            spread = sd * np.sqrt(np.cumsum(np.square(psi)))
        else:
            m = float(np.nanmean(y)) if np.isfinite(y).any() else float("nan")
            sd = float(np.nanstd(y, ddof=1)) if np.isfinite(y).sum() > 1 else 0.0
            preds, spread = [m] * h, np.full(h, sd)
        preds = np.asarray(preds)
        back = np.expm1 if log else (lambda v: v)
        res = pd.DataFrame({"Month": months.date,
                            "Predicted_DELAY": np.maximum(back(preds), 0.0),
                            "CI_lower": np.maximum(back(preds - zl * spread), 0.0),
                            "CI_upper": np.maximum(back(preds + zu * spread), 0.0)})
        for k in keys:
            res.insert(0, k, pdf[k].iloc[0])
        return res[[f.name for f in out_schema.fields]]

    d = calendar(monthly, keys, value)
    if not keys:
        return d.withColumn("_series", F.lit(0)).groupBy("_series").applyInPandas(
            lambda pdf: fit_one(pdf.drop(columns=["_series"])), out_schema)
    return d.groupBy(*keys).applyInPandas(fit_one, out_schema)
