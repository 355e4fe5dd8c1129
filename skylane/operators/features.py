"""Feature preparation: feature sets, exact imputation, rare-level lumping,
one-hot columns, name sanitising, reproducible splits, vector assembly.

Every statistic is computed by one distributed job whose result is small
by construction (a number per column, at most ``1/p`` kept levels per
column) and comes back to the driver only to be written into the next
plan as literals; nothing proportional to the row count leaves the
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..session import materialize
from .prefix import MAX_BROADCAST_ROWS, approx_quantile_table, exact_quantiles, quantile_table
from .select import quantiles, rank_thresholds

# --- fixed values: the three feature sets of the predictive analyses ---
DELAY_FEATURES = ["MONTH", "AIRLINE", "ORIGIN", "DEST", "DEP_HH", "DISTANCE", "CRS_DEP_HH"]
DELAY_NUMERIC = ["MONTH", "DEP_HH", "DISTANCE", "CRS_DEP_HH"]
DELAY_CATEGORICAL = ["AIRLINE", "ORIGIN", "DEST"]
CANCEL_FEATURES = ["MONTH", "ORIGIN", "DEST", "CRS_DEP_HH"]
CANCEL_NUMERIC = ["CRS_DEP_HH"]
CANCEL_CATEGORICAL = ["MONTH", "ORIGIN", "DEST"]
ARRIVAL_FEATURES = ["MONTH", "DEP_HH", "CRS_DEP_HH", "ORIGIN", "DEST", "DISTANCE"]
ARRIVAL_IMPUTE = ["DEP_HH", "CRS_DEP_HH", "DISTANCE"]
ARRIVAL_ONEHOT = ["ORIGIN", "DEST"]
OTHER = "Other"

# identity of one scheduled flight; the split hashes it
FLIGHT_KEY = ["FL_DATE", "AIRLINE", "FL_NUMBER", "ORIGIN", "DEST", "CRS_DEP_TIME"]


def _with_hours(fl: DataFrame) -> DataFrame:
    return fl.withColumns({"DEP_HH": C.hour_of("DEP_TIME"), "CRS_DEP_HH": C.hour_of("CRS_DEP_TIME")})


def flight_key(fl: DataFrame, name: str = "ROW_KEY") -> DataFrame:
    """Attach a deterministic per-flight hash in [0, 1) (the split key)."""
    return fl.withColumn(name, C.hash_unit(*FLIGHT_KEY))


def delay_features(fl: DataFrame) -> DataFrame:
    """Label ``IS_DELAYED = DEP_DELAY > 15`` (rows without it dropped) and the
    seven features. ``DEP_HH`` is the *actual* departure hour, which knows
    the answer; kept as the analysis has it."""
    d = _with_hours(flight_key(fl)).withColumn("IS_DELAYED", C.flag(F.col("DEP_DELAY") > 15))
    return d.filter(F.col("IS_DELAYED").isNotNull()).select("ROW_KEY", *DELAY_FEATURES, "IS_DELAYED")


def cancel_features(fl: DataFrame) -> DataFrame:
    """Label ``IS_CANCELLED = CANCELLED == 1``; MONTH is categorical here."""
    d = _with_hours(flight_key(fl)).withColumn("IS_CANCELLED", C.flag(F.col("CANCELLED") == 1))
    return d.filter(F.col("IS_CANCELLED").isNotNull()).select("ROW_KEY", *CANCEL_FEATURES, "IS_CANCELLED")


def arrival_features(fl: DataFrame) -> DataFrame:
    """Target ``ARR_DELAY`` (finite rows only); MONTH numeric."""
    d = _with_hours(flight_key(fl))
    return d.filter(C.is_finite("ARR_DELAY")).select("ROW_KEY", *ARRIVAL_FEATURES, "ARR_DELAY")


# ------------------------------------------------------------- imputation
def medians(df: DataFrame, cols: list[str], exact: bool = True) -> dict[str, float | None]:
    """Exact medians (mean of the middle two for an even count), one job;
    ``exact=False`` uses the bounded ``percentile_approx`` sketch."""
    if exact:
        return exact_quantiles(df, cols, 0.5)
    out: dict[str, float | None] = {c: None for c in cols}
    out.update({r["feature"]: r["value"] for r in approx_quantile_table(df, cols, 0.5).collect()})
    return out


def median_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value) exact medians, lazily."""
    return quantile_table(df, cols, 0.5)


def mode_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value): most frequent non-NULL value per column as text;
    ties -> the smallest value.

    One job over the stacked (column, value) pairs: a partial+final count
    per distinct value, then ``min_by`` over (-count, value) per column,
    itself a partial aggregation (no group is ever collected in one task).
    """
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("_name"), F.col(c).cast("string").alias("_v")) for c in cols])))
    counts = stacked.filter(F.col("_v").isNotNull()).groupBy("_name", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("_name").agg(
        F.min_by("_v", F.struct((-F.col("_n")).alias("a"), F.col("_v").alias("b"))).alias("value")
    ).withColumnRenamed("_name", "feature")


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """:func:`mode_table` collected as {column: value}."""
    out: dict[str, str | None] = {c: None for c in cols}
    if cols:
        out.update({r["feature"]: r["value"] for r in mode_table(df, cols).collect()})
    return out


def _fill(df: DataFrame, values: dict) -> DataFrame:
    exprs = {}
    for c, v in values.items():
        if v is None:
            continue
        t = df.schema[c].dataType
        lit = F.lit(v).cast(t)
        exprs[c] = F.coalesce(F.col(c), lit)
    return df.withColumns(exprs) if exprs else df


def impute_median(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                  exact: bool = True) -> DataFrame:
    """Replace NULLs by the median of the column (of ``fit_on`` if given,
    e.g. the training part; by default the whole table, as the analysis
    does)."""
    return _fill(df, medians(fit_on if fit_on is not None else df, cols, exact))


def impute_mode(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace NULLs by the most frequent value (ties: smallest)."""
    return _fill(df, modes(fit_on if fit_on is not None else df, cols))


# ----------------------------------------------------------------- lumping
def level_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, level, n, share) for every non-NULL level of every column;
    share is of the column's non-NULL rows. Lazy: one pass over ``df``, as
    both uses of the counts share one exchange."""
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cols])))
    counts = stacked.filter(F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_tot"))
    # one row per feature column: a bounded broadcast
    return counts.join(F.broadcast(totals), "feature").select(
        "feature", "level", "n", (F.col("n") / F.col("_tot")).alias("share"))


def _lump_stats(df: DataFrame, cols: list[str], prop: float) -> DataFrame:
    shares = level_shares(df, cols)
    return shares.groupBy("feature").agg(
        F.count_if(F.col("share") <= prop).alias("n_small"),
        F.collect_list(F.when(F.col("share") > prop, F.col("level"))).alias("kept"))


def lump_table(df: DataFrame, cols: list[str], prop: float = 0.01, other: str = OTHER) -> DataFrame:
    """(feature, level, n, share, lumped): the level each value maps to.

    A level is kept when its share is strictly greater than ``prop``; when
    at most one level would be lumped, nothing is lumped.
    """
    shares = level_shares(df, cols)
    small = shares.groupBy("feature").agg(F.count_if(F.col("share") <= prop).alias("_n_small"))
    j = shares.join(F.broadcast(small), "feature")          # one row per feature column
    keep = (F.col("share") > prop) | (F.col("_n_small") <= 1)
    return j.select("feature", "level", "n", "share",
                    F.when(keep, F.col("level")).otherwise(F.lit(other)).alias("lumped"))


def kept_levels(df: DataFrame, cols: list[str], prop: float = 0.01) -> dict[str, list[str] | None]:
    """Levels kept by proportion lumping, per column (``None``: no lumping).
    At most ``1/prop`` levels can be kept, so the driver receives a bounded
    list whatever the data size; ``prop`` must be positive."""
    if not prop > 0:
        raise ValueError("prop must be positive")
    out: dict[str, list[str] | None] = {c: None for c in cols}
    for r in _lump_stats(df, cols, prop).collect():
        out[r["feature"]] = None if r["n_small"] <= 1 else sorted(r["kept"])
    return out


def lump_rare(df: DataFrame, cols: list[str], prop: float = 0.01, other: str = OTHER,
              kept: dict | None = None) -> DataFrame:
    """Replace levels with share <= ``prop`` by ``other`` (NULL stays NULL).
    Columns become text (categorical)."""
    kept = kept if kept is not None else kept_levels(df, cols, prop)
    exprs = {}
    for c in cols:
        s = F.col(c).cast("string")
        k = kept.get(c)
        exprs[c] = s if k is None else F.when(s.isNull(), s).when(s.isin(*k), s).otherwise(F.lit(other))
    return df.withColumns(exprs)


# ----------------------------------------------------------------- one-hot
def level_order(df: DataFrame, c: str, other: str = OTHER) -> list[str]:
    """Level order of a column: natural order of the values (numbers
    numerically), with ``other`` last. One name per level reaches the driver,
    as many as the plan of :func:`one_hot` has columns; for columns with many
    levels see :mod:`.design`."""
    return _ordered([str(r[0]) for r in df.select(c).distinct().filter(F.col(c).isNotNull()).collect()], other)


def one_hot(df: DataFrame, cols: list[str], drop_first: bool = True, drop_source: bool = True,
            levels: dict[str, list[str]] | None = None) -> DataFrame:
    """0/1 integer column ``<col>_<level>`` per level (names sanitised),
    without the first level when ``drop_first``. A NULL source value gives
    0 in every level column."""
    levels = dict(levels or {})
    raw = []                                    # (raw name, expression)
    for c in cols:
        lv = levels.get(c) or level_order(df, c)
        use = lv[1:] if drop_first else lv
        s = F.col(c).cast("string")
        for v in use:
            raw.append((f"{c}_{v}", F.coalesce((s == F.lit(v)).cast("int"), F.lit(0))))
    keep = [c for c in df.columns if not (drop_source and c in cols)]
    names = C.sanitize_columns(keep + [n for n, _ in raw])     # raises on a collision
    return df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)],
                     *[e.alias(n) for (_, e), n in zip(raw, names[len(keep):])])


def sparse_one_hot(df: DataFrame, cols: list[str], output_suffix: str = "_vec") -> DataFrame:
    """Wide categorical columns as sparse vectors (MLlib), for columns with
    many levels. The alphabetically first level is dropped (its vector is
    all zeros), so k levels give k - 1 slots. Rows with a NULL in one of
    ``cols`` are left out: impute first to keep them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    d = df.na.drop("any", subset=cols)
    # descending order puts the first level last, the slot that dropLast drops
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetDesc",
                         handleInvalid="error") for c in cols]
    enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}{output_suffix}" for c in cols],
                        dropLast=True, handleInvalid="error")
    return Pipeline(stages=[*idx, enc]).fit(d).transform(d).drop(*[f"{c}_idx" for c in cols])


# ------------------------------------------------------------------ splits
def split(df: DataFrame, p: float = 0.8, key: str = "ROW_KEY") -> tuple[DataFrame, DataFrame]:
    """Deterministic train/test split on a hash key in [0, 1): train is
    ``key < p``. Disjoint and complete; independent of partitioning; rows
    with equal keys land on the same side."""
    return df.filter(F.col(key) < F.lit(float(p))), df.filter(~(F.col(key) < F.lit(float(p))))


def stratified_split(df: DataFrame, label: str, p: float = 0.8, key: str = "ROW_KEY",
                     numeric_groups: int | None = None, cuts: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split keeping the class balance: in each stratum the rows with the
    ``ceil(p * n)`` smallest keys go to train (rows with equal keys stay
    together, so the count can exceed it by ties).

    Strata are the label values; a numeric target is cut at its exact
    quantiles into ``numeric_groups`` groups first (``cuts``, where these are
    known already). The key threshold of each
    stratum is found by counting (:func:`.select.rank_thresholds`): no row
    per key, no sort of a stratum; the thresholds (one per stratum) are
    broadcast up to ``MAX_BROADCAST_ROWS`` strata and joined beyond. Rows
    without a label go to the test side.
    """
    s = F.col(label)
    if numeric_groups:
        cuts = cuts if cuts is not None else quantiles(df, [label], [i / numeric_groups for i in range(1, numeric_groups)])[label]
        s = sum((F.col(label) > F.lit(x)).cast("int") for x in cuts)
    d = df.withColumn("_stratum", F.when(F.col(label).isNotNull(), s.cast("string")))
    known = d.filter(F.col("_stratum").isNotNull())
    thr = materialize(rank_thresholds(known, key, ["_stratum"], lambda n: F.ceil(n * F.lit(float(p)))).select("_stratum", "_thr"))
    strata = thr.count()
    j = d.join(F.broadcast(thr) if strata <= MAX_BROADCAST_ROWS else thr, "_stratum", "left")
    inside = F.coalesce(F.col(key) <= F.col("_thr"), F.lit(False))
    return j.filter(inside).drop("_stratum", "_thr"), j.filter(~inside).drop("_stratum", "_thr")


# ---------------------------------------------------------------- assembly
def assemble(df: DataFrame, label: str, exclude: tuple[str, ...] = ("ROW_KEY",),
             output: str = "features") -> tuple[DataFrame, list[str]]:
    """Numeric feature columns -> one vector column; the label as DOUBLE."""
    from pyspark.ml.feature import VectorAssembler
    feats = [c for c in df.columns if c != label and c not in exclude]
    bad = [c for c in feats if not isinstance(df.schema[c].dataType, T.NumericType)]
    if bad:
        raise ValueError(f"non-numeric feature columns: {bad}")
    va = VectorAssembler(inputCols=feats, outputCol=output, handleInvalid="error")
    return va.transform(df.withColumn(label, F.col(label).cast("double"))), feats


def _ordered(vals: list[str], other: str = OTHER) -> list[str]:
    def sort_key(v):
        if v == other:
            return (2, 0, "")
        try:
            return (0, float(v), v)
        except ValueError:
            return (1, 0, v)
    return sorted(set(vals), key=sort_key)


def _design(d: DataFrame, numeric: list[str], categorical: list[str], prop: float | None,
            onehot: list[str], drop_null: list[str] | None = None) -> DataFrame:
    from ..session import materialize
    d = materialize(d)                       # the only pass over the source tables
    d = impute_median(d, numeric)
    d = impute_mode(d, categorical)
    if drop_null:                            # before encoding: a NULL level would become all zeros
        d = d.na.drop("any", subset=drop_null)
    if prop is not None and categorical:
        kept = kept_levels(d, categorical, prop)
        d = lump_rare(d, categorical, prop, kept=kept)
        levels = {c: (level_order(d, c) if kept[c] is None else _ordered([*kept[c], OTHER]))
                  for c in categorical}
    else:
        levels = {c: level_order(d, c) for c in onehot}
    return one_hot(d, onehot, levels=levels)


def prepare_delay(fl: DataFrame, prop: float = 0.01) -> DataFrame:
    """The delay-classification design table: median/mode imputation over
    the whole table, rare levels lumped, one-hot (first level dropped),
    names sanitised."""
    return _design(delay_features(fl), DELAY_NUMERIC, DELAY_CATEGORICAL, prop, DELAY_CATEGORICAL)


def prepare_cancel(fl: DataFrame, prop: float = 0.01) -> DataFrame:
    return _design(cancel_features(fl), CANCEL_NUMERIC, CANCEL_CATEGORICAL, prop, CANCEL_CATEGORICAL)


def prepare_arrival(fl: DataFrame) -> DataFrame:
    """Arrival-delay regression table: medians, one-hot of every airport
    level (no lumping), rows with any NULL dropped."""
    return _design(arrival_features(fl), ARRIVAL_IMPUTE, [], None, ARRIVAL_ONEHOT,
                   drop_null=ARRIVAL_ONEHOT).na.drop("any")


def sparse_encoder(df: DataFrame, numeric: list[str], categorical: list[str], output: str = "features"):
    """(fitted pipeline, feature names): numbers and 0/1 slots of every level
    of ``categorical`` in one sparse vector, without the alphabetically first
    level of each; any number of levels, one expression. NULLs fail: impute
    or drop them first."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    idx = [StringIndexer(inputCol=c, outputCol=f"_{c}_idx", stringOrderType="alphabetDesc", handleInvalid="error")
           for c in categorical]
    enc = OneHotEncoder(inputCols=[f"_{c}_idx" for c in categorical], outputCols=[f"_{c}_vec" for c in categorical],
                        dropLast=True, handleInvalid="error")
    va = VectorAssembler(inputCols=[*numeric, *[f"_{c}_vec" for c in categorical]], outputCol=output, handleInvalid="error")
    fitted = Pipeline(stages=[*idx, enc, va]).fit(df)
    slots = [f"{c}_{level}" for c, s in zip(categorical, fitted.stages) for level in s.labels[:-1]]
    return fitted, C.sanitize_columns([*numeric, *slots])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]

