"""Model designs from a level dictionary: one sparse vector per row.

The dictionary is a table with a row per column and raw level: the level it
counts as (NULL as the most frequent one, rare ones as "Other") and its slot
in the vector (none for the first level of a column, the base). It is joined
to the rows once per column and folded to one sparse vector, so there is
neither a column per level nor a limit on the number of levels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from . import features
from .prefix import join_stats
from .select import quantiles

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass
class Design:
    """Rows with ``features`` (vector), the label and the columns kept; slot
    names and the source column of each slot. ``encode(rows, keep)`` encodes
    other rows of the same source columns alike; ``source`` holds the rows
    before encoding."""

    rows: DataFrame
    label: str
    names: list[str]
    sources: list[str]
    source: DataFrame
    encode: Callable[[DataFrame, list[str]], DataFrame]

    def split(self, p: float = 0.8, strata_groups: int | None = None) -> tuple[Design, Design]:
        """Train and test part: by the hash key, or exactly within quantile groups of a numeric label."""
        parts = (features.split(self.source, p) if strata_groups is None
                 else features.stratified_split(self.source, self.label, p, numeric_groups=strata_groups))
        train, test = (replace(self, source=d, rows=self.encode(d, ["ROW_KEY", self.label])) for d in parts)
        return train, test


def _stacked(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cols])))


def _order(level: Column, other: str) -> Column:
    """Sort key of a level: numbers by size, then text, ``other`` last."""
    number = F.when(level.rlike(_NUMBER), level.cast("double"))
    return F.struct(F.when(level == F.lit(other), 2).when(number.isNotNull(), 0).otherwise(1).alias("kind"), number.alias("number"), level.alias("text"))


def level_dictionary(df: DataFrame, cols: list[str], prop: float | None = None, impute: bool = True, first_slot: int = 0,
                     other: str = features.OTHER) -> DataFrame:
    """(feature, level, lumped, slot): a row per column and raw level, NULL among them.

    * ``impute``: NULL counts as the most frequent level of the column (ties:
      the smallest); else it has no level and no slot;
    * ``prop``: levels whose share of the rows (imputed ones included) is at
      most ``prop`` become ``other``, where that are two or more;
    * slots run from ``first_slot`` in the order of ``cols`` and levels; the
      first level of each column has none.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, level string, lumped string, slot int")
    counts = materialize(_stacked(df, cols).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n")))      # a row per level
    known = F.col("level").isNotNull()
    # a row per column
    whole = counts.groupBy("feature").agg(
        F.sum(F.when(known, F.col("n"))).alias("known"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
        F.min_by("level", F.when(known, F.struct((-F.col("n")).alias("a"), F.col("level").alias("b")))).alias("mode"))
    d = counts.join(F.broadcast(whole), "feature")
    if impute:
        d = d.withColumn("n", F.col("n") + F.when(F.col("level") == F.col("mode"), F.col("missing")).otherwise(0))
        d = d.withColumn("counts_as", F.coalesce("level", "mode"))
        total = F.col("known") + F.col("missing")
    else:
        d, total = d.withColumn("counts_as", F.col("level")), F.col("known")
    d = d.withColumn("lumped", F.col("counts_as"))
    if prop is not None:
        shares = d.filter(known).select("feature", "level", (F.col("n") / total).alias("share"))
        rare = shares.filter(F.col("share") <= F.lit(float(prop))).select("feature", F.col("level").alias("rare"))
        several = rare.groupBy("feature").count().filter(F.col("count") > 1).select("feature")        # a row per column
        rare = rare.join(F.broadcast(several), "feature", "left_semi").withColumnRenamed("feature", "of")
        d = d.join(rare, (F.col("feature") == F.col("of")) & (F.col("counts_as") == F.col("rare")), "left")
        d = d.withColumn("lumped", F.when(F.col("rare").isNotNull(), F.lit(other)).otherwise(F.col("counts_as")))
    d = materialize(d.select("feature", "level", "lumped"))
    place = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    levels = (d.filter(F.col("lumped").isNotNull()).select("feature", "lumped").distinct()
              .select("feature", "lumped", place[F.col("feature")].alias("place"), _order(F.col("lumped"), other).alias("order")))
    base = levels.groupBy("feature").agg(F.min("order").alias("base"))                                # a row per column
    levels = levels.join(F.broadcast(base), "feature").filter(F.col("order") != F.col("base"))
    slots = numbered(levels.select("feature", "lumped", F.struct("place", "order").alias("at")), "at", "number")
    slots = slots.select(F.col("feature").alias("of"), F.col("lumped").alias("as"), (F.col("number") + first_slot).cast("int").alias("slot"))
    return materialize(d.join(slots, (F.col("feature") == F.col("of")) & (F.col("lumped") == F.col("as")), "left")
                       .select("feature", "level", "lumped", "slot"))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the rank (from 0) of each row's ``key``, which must be unique; no sort in one task (a parallel scan)."""
    from .prefix import prefix_sums
    ranks = prefix_sums(df.select(key).withColumn("_w", F.lit(1)), key, ["_w"]).select(F.col(key).alias("_key"), F.col("_w_below").alias(name))
    return df.join(ranks, F.col(key) == F.col("_key")).drop("_key")


def _filled(df: DataFrame, numeric: list[str], impute: bool) -> dict[str, Column]:
    """Numeric columns as doubles, gaps filled with the exact median."""
    median = {c: v[0] for c, v in quantiles(df, numeric, [0.5]).items()} if impute and numeric else {}
    return {c: F.coalesce(F.col(c).cast("double"), F.lit(median[c])) if median.get(c) is not None else F.col(c).cast("double") for c in numeric}


def _with_slots(df: DataFrame, dictionary: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``_slot_<column>`` for each categorical column (NULL: the base level); one join a column."""
    sizes = {r["feature"]: r["count"] for r in dictionary.groupBy("feature").count().collect()}
    for c in cols:
        d = dictionary.filter(F.col("feature") == c).select(F.col("level").alias("_level"), F.col("slot").alias(f"_slot_{c}"))
        df = join_stats(df.withColumn("_level", F.col(c).cast("string")), d, ["_level"], sizes.get(c, 0)).drop("_level")
    return df


def entries(df: DataFrame, numeric: list[str], categorical: list[str], keys: list[str], prop: float | None = None,
            impute: bool = True, dictionary: DataFrame | None = None) -> DataFrame:
    """(``keys``..., slot, value): the design as a long table, entries that are not zero. Numeric columns have the
    first slots, in the given order."""
    d = dictionary if dictionary is not None else level_dictionary(df, categorical, prop, impute, len(numeric))
    filled = _filled(df, numeric, impute)
    rows = _with_slots(df, d, categorical)
    cells = [F.struct(F.lit(i).alias("slot"), filled[c].alias("value")) for i, c in enumerate(numeric)]
    cells += [F.struct(F.col(f"_slot_{c}").alias("slot"), F.lit(1.0).alias("value")) for c in categorical]
    return rows.select(*keys, F.inline(F.array(*cells))).filter(F.col("slot").isNotNull() & (F.col("value") != 0))


def slot_names(dictionary: DataFrame, numeric: list[str]) -> tuple[list[str], list[str]]:
    """Name and source column of every slot, in order: as wide as the model itself."""
    found = dictionary.filter(F.col("slot").isNotNull()).select("slot", "feature", "lumped").distinct().collect()
    found = sorted(found, key=lambda r: r["slot"])
    return C.sanitize_columns([*numeric, *[f"{r['feature']}_{r['lumped']}" for r in found]]), [*numeric, *[r["feature"] for r in found]]


def build(df: DataFrame, label: str, numeric: list[str], categorical: list[str], prop: float | None = None,
          impute: list[str] | None = None, keep: tuple[str, ...] = ("ROW_KEY",)) -> Design:
    """The design of ``df``: numbers, then a 0/1 slot per level but the first of each column, in one sparse vector.

    ``impute`` names the columns whose gaps are filled (default: all); rows
    with a gap left are dropped. ``df`` is evaluated several times: hand over
    a stored table.
    """
    impute = [*numeric, *categorical] if impute is None else impute
    gaps = [c for c in (*numeric, *categorical) if c not in impute]
    df = df.na.drop("any", subset=gaps) if gaps else df
    filled = _filled(df, [c for c in numeric if c in impute], True)
    d = level_dictionary(df, categorical, prop, True, len(numeric))
    names, sources = slot_names(d, numeric)

    def encode(rows: DataFrame, kept: list[str]) -> DataFrame:
        rows = rows.withColumns(filled) if filled else rows
        return _vectors(_with_slots(rows, d, categorical), numeric, categorical, sources, kept)

    return Design(encode(df, [*keep, label]), label, names, sources, df, encode)


def _vectors(rows: DataFrame, numeric: list[str], categorical: list[str], sources: list[str], keep: list[str]) -> DataFrame:
    """One sparse vector per row from the slots, by built-in encoders; their sizes come from the dictionary, no job."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    at, wide = len(numeric), []
    for c in categorical:
        size = sources.count(c) if c not in numeric else 0
        if size:
            # the base level takes the last place, which the encoder leaves out
            place = F.coalesce(F.col(f"_slot_{c}") - at, F.lit(size)).cast("double")
            kind = {"ml_attr": {"type": "nominal", "num_vals": size + 1, "name": c}}
            rows = rows.withColumn(f"_place_{c}", place.alias(f"_place_{c}", metadata=kind))
            wide.append(c)
        at += size
    rows = rows.select(*keep, *[F.col(c).cast("double").alias(f"_num_{c}") for c in numeric], *[f"_place_{c}" for c in wide])
    if wide:
        encoder = OneHotEncoder(inputCols=[f"_place_{c}" for c in wide], outputCols=[f"_vec_{c}" for c in wide], dropLast=True, handleInvalid="error")
        rows = encoder.fit(rows).transform(rows)
    inputs = [*[f"_num_{c}" for c in numeric], *[f"_vec_{c}" for c in wide]]
    out = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(rows)
    return out.select(*keep, "features")


def delay_design(fl: DataFrame, prop: float = 0.01) -> Design:
    """Delay classification: medians and modes filled in, rare levels lumped."""
    d = materialize(features.delay_features(fl))
    return build(d, "IS_DELAYED", features.DELAY_NUMERIC, features.DELAY_CATEGORICAL, prop)


def cancel_design(fl: DataFrame, prop: float = 0.01) -> Design:
    d = materialize(features.cancel_features(fl))
    return build(d, "IS_CANCELLED", features.CANCEL_NUMERIC, features.CANCEL_CATEGORICAL, prop)


def arrival_design(fl: DataFrame) -> Design:
    """Arrival-delay regression: medians filled in, every airport a level, rows with any other gap dropped."""
    d = materialize(features.arrival_features(fl))
    numeric = [c for c in features.ARRIVAL_FEATURES if c not in features.ARRIVAL_ONEHOT]
    return build(d, "ARR_DELAY", numeric, features.ARRIVAL_ONEHOT, None, features.ARRIVAL_IMPUTE)
