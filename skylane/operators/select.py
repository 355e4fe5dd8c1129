"""Order statistics by counting digits (radix selection).

Neither a sort nor a row per value: one scan counts how many values have
each high digit, the digit that holds the wanted rank is taken, and the
next scan looks inside that one only. A result of a scan is a count per
digit, whatever the number of rows, so the same path serves every size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_unit
from ..session import materialize
from .prefix import join_stats

FINE_DIGITS = 4096      # digits of a refining scan
FEW_ROWS = 4096         # an interval of so few rows is counted value by value
KEY_DIGITS = 1 << 16    # high digits of a key in [0, 1)


def _high_digit(v: Column) -> Column:
    """First digit of a number: sign, and sixteenths of a power of two. Never
    falls as the number grows but by rounding beside a border, which
    :func:`_scan` mends from the smallest and largest value of each digit."""
    size = F.when(F.abs(v) == F.lit(math.inf), F.lit(40_000)).otherwise(F.floor(F.log2(F.abs(v)) * 16).cast("int") + 20_000)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("int") * size).cast("double")


def _fine_digit(v: Column, lo: float, hi: float, rows: int) -> Column:
    """Place of ``v`` in lo..hi, in ``FINE_DIGITS`` steps; the value itself where the interval holds few rows."""
    if rows <= FEW_ROWS:
        return v
    width = hi / 2 - lo / 2
    return F.floor((v / 2 - F.lit(lo / 2)) / F.lit(width) * FINE_DIGITS).cast("double")


def _scan(df: DataFrame, digits: dict[int, tuple[str, Column, Column]]) -> dict[int, list[tuple[float, float, int]]]:
    """For each target (column, digit, condition): disjoint (smallest, largest, rows), ascending. One pass over ``df``."""
    structs = [F.struct(F.lit(i).alias("target"), F.when(where, digit).alias("digit"), F.col(c).cast("double").alias("v"))
               for i, (c, digit, where) in digits.items()]
    found = (df.select(F.inline(F.array(*structs))).filter(F.col("digit").isNotNull())
             .groupBy("target", "digit").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")))
    out: dict[int, list[tuple[float, float, int]]] = {i: [] for i in digits}
    for r in sorted(found.collect(), key=lambda r: (r["lo"], r["hi"])):      # a row per digit
        spans = out[r["target"]]
        if spans and r["lo"] <= spans[-1][1]:
            lo, hi, n = spans.pop()
            spans.append((lo, max(hi, r["hi"]), n + r["n"]))
        else:
            spans.append((r["lo"], r["hi"], r["n"]))
    return out


def order_statistics(df: DataFrame, columns: list[str], ranks: Callable[[int], list[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    """For each numeric column its number of values (no NULL, no NaN) and the
    values at ``ranks(number)``, counted from 0 in ascending order."""
    if not columns:
        return {}
    value = {c: F.col(c).cast("double") for c in columns}
    first = _scan(df, {i: (c, _high_digit(value[c]), value[c].isNotNull() & ~F.isnan(value[c])) for i, c in enumerate(columns)})
    count = {c: sum(n for _, _, n in first[i]) for i, c in enumerate(columns)}
    out: dict[str, tuple[int, dict[int, float]]] = {c: (count[c], {}) for c in columns}
    open_: list[tuple[str, int, int, tuple[float, float, int]]] = []       # column, wanted rank, rank inside, interval

    def place(c: str, rank: int, inside: int, spans: list[tuple[float, float, int]]) -> None:
        for span in spans:
            if inside < span[2]:
                if span[0] == span[1]:
                    out[c][1][rank] = span[0]
                else:
                    open_.append((c, rank, inside, span))
                return
            inside -= span[2]

    for i, c in enumerate(columns):
        for rank in ranks(count[c]) if count[c] else []:
            place(c, rank, rank, first[i])
    while open_:
        wanted, open_ = open_, []
        spans = sorted({(c, span) for c, _, _, span in wanted})
        target = {x: i for i, x in enumerate(spans)}
        found = _scan(df, {i: (c, _fine_digit(value[c], *span), value[c].between(span[0], span[1])) for (c, span), i in target.items()})
        for c, rank, inside, span in wanted:
            place(c, rank, inside, found[target[c, span]])
    return out


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles, linear between the two neighbouring order statistics; None for a column without values."""
    def places(n: int) -> list[int]:
        return sorted({f((n - 1) * q) for q in probabilities for f in (math.floor, math.ceil)})
    out: dict[str, list[float | None]] = {}
    for c, (n, found) in order_statistics(df, columns, places).items():
        out[c] = []
        for q in probabilities:
            at = (n - 1) * q
            lo, hi = math.floor(at), math.ceil(at)
            out[c].append(None if not n else found[lo] if lo == hi else (hi - at) * found[lo] + (at - lo) * found[hi])
    return out


def rank_thresholds(df: DataFrame, key: str, by: list[str], need: Callable[[Column], Column]) -> DataFrame:
    """(``by``..., _thr, _below): in each group the smallest ``key`` (in [0, 1))
    up to which ``need(rows of the group)`` rows or more lie, and the rows
    below it. Rows without a key do not count.

    Two scans: rows per group and high digit of the key, then rows per key
    inside the one digit that holds the wanted rank."""
    digit = F.floor(F.col(key) * KEY_DIGITS).cast("int")
    d = df.filter(F.col(key).isNotNull()).select(*by, F.col(key).alias("_key"), digit.alias("_digit"), F.lit(0).alias("_g"))
    groups = [*by, "_g"]
    below = Window.partitionBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*groups, "_digit").agg(F.count(F.lit(1)).alias("_n"))          # at most KEY_DIGITS rows a group
    counts = counts.select("*", F.coalesce(F.sum("_n").over(below.orderBy("_digit")), F.lit(0)).alias("_under"),
                           F.sum("_n").over(Window.partitionBy(*groups)).alias("_all"))
    wanted = counts.withColumn("_need", need(F.col("_all")).cast("long"))
    wanted = materialize(wanted.filter((F.col("_under") < F.col("_need")) & (F.col("_need") <= F.col("_under") + F.col("_n")))
                         .select(*groups, "_digit", "_under", "_need"))                 # a row per group
    inside = join_stats(d, wanted, [*groups, "_digit"], wanted.count())
    keys = inside.groupBy(*groups, "_key").agg(F.count(F.lit(1)).alias("_n"), F.first("_under").alias("_under"), F.first("_need").alias("_need"))
    keys = keys.withColumn("_below", F.col("_under") + F.coalesce(F.sum("_n").over(below.orderBy("_key")), F.lit(0)))
    hit = (F.col("_below") < F.col("_need")) & (F.col("_need") <= F.col("_below") + F.col("_n"))
    return keys.filter(hit).select(*by, F.col("_key").alias("_thr"), "_below")


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer): those with the smallest hash of
    ``keys``, equal hashes in the order of the keys (then of the other
    columns), NULLs first. The same rows for every partitioning.

    The n-th smallest hash is found by counting; only rows with that very
    hash are sorted."""
    if n <= 0:
        return df.limit(0)
    d = df.withColumn("_u", hash_unit(*keys, seed=seed))
    at = rank_thresholds(d.select("_u"), "_u", [], lambda rows: F.least(rows, F.lit(int(n)))).first()
    if at is None:
        return df
    left = int(n) - at["_below"]
    order = [*keys, *[c for c in df.columns if c not in keys]]
    ties = d.filter(F.col("_u") == F.lit(at["_thr"])).orderBy(*order).limit(left)
    return d.filter(F.col("_u") < F.lit(at["_thr"])).unionByName(ties).drop("_u")
