"""Column expressions (all JVM-side, inside whole-stage codegen).

Each function maps Column(s) to a Column; none touches a DataFrame, so they
compose freely inside ``select``/``withColumns``/``agg``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import (
    DISTANCE_BREAKS, DISTANCE_LEVELS, DOW_LEVELS, SEASON_DEFAULT, SEASON_MONTHS,
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: str | Column) -> Column:
    """Text date in ``yyyy-MM-dd`` or ``yyyyMMdd``; anything else is NULL."""
    c = col(c)
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"),
                      F.try_to_date(c, "yyyyMMdd"))


def weekday_number(d: str | Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(col(d)) + F.lit(1)


def weekday_name(day_num: str | Column) -> Column:
    """Name for a Monday=1 day number; order by the number, never the name."""
    return F.element_at(F.array(*[F.lit(n) for n in DOW_LEVELS]), col(day_num).cast("int"))


def distance_category(x: str | Column) -> Column:
    """Right-closed bins: <=500 short, <=1500 medium, above long; NULL stays NULL."""
    x = col(x)
    lo, hi = DISTANCE_BREAKS
    return (F.when(x <= lo, DISTANCE_LEVELS[0])
            .when(x <= hi, DISTANCE_LEVELS[1])
            .when(x.isNotNull() & ~F.isnan(x), DISTANCE_LEVELS[2]))


def hour_of(hhmm: str | Column) -> Column:
    """Integer hour of an hhmm clock value (floor division, 2400 -> 24)."""
    return F.floor(col(hhmm) / F.lit(100))


def hour_category(hhmm: str | Column) -> Column:
    """Hour 0..23 as an integer category; 24 (and anything else) -> NULL."""
    h = hour_of(hhmm)
    return F.when(h.between(0, 23), h.cast("int"))


def season(month: str | Column) -> Column:
    """Meteorological season; a NULL month falls to the default branch."""
    m = col(month)
    e = None
    for name, months in SEASON_MONTHS.items():
        cond = F.coalesce(m.isin(*months), F.lit(False))
        e = F.when(cond, name) if e is None else e.when(cond, name)
    return e.otherwise(SEASON_DEFAULT)


def flag(pred: Column) -> Column:
    """0/1 integer from a predicate; NULL stays NULL."""
    return pred.cast("int")


def text_or_na(c: str | Column) -> Column:
    """Missing text rendered as the literal ``NA`` (as R's paste does)."""
    return F.coalesce(col(c).cast("string"), F.lit("NA"))


def route_label(origin_city: str | Column, dest_city: str | Column, sep: str = " → ") -> Column:
    return F.concat(text_or_na(origin_city), F.lit(sep), text_or_na(dest_city))


def cap(x: str | Column, upper: float) -> Column:
    """``min(x, upper)`` keeping NULL as NULL (``least`` alone skips NULLs)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(x, F.lit(float(upper))))


def floor_at(x: str | Column, lower: float = 0.0) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(lower))))


def is_finite(x: str | Column) -> Column:
    """Not NULL, not NaN, not +/-Infinity."""
    x = col(x)
    return (x.isNotNull() & ~F.isnan(x)
            & (x != F.lit(float("inf"))) & (x != F.lit(float("-inf"))))


def pct(num: Column, den: Column, digits: int) -> Column:
    """``round(100 * num / den, digits)`` in DOUBLE; NULL when den is 0."""
    return F.round(F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double")), digits)


def month_start(d: str | Column) -> Column:
    return F.trunc(col(d), "month")


def hash_unit(*keys: str | Column, seed: int = 42) -> Column:
    """Deterministic number in [0, 1) from integer/string keys and a seed.

    ``md5`` of the '|'-joined keys; the first 32 bits as an integer / 2^32.
    Identical on every run and cluster size; equal keys hash equally.
    """
    parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys] + [F.lit(str(seed))]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(4294967296.0)


_BAD = re.compile(r"[^0-9A-Za-z_]")


def sanitize_name(name: str) -> str:
    return _BAD.sub("_", name)


def sanitize_columns(columns: list[str]) -> list[str]:
    """Replace characters outside ``[0-9A-Za-z_]``; fail if two names collide."""
    out = [sanitize_name(c) for c in columns]
    seen: dict[str, str] = {}
    for orig, new in zip(columns, out):
        if new in seen:
            raise ValueError(f"columns {seen[new]!r} and {orig!r} both become {new!r}")
        seen[new] = orig
    return out
