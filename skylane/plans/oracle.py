"""Independent SQL (DuckDB dialect) for the correctness oracle.

``FLIGHTS_WITH`` re-derives the flights table and its prepared columns from
the driver's ``lineitem``/``supplier``/``part`` views, written separately
from the Spark code so the comparison checks both. Conventions that keep
the two engines bit-equal: counts cast to BIGINT, calendar fields to
INTEGER, rounding through the shortest decimal text of the double (which is
what Spark's ``round`` rounds half-up), rates computed as
``100.0 * num / den`` in DOUBLE.
"""

from __future__ import annotations


def rnd(expr: str, digits: int) -> str:
    """DuckDB rounding equal to Spark's ``round(double, d)``."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def pct(num: str, den: str, digits: int) -> str:
    return rnd(f"CAST(100 AS DOUBLE) * ({num}) / ({den})", digits)


def _ap(k: str) -> str:
    return (f"concat('AP', lpad(CAST(CAST(floor(({k} % 200)*({k} % 200)/200) AS BIGINT) AS VARCHAR), 3, '0'))")


_CAUSES = ["CARRIER", "WEATHER", "NAS", "SECURITY", "LATE_AIRCRAFT"]

_CAUSE_COLS = ",\n    ".join(
    f"CASE WHEN ARR_DELAY >= 15 THEN CASE WHEN _cause = {i} THEN ARR_DELAY ELSE CAST(0 AS DOUBLE) END END "
    f"AS DELAY_DUE_{n}" for i, n in enumerate(_CAUSES))

FLIGHTS_WITH = f"""
WITH _li AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_tax, l.l_shipdate, s.s_nationkey, p.p_size,
    (l.l_returnflag = 'R' AND l.l_linestatus = 'F' AND l.l_quantity <= 8) AS canc,
    (l.l_returnflag = 'A' AND l.l_linestatus = 'F' AND l.l_quantity >= 49) AS dvt,
    ((l.l_orderkey * 7 + l.l_partkey) % 25) * 100 + l.l_partkey % 60 AS hhmm,
    {_ap('l.l_orderkey')} AS ap_o,
    {_ap('l.l_partkey')} AS ap_d,
    CAST((l.l_quantity - 30) + CAST(round(l.l_discount * 100) AS BIGINT) * 4 AS DOUBLE) AS dd
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
), _f AS (
  SELECT CAST(l_shipdate AS DATE) AS FL_DATE,
    concat('AIRLINE_', CAST(s_nationkey AS VARCHAR)) AS AIRLINE,
    l_partkey AS FL_NUMBER,
    ap_o AS ORIGIN,
    concat('CITY_', substr(ap_o, 3, 3)) AS ORIGIN_CITY,
    ap_d AS DEST,
    CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE concat('CITY_', substr(ap_d, 3, 3)) END AS DEST_CITY,
    hhmm AS CRS_DEP_TIME,
    CASE WHEN canc OR l_partkey % 50 = 0 THEN NULL ELSE CAST(hhmm AS DOUBLE) END AS DEP_TIME,
    CASE WHEN canc THEN NULL ELSE dd END AS DEP_DELAY,
    CASE WHEN canc OR dvt THEN NULL ELSE CAST(dd + CAST(round(l_tax * 100) AS BIGINT) * 2 - 8 AS DOUBLE) END AS ARR_DELAY,
    CAST(CASE WHEN canc THEN 1 ELSE 0 END AS DOUBLE) AS CANCELLED,
    CAST(CASE WHEN dvt THEN 1 ELSE 0 END AS DOUBLE) AS DIVERTED,
    CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE CAST(p_size * 50 AS DOUBLE) END AS DISTANCE,
    CASE WHEN canc OR dvt THEN NULL ELSE CAST(p_size * 6 + 20 + l_linenumber AS DOUBLE) END AS AIR_TIME,
    l_linenumber % 5 AS _cause
  FROM _li
), _g AS (
  SELECT * EXCLUDE (_cause),
    {_CAUSE_COLS}
  FROM _f
), flights AS (
  SELECT *,
    CAST(year(FL_DATE) AS INTEGER) AS YEAR,
    CAST(month(FL_DATE) AS INTEGER) AS MONTH,
    CAST(quarter(FL_DATE) AS INTEGER) AS QUARTER,
    CAST(isodow(FL_DATE) AS INTEGER) AS DAY_NUM,
    (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[isodow(FL_DATE)] AS DAY_OF_WEEK,
    CASE WHEN month(FL_DATE) IN (12, 1, 2) THEN 'Winter'
         WHEN month(FL_DATE) IN (3, 4, 5) THEN 'Spring'
         WHEN month(FL_DATE) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS SEASON,
    CASE WHEN DISTANCE <= 500 THEN 'Short-haul' WHEN DISTANCE <= 1500 THEN 'Medium-haul'
         WHEN DISTANCE IS NOT NULL THEN 'Long-haul' END AS DISTANCE_CAT,
    CASE WHEN floor(CRS_DEP_TIME / 100) BETWEEN 0 AND 23 THEN CAST(floor(CRS_DEP_TIME / 100) AS INTEGER) END AS DEP_HOUR
  FROM _g
)"""
