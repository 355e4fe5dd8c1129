"""The flights table derived from the driver's TPC-H-like tables.

One flight per ``lineitem`` row: ``lineitem ⋈ supplier ⋈ part``. The
mapping rules are the test-input contract (FIXTURES.md §3); the same
rules are written in SQL in :data:`skylane.plans.oracle.FLIGHTS_SQL` for
the DuckDB oracle.

Scale: the two joins are plain equi-joins with no hint. Spark plans them
from size statistics (broadcast while ``supplier``/``part`` are below
``autoBroadcastJoinThreshold``, shuffle joins beyond it) and AQE re-plans
at run time, splitting a skewed join partition if one key is hot. Only the
eleven ``lineitem`` columns used are read (column pruning reaches the scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAUSES = ["CARRIER", "WEATHER", "NAS", "SECURITY", "LATE_AIRCRAFT"]


def _airport(k: Column) -> Column:
    m = k % 200
    code = F.floor(m * m / F.lit(200)).cast("bigint").cast("string")
    return F.concat(F.lit("AP"), F.lpad(code, 3, "0"))


LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def flights_from_tables(lineitem: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    li = lineitem.select(*LINEITEM_COLUMNS)
    su = supplier.select("s_suppkey", "s_nationkey")
    pa = part.select("p_partkey", "p_size")
    j = (li.join(su, li.l_suppkey == su.s_suppkey)
           .join(pa, li.l_partkey == pa.p_partkey))

    ok, pk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    canc = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") <= 8)
    dvt = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 49)
    hhmm = ((ok * 7 + pk) % 25) * 100 + pk % 60
    dep_delay = ((F.col("l_quantity") - 30)
                 + F.round(F.col("l_discount") * 100).cast("bigint") * 4).cast("double")
    arr_delay = F.when(~(canc | dvt),
                       dep_delay + F.round(F.col("l_tax") * 100).cast("bigint") * 2 - 8).cast("double")
    origin, dest = _airport(ok), _airport(pk)

    base = j.select(
        F.col("l_shipdate").cast("date").alias("FL_DATE"),
        F.concat(F.lit("AIRLINE_"), F.col("s_nationkey").cast("string")).alias("AIRLINE"),
        pk.alias("FL_NUMBER"),
        origin.alias("ORIGIN"),
        F.concat(F.lit("CITY_"), F.substring(origin, 3, 3)).alias("ORIGIN_CITY"),
        dest.alias("DEST"),
        F.when(pk % 97 != 0, F.concat(F.lit("CITY_"), F.substring(dest, 3, 3))).alias("DEST_CITY"),
        hhmm.alias("CRS_DEP_TIME"),
        F.when(~canc & (pk % 50 != 0), hhmm.cast("double")).alias("DEP_TIME"),
        F.when(~canc, dep_delay).alias("DEP_DELAY"),
        arr_delay.alias("ARR_DELAY"),
        F.when(canc, 1.0).otherwise(0.0).alias("CANCELLED"),
        F.when(dvt, 1.0).otherwise(0.0).alias("DIVERTED"),
        F.when(ok % 211 != 0, (F.col("p_size") * 50).cast("double")).alias("DISTANCE"),
        F.when(~(canc | dvt), (F.col("p_size") * 6 + 20 + ln).cast("double")).alias("AIR_TIME"),
        (ln % 5).alias("_cause"),
    )
    late = F.col("ARR_DELAY") >= 15
    causes = {f"DELAY_DUE_{name}": F.when(late, F.when(F.col("_cause") == i, F.col("ARR_DELAY"))
                                          .otherwise(F.lit(0.0)))
              for i, name in enumerate(CAUSES)}
    return base.withColumns(causes).drop("_cause")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights over ``{sf_dir}/{lineitem,supplier,part}.parquet``.

    ``lineitem`` is spread over the cores when its file layout gives fewer
    splits than cores (see :func:`skylane.sources.readers.spread`).
    """
    from .readers import spread
    r = spark.read.parquet
    li = r(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_COLUMNS)
    return flights_from_tables(spread(li), r(f"{sf_dir}/supplier.parquet"), r(f"{sf_dir}/part.parquet"))
