"""The flights view reproduces the counts listed in FIXTURES.md §3 (sf0.001)."""

from pyspark.sql import functions as F


def test_fixture_counts_sf0001(flights_small):
    f = flights_small
    a, d = F.col("ARR_DELAY"), F.col("DEP_DELAY")
    r = f.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(a > 15).alias("late"), F.count_if(a <= 15).alias("ontime"), F.count_if(a.isNull()).alias("na"),
        F.count_if(F.col("CANCELLED") == 1).alias("canc"), F.count_if(F.col("DIVERTED") == 1).alias("div"),
        F.count_if(d > 0).alias("dep0"), F.count_if(d > 15).alias("dep15"),
        F.count_if(F.floor(F.col("CRS_DEP_TIME") / 100) == 24).alias("h24"),
        F.count_if((F.col("DELAY_DUE_WEATHER") > 0) & (a == 15)).alias("w15"),
        F.count_if(F.col("DISTANCE") == 500).alias("d500"), F.count_if(F.col("DISTANCE") == 1500).alias("d1500"),
        F.count_if(F.col("DISTANCE").isNull()).alias("dnull"), F.count_if(F.col("DEST_CITY").isNull()).alias("cnull"),
        F.count_distinct("AIRLINE").alias("airlines"), F.count_distinct("ORIGIN").alias("origins"),
        F.count_distinct("DEST").alias("dests"), F.count_distinct(F.trunc("FL_DATE", "month")).alias("months"),
        F.min(a).alias("amin"), F.max(a).alias("amax"),
    ).first()
    assert (r.rows, r.late, r.ontime, r.na) == (6000, 2995, 2803, 202)
    assert (r.canc, r.div, r.dep0, r.dep15, r.h24, r.w15) == (166, 36, 4584, 3006, 238, 26)
    assert (r.d500, r.d1500, r.dnull, r.cnull) == (94, 103, 44, 98)
    assert (r.airlines, r.origins, r.dests, r.months) == (10, 150, 150, 83)
    assert (r.amin, r.amax) == (-36.0, 68.0)
