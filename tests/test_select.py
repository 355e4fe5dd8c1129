"""Radix selection: order statistics, thresholds, samples of a given size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylane.functions.columns import hash_unit
from skylane.operators import select


def _frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [3.0, None, float("nan"), 5.0], [0.0, -0.0, 0.0, 1.0],
    [-1e308, 1e308, 1e-308, -5e-324, 5e-324, 0.0], [float("inf"), float("-inf"), 1.0, 2.0, 3.0],
    [7.0] * 500 + [8.0], [1e16 + 2 * i for i in range(300)], [2.0 ** (i / 16) for i in range(-80, 80)],
])
def test_order_statistics_are_exact(spark, values):
    want = sorted(v for v in values if v is not None and not math.isnan(v))
    n, got = select.order_statistics(_frame(spark, values), ["x"], lambda n: list(range(n)))["x"]
    assert n == len(want) and [got[i] for i in range(n)] == want


def test_order_statistics_of_many_small_intervals(spark, monkeypatch):
    monkeypatch.setattr(select, "FEW_ROWS", 3)
    monkeypatch.setattr(select, "FINE_DIGITS", 4)
    rnd = random.Random(5)
    values = [rnd.choice([rnd.gauss(0, 1), rnd.gauss(1000, 1e-6), rnd.randint(0, 9)]) for _ in range(3000)]
    ranks = [0, 1, 700, 1499, 1500, 2998, 2999]
    _, got = select.order_statistics(_frame(spark, values), ["x"], lambda n: ranks)["x"]
    assert got == {r: sorted(values)[r] for r in ranks}


def test_quantiles_of_five_million_distinct_values(spark):
    df = spark.range(5_000_001).select((F.pmod(F.col("id") * 48271, F.lit(5_000_001)) / 7.0).alias("a"), (F.col("id") % 3).alias("b"))
    got = select.quantiles(df, ["a", "b"], [0.25, 0.5])
    a = np.arange(5_000_001) * 48271 % 5_000_001 / 7.0
    assert got["a"] == [np.quantile(a, 0.25), np.quantile(a, 0.5)] and got["b"] == [0.0, 1.0]


def test_no_values(spark):
    assert select.quantiles(_frame(spark, [None, float("nan")]), ["x"], [0.5]) == {"x": [None]}
    assert select.quantiles(_frame(spark, [1.0]).limit(0), ["x"], [0.5]) == {"x": [None]}


def test_thresholds_against_sorting(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab") if i % 50 else None, rnd.choice([rnd.random(), rnd.randrange(4) / 8, 0.5 + rnd.random() / 2 ** 40])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k double")
    for p in (0.001, 0.5, 0.8, 1.0):
        got = {r["g"]: (r["_thr"], r["_below"]) for r in select.rank_thresholds(df, "k", ["g"], lambda n: F.ceil(n * F.lit(p))).collect()}
        for g in ("a", "b", None):
            keys = sorted(k for x, k in rows if x == g)
            thr = keys[math.ceil(len(keys) * p) - 1]
            assert got[g] == (thr, sum(k < thr for k in keys))


@pytest.mark.parametrize("n", [0, 1, 37, 900, 1000, 5000])
def test_sample_has_exactly_n_rows(spark, n):
    df = spark.range(1000).selectExpr("id % 300 AS k", "CASE WHEN id % 7 > 0 THEN id END AS v")
    want = df.withColumn("u", hash_unit("k")).orderBy("u", "k", "v").limit(n).drop("u")
    got = select.sample_rows(df, n, ["k"])
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == min(n, 1000)
    assert sorted(select.sample_rows(df.repartition(5), n, ["k"]).collect(), key=str) == sorted(got.collect(), key=str)
