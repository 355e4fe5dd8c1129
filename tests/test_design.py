"""Level dictionary and sparse designs."""

import random

import pytest
from pyspark.ml.functions import vector_to_array

from skylane.operators import design, features


def _frame(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["b", "b", "b", "a", "c", None, "x y"]), rnd.choice([1, 2, 10, 10, None]), rnd.choice([1.5, 2.5, None, 0.0])) for i in range(400)]
    rows += [(1000, "rare1", 3, 1.0), (1001, "rare2", 3, 1.0), (1002, "rare2", 10, None)]
    return spark.createDataFrame(rows, "ROW_KEY long, s string, m int, x double").withColumn("y", design.F.col("ROW_KEY") % 2)


def test_dictionary_against_dense_one_hot(spark):
    df = _frame(spark).cache()
    got = design.build(df, "y", ["x"], ["s", "m"], 0.01)
    dense = features._design(df, ["x"], ["s", "m"], 0.01, ["s", "m"])
    columns = [c for c in dense.columns if c not in ("ROW_KEY", "y")]
    assert got.names == columns and got.sources == ["x"] + ["s"] * 4 + ["m"] * (len(columns) - 5)
    want = {r["ROW_KEY"]: [float(r[c]) for c in columns] for r in dense.collect()}
    assert {r["ROW_KEY"]: r["v"] for r in got.rows.select("ROW_KEY", vector_to_array("features").alias("v")).collect()} == want
    cells = {}
    for r in design.entries(df, ["x"], ["s", "m"], ["ROW_KEY"], 0.01).collect():
        cells.setdefault(r["ROW_KEY"], [0.0] * len(columns))[r["slot"]] = r["value"]
    assert all(cells.get(k, [0.0] * len(columns)) == v for k, v in want.items())


@pytest.mark.parametrize("limit", [1_000_000, 0])         # 0: the dictionary is joined by key, not broadcast
def test_many_levels(spark, monkeypatch, limit):
    from skylane.operators import prefix
    monkeypatch.setattr(prefix, "MAX_BROADCAST_ROWS", limit)
    df = spark.range(12_000).selectExpr("id AS ROW_KEY", "concat('L', lpad(id % 6000, 5, '0')) AS c", "id % 2 AS y")
    d = design.build(df, "y", [], ["c"])
    assert len(d.names) == 5_999 and d.names[0] == "c_L00001"
    for r in d.rows.where("ROW_KEY IN (0, 6000, 1, 5999)").collect():
        assert r["features"].size == 5_999 and r["features"].indices.tolist() == ([] if r["ROW_KEY"] % 6000 == 0 else [r["ROW_KEY"] % 6000 - 1])


def test_gaps_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0), (2, None, None, 1), (3, "b", None, 0)], "ROW_KEY long, s string, x double, y int")
    d = design.build(df, "y", ["x"], ["s"], None, ["x"])
    assert {r["ROW_KEY"]: r["features"].toArray().tolist() for r in d.rows.collect()} == {1: [1.0, 0.0], 3: [1.0, 1.0]}
    one = design.build(df.where("s = 'a'"), "y", ["x"], ["s"])
    assert one.names == ["x"] and one.rows.count() == 1
    assert design.build(df.limit(0), "y", ["x"], ["s"]).rows.count() == 0


def test_null_only_column_has_no_level(spark):
    df = spark.createDataFrame([(1, None, 0), (2, None, 1)], "ROW_KEY long, s string, y int")
    assert design.level_dictionary(df, ["s"]).collect() == [("s", None, None, None)]
