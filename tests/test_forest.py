"""Forests grown from the entries that are not zero: with nothing drawn the trees are MLlib's."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from skylane.operators import design, forest, models, trees


def _design(spark, n, few=False):
    rng = np.random.default_rng(n)
    b = rng.integers(0, 3, n) if few else rng.normal(size=n)
    rows = [(i, float(a), float(b), str(c), str(d), float(round(10 * (a + (c == "u") * 3 - (d == "q") * b + rng.normal()))))
            for i, (a, b, c, d) in enumerate(zip(rng.integers(0, 6, n), b, rng.choice(list("uvwxyz"), n), rng.choice(list("pqr"), n)))]
    df = spark.createDataFrame(rows, "ROW_KEY long, a double, b double, c string, d string, t double").repartition(3, "ROW_KEY")
    df = df.withColumn("y", (F.col("t") > 30).cast("double")).withColumn("part", F.col("t") / 7)
    return design.build(df, "y", ["a", "b"], ["c", "d"], keep=("ROW_KEY", "t", "part"))


def _estimator(label, classes, **more):
    one = RandomForestClassifier if classes else RandomForestRegressor
    return one(labelCol=label, **({"numTrees": 2, "maxDepth": 8, "seed": 42, "bootstrap": False, "featureSubsetStrategy": "all"} | more))


KINDS = [("y", True), ("y", False), ("t", False), ("part", False)]       # two classes; 0/1, whole and other numbers


@pytest.mark.parametrize("label, classes, few", [*[(*k, False) for k in KINDS], (*KINDS[1], True), (*KINDS[2], True)])      # few: many rows are alike
def test_trees_are_those_of_mllib(spark, monkeypatch, label, classes, few):
    monkeypatch.setattr(forest, "FEW_CELLS", 0)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 500)
    monkeypatch.setattr(forest, "JOB_BYTES", 1 if few else 1 << 27)
    monkeypatch.setattr(forest, "FLAT_PARTS", 2 if few else 64)
    monkeypatch.setattr(forest, "LABEL_BITS", 14 if few else 28)
    d = _design(spark, 4_200, few)
    rows = d.rows.select("features", label).cache()
    est = _estimator(label, classes, maxDepth=7)
    (ours, scorer), theirs = forest.fit(est, rows, len(d.names)), est.fit(rows)
    assert type(ours) is type(theirs) and ours.getNumTrees == 2 and ours.numFeatures == theirs.numFeatures == len(d.names)
    a, b = (trees.node_table(m, spark).orderBy("tree", "node").toPandas() for m in (ours, theirs))
    for c in ("tree", "weight", "node", "feature", "threshold", "left", "right", "rows"):
        assert a[c].equals(b[c]), c
    assert a["categories"].astype(str).equals(b["categories"].astype(str)) and len(a) > 100
    for c in ("gain", "value"):
        assert a[c].fillna(0).to_numpy() == pytest.approx(b[c].fillna(0).to_numpy(), abs=1e-9)
    both = [models.Fitted(theirs, d.names, label, "forest", s).score(rows).select("score").toPandas()["score"].to_numpy() for s in (scorer, None)]
    assert both[0] == pytest.approx(both[1], abs=1e-9)
    path = str(spark.sparkContext.getCheckpointDir()) + f"/{label}{classes}{few}"
    for m, at in ((ours, "a"), (theirs, "b")):
        m.write().save(path + at)
    stored = [spark.read.parquet(f"{path}{at}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").toPandas() for at in "ab"]
    for c in ("prediction", "impurity"):                # -1: nothing to gain, which rounding may hide where all labels are one fraction
        low = 0 if label == "part" else -1
        assert np.maximum(stored[0][c].to_numpy(), low) == pytest.approx(np.maximum(stored[1][c].to_numpy(), low), abs=1e-9)
    assert np.concatenate(stored[0]["impurityStats"].to_list()) == pytest.approx(np.concatenate(stored[1]["impurityStats"].to_list()), rel=1e-9)
    rows.unpersist()


@pytest.mark.parametrize("label, classes", KINDS[:3])
def test_a_drawn_forest_is_as_good_and_does_not_depend_on_the_partitions(spark, monkeypatch, label, classes):
    d = _design(spark, 4_000, True)
    rows = d.rows.select("features", label).cache()
    est = _estimator(label, classes, bootstrap=True, featureSubsetStrategy="auto", numTrees=20, maxDepth=6)
    theirs = est.fit(rows)
    monkeypatch.setattr(forest, "FEW_CELLS", 0)
    (one, _), (two, _) = forest.fit(est, rows, len(d.names)), forest.fit(est, rows.repartition(7), len(d.names))
    a, b, c = (trees.node_table(m, spark).orderBy("tree", "node").toPandas() for m in (one, two, theirs))
    assert a["rows"].equals(b["rows"]) and a["feature"].equals(b["feature"]) and a["value"].equals(b["value"])
    roots = [x[x["node"] == 0]["rows"] for x in (a, c)]
    assert abs(roots[0].mean() - 4_000) < 60 and 20 < roots[0].std() < 130 and len(roots[0]) == len(roots[1]) == 20
    error = []
    for m in (one, theirs):
        s = models.Fitted(m, d.names, label, "forest").score(rows).select(label, "score").toPandas()
        error.append(float(((s[label] - s["score"]) ** 2).mean()))
    assert error[0] == pytest.approx(error[1], rel=0.1)
    used = [sorted(x.groupby("feature").size().items()) for x in (a, c)]
    assert [f for f, _ in used[0]] == [f for f, _ in used[1]]
    rows.unpersist()


def test_draws_are_poisson():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 32, 400_000, np.uint64)
    for mean in (0, 1, 2, 15, 16, 200):
        got = forest._drawn(bits, np.full(len(bits), mean, np.uint16), [1]).astype(float)
        assert got.mean() == pytest.approx(mean, abs=0.02 * max(1, mean ** 0.5)) and got.var() == pytest.approx(mean, rel=0.03)
    one = np.bincount(forest._drawn(bits, np.ones(len(bits), np.uint8), [1]))[:5] / len(bits)
    assert one == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(5)], abs=0.004)
    edge = forest._drawn(np.array([0, 0x5E2D58D8, 0x5E2D58D9, 0x5E2D58DA, (1 << 32) - 1], np.uint64), np.ones(5, np.uint8), [1])
    assert edge.tolist()[:4] == [0, 0, 1, 1] and edge[4] > 8           # exp(-1) is 0x5E2D58D8.B... / 2^32


def test_draws_of_trees_and_classes_differ():
    h = np.random.default_rng(5).integers(0, 1 << 63, 20_000, np.uint64)
    block = (np.zeros((1, len(h)), np.uint8), h, np.ones(len(h), np.uint8), np.ones(len(h), np.uint8))
    some = [forest._weights(block, True, True, 42, t) for t in range(3)]
    all_ = [x for n, ones in some for x in (n - ones, ones)]
    off = np.corrcoef(np.array(all_, float)) - np.eye(6)
    assert np.abs(off).max() < 0.04
    again = forest._weights((block[0][:, ::-1], h[::-1], *block[2:]), True, True, 42, 1)
    assert (again[0][::-1] == some[1][0]).all() and (again[1][::-1] == some[1][1]).all()


def test_each_node_draws_its_slots():
    got = forest._chosen(1, 2, 3, 5_000, 30, 6)
    assert got.shape == (5_000, 6) and (np.diff(got) > 0).all()
    assert np.bincount(got.ravel(), minlength=30) == pytest.approx(np.full(30, 1_000), rel=0.15)
    assert forest._chosen(1, 2, 3, 2, 4, 4).tolist() == [[0, 1, 2, 3]] * 2


def test_large_tables_are_grown_from_the_entries(spark, monkeypatch):
    d = _design(spark, 600)
    seen = []
    whole = forest.grow
    monkeypatch.setattr(forest, "grow", lambda *a: seen.append(1) or whole(*a))
    monkeypatch.setattr(models, "classifier", lambda kind, label, seed: _estimator(label, kind == "forest", maxDepth=3))
    monkeypatch.setattr(models, "regressor", lambda kind, label, seed: _estimator(label, False, maxDepth=3))
    m = models.fit(d, "y", "forest")
    assert isinstance(m.model, RandomForestClassificationModel) and not seen and m.scorer is None
    monkeypatch.setattr(forest, "FEW_CELLS", 600 * len(d.names) - 1)
    m = models.fit(d, "y", "forest")
    assert isinstance(m.model, RandomForestClassificationModel) and len(seen) == 1 and m.scorer is not None
    assert m.score(d.rows).columns == [*d.rows.columns, "score"]
    assert isinstance(models.fit(d, "y", "forest_regression").model, RandomForestRegressionModel) and len(seen) == 2
    assert isinstance(models.fit(d, "t", "forest", task="regression").model, RandomForestRegressionModel) and len(seen) == 3


def test_rows_that_mllib_refuses_are_refused(spark, monkeypatch):
    monkeypatch.setattr(forest, "FEW_CELLS", 0)
    d = _design(spark, 600)
    for wrong in (F.lit(None).cast("double"), F.lit(float("nan"))):
        rows = d.rows.select("features", F.when(F.col("ROW_KEY") == 5, wrong).otherwise(F.col("y")).alias("y"))
        with pytest.raises(Exception):
            forest.fit(_estimator("y", False), rows, len(d.names))
    rows = d.rows.select("features", F.when(F.col("ROW_KEY") == 5, 0.5).otherwise(F.col("y")).alias("y"))
    with pytest.raises(Exception):
        forest.fit(_estimator("y", True), rows, len(d.names))
