"""Boosted trees grown from the entries that are not zero: the trees are MLlib's."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from skylane.operators import boosting, design, models, trees


def _design(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, float(a), float(b), str(c), str(d), float(a + (c == "u") * 3 - (d == "q") * b + rng.normal()))
            for i, (a, b, c, d) in enumerate(zip(rng.integers(0, 6, n), rng.normal(size=n), rng.choice(list("uvwxyz"), n), rng.choice(list("pqr"), n)))]
    df = spark.createDataFrame(rows, "ROW_KEY long, a double, b double, c string, d string, t double").repartition(3, "ROW_KEY")
    return design.build(df.withColumn("y", (F.col("t") > 3).cast("double")), "y", ["a", "b"], ["c", "d"], keep=("ROW_KEY", "t"))


ESTIMATORS = {"y": lambda: GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.3, seed=42),
              "t": lambda: GBTRegressor(labelCol="t", maxIter=4, maxDepth=3, stepSize=0.3, seed=42)}


@pytest.mark.parametrize("n", [3_000, 12_000])          # thresholds from all rows, and from MLlib's sample of them
@pytest.mark.parametrize("label", ESTIMATORS)
def test_trees_are_those_of_mllib(spark, monkeypatch, label, n):
    monkeypatch.setattr(boosting, "FEW_CELLS", 0)
    monkeypatch.setattr(boosting, "ANEW", 3)
    monkeypatch.setattr(boosting, "FLAT_PARTS", 2 if n == 3_000 else 64)
    d = _design(spark, n)
    rows = d.rows.select("features", label).cache()
    est = ESTIMATORS[label]()
    ours, theirs = boosting.fit(est, rows, len(d.names)), est.fit(rows)
    assert type(ours) is type(theirs) and ours.getNumTrees == 4 and ours.numFeatures == theirs.numFeatures == len(d.names)
    a, b = (trees.node_table(m, spark).orderBy("tree", "node").toPandas() for m in (ours, theirs))
    for c in ("tree", "weight", "node", "feature", "threshold", "left", "right", "rows"):
        assert a[c].equals(b[c]), c
    assert a["categories"].astype(str).equals(b["categories"].astype(str))
    for c in ("gain", "value"):
        assert a[c].fillna(0).to_numpy() == pytest.approx(b[c].fillna(0).to_numpy(), abs=1e-9)
    both = [models.Fitted(m, d.names, label, "boosted").score(rows).select("score").toPandas()["score"].to_numpy() for m in (ours, theirs)]
    assert both[0] == pytest.approx(both[1], abs=1e-9)
    rows.unpersist()


def test_a_row_is_kept_by_its_entries_not_by_the_slots(spark):
    d = _design(spark, 600)
    binary = {i for i, s in enumerate(d.sources) if s in "cd"}
    layout = boosting._layout(d.rows, len(d.names), binary, 600, 32, 42)
    batches = d.rows.select("features", "y").toArrow().to_batches()
    for r in (r for b in boosting._packed(layout, True)(batches) for r in b.to_pylist()):
        cells, y, _ = boosting._block(layout.kind, True)(r)
        assert cells.shape == (4, len(y)) and cells.dtype == np.uint16 and len(d.names) == 9        # two numbers, a level of c and one of d


def test_large_tables_are_grown_from_the_entries(spark, monkeypatch):
    d = _design(spark, 600)
    seen = []
    whole = boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda *a: seen.append(1) or whole(*a))
    monkeypatch.setattr(models, "classifier", lambda kind, label, seed: ESTIMATORS["y"]())
    monkeypatch.setattr(models, "regressor", lambda kind, label, seed: ESTIMATORS["t"]())
    assert isinstance(models.fit(d, "y", "boosted").model, GBTClassificationModel) and not seen
    monkeypatch.setattr(boosting, "FEW_CELLS", 600 * len(d.names) - 1)
    assert isinstance(models.fit(d, "y", "boosted").model, GBTClassificationModel) and len(seen) == 4
    assert isinstance(models.fit(d, "t", "boosted", task="regression").model, GBTRegressionModel) and len(seen) == 8


def test_rows_that_mllib_refuses_are_refused(spark, monkeypatch):
    monkeypatch.setattr(boosting, "FEW_CELLS", 0)
    d = _design(spark, 600)
    for wrong in (F.lit(None).cast("double"), F.lit(2.0)):
        rows = d.rows.select("features", F.when(F.col("ROW_KEY") == 5, wrong).otherwise(F.col("y")).alias("y"))
        with pytest.raises(Exception):
            boosting.fit(ESTIMATORS["y"](), rows, len(d.names))


def _few_kinds(spark, n):
    """Rows of few kinds: two numbers of four values, two columns of three levels, labels that differ within a kind."""
    rng = np.random.default_rng(n)
    rows = [(i, float(a), float(b), str(c), str(d), float(a - (c == "u") * 2 + (d == "q") * b + rng.normal()))
            for i, (a, b, c, d) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, 4, n), rng.choice(list("uvw"), n), rng.choice(list("pqr"), n)))]
    df = spark.createDataFrame(rows, "ROW_KEY long, a double, b double, c string, d string, t double").repartition(5, "ROW_KEY")
    return design.build(df.withColumn("y", (F.col("t") > 1).cast("double")), "y", ["a", "b"], ["c", "d"], keep=("ROW_KEY", "t"))


@pytest.mark.parametrize("label", ESTIMATORS)
def test_alike_rows_are_kept_once(spark, monkeypatch, label):
    monkeypatch.setattr(boosting, "FEW_CELLS", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)            # alike rows come from many blocks
    d = _few_kinds(spark, 4_000)
    rows = d.rows.select("features", label).cache()
    kept = []
    whole = boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda blocks, *a: kept.append(blocks.map(lambda b: b[0].shape[1]).sum()) or whole(blocks, *a))
    ours, theirs = boosting.fit(ESTIMATORS[label](), rows, len(d.names)), ESTIMATORS[label]().fit(rows)
    assert set(kept) == {rows.select("features").distinct().count()} and max(kept) <= 4 * 4 * 3 * 3
    a, b = (trees.node_table(m, spark).orderBy("tree", "node").toPandas() for m in (ours, theirs))
    for c in ("tree", "node", "feature", "threshold", "left", "right", "rows"):
        assert a[c].equals(b[c]), c
    for c in ("gain", "value"):
        assert a[c].fillna(0).to_numpy() == pytest.approx(b[c].fillna(0).to_numpy(), abs=1e-9)
    rows.unpersist()


def test_the_key_of_a_row_does_not_depend_on_its_block():
    layout = boosting.Layout({}, np.arange(6))                  # five 0/1 slots; cell 5 fills up short rows
    sums = np.array([[1.0, 1.0], [1.0, -1.0], [1.0, 1.0]])
    narrow = boosting._record(np.array([[0, 3]], layout.kind), sums)
    wide = boosting._record(np.array([[0, 1], [5, 3]], layout.kind), sums)
    got = [r for b in boosting._keyed(layout)([narrow, wide]) for r in b.to_pylist()]
    zero = np.array([0], layout.kind).tobytes()
    assert [r["key"] for r in got].count(zero) == 2 and len({r["key"] for r in got}) == 3
    kept = next(iter(boosting._blocked(layout)(boosting._keyed(layout)([wide])))).to_pylist()[0]
    cells, labels, _ = boosting._block(layout.kept, True)(kept)
    assert sorted(zip(*cells.tolist())) == [(0, 5), (1, 3)] and labels.tolist() == [[1, 1], [1, -1]]


def test_deep_trees_are_walked_as_they_are_split():
    """Trees of more than 64 nodes, with leaves on the way: rows end where node by node comparing leads."""
    rng = np.random.default_rng(1)
    n_cells, depth = 40, 8
    cells = np.array([rng.integers(0, 20, 500), rng.integers(20, 38, 500)]).astype(np.uint8)
    tree, splits = boosting.Grown.root(depth, n_cells), {}
    for i in range(1, 1 << depth):
        if i == 1 or (i // 2 in splits and rng.random() < 0.9):
            splits[i] = (int(rng.integers(0, 38)), int(rng.integers(0, 8)), bool(rng.random() < 0.5))
            splits[i] = (splits[i][0], min(splits[i][1], 37 - splits[i][0]), splits[i][2])
            tree.split(i, *splits[i])
    for levels in range(depth + 1):
        for row, at in zip(cells.T, tree.walk(cells, levels)):
            want = 1
            for _ in range(levels):
                low, span, left = splits.get(want, (0, -1, False))
                hit = any(low <= c <= low + span for c in row)
                want = 2 * want + int(hit != left)
            assert at == want
