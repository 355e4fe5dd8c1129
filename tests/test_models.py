"""Model sanity on a separable fixture (fixed seed): AUC well above 0.5,
one score per test row, probabilities in [0, 1]."""

import pytest
from pyspark.sql import functions as F

from skylane.operators import models


@pytest.fixture(scope="module")
def design(spark):
    rows = [(i / 1000.0, float(i % 10), float((i * 7) % 13), 1 if (i % 10) >= 5 else 0) for i in range(1000)]
    return spark.createDataFrame(rows, "ROW_KEY double, a double, b double, y int")


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_classifier_sanity(spark, design, kind):
    tr, te = models.train_test(design)
    m = models.fit(tr, "y", kind)
    sc = m.score(te)
    assert sc.count() == te.count()
    lo, hi = sc.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= lo <= hi <= 1.0
    r = models.classification_report(design, "y", kind, kind).first()
    assert r.ROC_AUC > 0.9


def test_regression_forest_sanity(spark, design):
    r = models.regression_report(design.withColumn("t", F.col("a") * 2.0).drop("y"), "t", "forest", "rf").first()
    assert r.R2 > 0.9


@pytest.mark.parametrize("build", [lambda: models.classifier("forest", "y"), lambda: models.classifier("forest_regression", "y"), lambda: models.regressor("forest", "y")])
def test_forests_keep_node_ids_and_grow_the_same_trees(spark, design, build):
    est = build()
    assert est.getCacheNodeIds() and est.getNumTrees() == 100 and est.getMaxDepth() == 10
    rows = models.features.assemble(design.withColumn("y", F.col("y").cast("double")), "y")[0].select("features", "y").cache()
    kept = est.copy({est.numTrees: 5}).fit(rows)
    walked = est.copy({est.numTrees: 5, est.cacheNodeIds: False}).fit(rows)
    assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:] and len(kept.trees) == 5
    rows.unpersist()


class _Counted:
    """Stands for a fitted model; counts the rows it scores."""

    def __init__(self, spark, label):
        self.calls, self.label = spark.sparkContext.accumulator(0), label

    def score(self, rows):
        calls = self.calls

        @F.udf("double")
        def slow(a):
            calls.add(1)
            return a / 10.0
        return rows.withColumn("score", slow("a"))


@pytest.mark.parametrize("report", ["report", "tables", "facts"])
def test_each_test_row_is_scored_once(spark, design, monkeypatch, report):
    m = _Counted(spark, "y")
    monkeypatch.setattr(models, "fit", lambda *a, **k: m)
    test_rows = models.train_test(design)[1].count()
    if report == "report":
        models.classification_report(design, "y", "logistic", "m").collect()
    elif report == "tables":
        got = {r.part for r in models.classification_tables(design, "y", "logistic").collect()}
        assert got == {"confusion", "roc", "pr"}
    else:
        r = models.classification_facts(design, "y", "logistic", "m").first()
        assert r.n_rows == r.confusion_total == test_rows and r.n_outside == 0
    assert m.calls.value == test_rows


def test_each_test_row_of_a_regression_is_scored_once(spark, design, monkeypatch):
    m = _Counted(spark, "b")
    monkeypatch.setattr(models, "fit", lambda *a, **k: m)
    r = models.regression_report(design, "b", "forest", "m").first()
    assert r.R2 is not None and m.calls.value == models.train_test(design)[1].count()
