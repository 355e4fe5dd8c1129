"""Metrics against brute force on small fixtures."""

import random

import pytest

from skylane.operators import evaluate


def _auc_brute(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


def test_auc_ties_average_rank(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 1), float(rnd.randint(0, 9))) for _ in range(400)]
    st = evaluate.score_table(_scored(spark, pairs))
    assert evaluate.roc_auc(st).first()[0] == pytest.approx(_auc_brute(pairs))


def test_auc_reversed_not_flipped(spark):
    pairs = [(1, 0.1), (1, 0.2), (0, 0.8), (0, 0.9), (1, 0.5), (0, 0.4)]
    auc = evaluate.roc_auc(evaluate.score_table(_scored(spark, pairs))).first()[0]
    assert auc == pytest.approx(_auc_brute(pairs)) and auc < 0.5


def test_roc_curve_ends_at_one_one(spark):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    pts = {(r.fpr, r.tpr) for r in evaluate.roc_curve(evaluate.score_table(_scored(spark, pairs))).collect()}
    assert (0.0, 0.0) in pts and (1.0, 1.0) in pts


def test_pr_auc_trapezoid(spark):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    # points (recall, precision): (.5,1) (.5,.5) (1,.667) (1,.5), start (0,1)
    expect = 0.5 * 1.0 + 0.0 + 0.5 * (0.5 + 2 / 3) / 2 + 0.0
    got = evaluate.pr_auc(evaluate.score_table(_scored(spark, pairs))).first()[0]
    assert got == pytest.approx(expect)


def test_confusion_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "label int, pred int")
    cm = {(r.Predicted, r.Actual): r.Freq for r in evaluate.confusion(df).collect()}
    assert cm == {(0, 0): 1, (0, 1): 2, (1, 0): 0, (1, 1): 0}
    m = evaluate.class_metrics(df).first()
    assert m.Precision is None and m.Recall == 0.0 and m.Accuracy == pytest.approx(1 / 3)


def test_metrics_report_drops_null(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (None, 0.5), (1, None)], "label int, score double")
    r = evaluate.metrics_report(df, "m").first()
    assert r.ROC_AUC == 1.0 and r.Accuracy == 1.0 and r.model_name == "m"


def test_regression_perfect_and_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 4.0)], "y double, yhat double")
    r = evaluate.regression_metrics(df).first()
    assert (r.MAE, r.RMSE, r.R2) == (0.0, 0.0, 1.0)
    c = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "y double, yhat double")
    assert evaluate.regression_metrics(c).first().R2 is None


def test_auc_matches_mllib_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rnd = random.Random(5)
    pairs = [(y, min(0.999, max(0.0, 0.3 * y + rnd.random() * 0.7))) for y in (rnd.randint(0, 1) for _ in range(2000))]
    df = spark.createDataFrame([(float(y), s) for y, s in pairs], "label double, score double")
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    ours = evaluate.roc_auc(evaluate.score_table(df)).first()[0]
    assert ours == pytest.approx(ev.evaluate(df), abs=1e-9)


def test_average_precision(spark):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    ap = evaluate.average_precision(evaluate.score_table(_scored(spark, pairs))).first()[0]
    assert ap == pytest.approx(0.5 * 1.0 + 0.5 * (2 / 3))
