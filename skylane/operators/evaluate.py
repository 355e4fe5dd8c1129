"""Model evaluation on a scored DataFrame ``(label, score[, pred])``.

Classification metrics come from ONE aggregation (confusion counts) and
rank metrics from the distributed prefix sums over distinct scores
(:mod:`.prefix`), so neither a sort of all rows in one task nor a
collect of the scores is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import CLASS_THRESHOLD
from .prefix import prefix_sums
from .reshape import contingency


def valid(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Rows where both the label and the score are present."""
    return df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())


def predict_class(df: DataFrame, score: str = "score", threshold: float = CLASS_THRESHOLD,
                  name: str = "pred") -> DataFrame:
    """Class 1 when ``score > threshold`` (strict)."""
    return df.withColumn(name, (F.col(score) > F.lit(float(threshold))).cast("int"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(Predicted, Actual, Freq) for all four cells, zeros included."""
    d = df.select(F.col(pred).cast("int").alias("Predicted"), F.col(label).cast("int").alias("Actual"))
    return contingency(d, "Predicted", "Actual", [0, 1], [0, 1])


def class_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy, Precision, Recall, F1 for positive class 1 (0/0 -> NULL)."""
    y, p = F.col(label), F.col(pred)
    c = df.agg(F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
               F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 0) & (y == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = F.try_divide(tp, tp + fp)
    rec = F.try_divide(tp, tp + fn)
    return c.select(F.try_divide(tp + tn, tp + fp + fn + tn).alias("Accuracy"),
                    prec.alias("Precision"), rec.alias("Recall"),
                    F.try_divide(F.lit(2.0) * prec * rec, prec + rec).alias("F1_score"))


def score_table(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score: pos/neg counts at the score and strictly
    below it, and the class totals."""
    d = df.select(F.col(score).cast("double").alias("score"),
                  (F.col(label) == 1).cast("long").alias("pos"),
                  (F.col(label) == 0).cast("long").alias("neg"))
    return prefix_sums(d, "score", ["pos", "neg"])


def roc_auc(st: DataFrame) -> DataFrame:
    """Area under the ROC curve (higher score = positive; never flipped).
    Mann-Whitney form with average ranks for tied scores."""
    return st.agg(_roc_area().alias("ROC_AUC"))


def _roc_area() -> Column:
    """The ROC area as an aggregate over a score table."""
    return F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.lit(0.5) * F.col("neg"))),
                        F.first("pos_total") * F.first("neg_total"))


def _at_or_above(st: DataFrame) -> DataFrame:
    """Cumulative counts for the threshold "score >= s" (the curve point at s)
    and for "score > s" (the previous point, i.e. next higher score)."""
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    return st.select("score", "pos", "neg", "neg_below", "pos_total", "neg_total",
                     tp.alias("tp"), fp.alias("fp"),
                     (tp - F.col("pos")).alias("tp_prev"), (fp - F.col("neg")).alias("fp_prev"))


def roc_curve(st: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score plus the origin
    (threshold +Infinity)."""
    a = _at_or_above(st)
    pts = a.select(F.col("score").alias("threshold"),
                   F.try_divide(F.col("fp").cast("double"), F.col("neg_total")).alias("fpr"),
                   F.try_divide(F.col("tp").cast("double"), F.col("pos_total")).alias("tpr"))
    origin = st.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(origin)


def pr_curve(st: DataFrame) -> DataFrame:
    """(threshold, recall, precision): one point per distinct score."""
    a = _at_or_above(st)
    return a.select(F.col("score").alias("threshold"),
                    F.try_divide(F.col("tp").cast("double"), F.col("pos_total")).alias("recall"),
                    F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"))


def pr_auc(st: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by the trapezoid rule over
    recall; the curve starts at recall 0 with the precision of the highest
    threshold. Each segment needs only its own row's counts (the previous
    point is "score > s"), so no ordered window is needed."""
    return _at_or_above(st).agg(_pr_area().alias("PR_AUC"))


def _pr_area() -> Column:
    """The PR area as an aggregate over the rows of :func:`_at_or_above`."""
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    first = (F.col("tp_prev") + F.col("fp_prev")) == 0
    prec_prev = F.when(first, prec).otherwise(F.col("tp_prev") / (F.col("tp_prev") + F.col("fp_prev")))
    return F.sum((F.col("pos") / F.col("pos_total").cast("double")) * (prec + prec_prev) / F.lit(2.0))


def pr_auc_interpolated(st: DataFrame) -> DataFrame:
    """Area under the precision-recall curve with the points between two
    scores interpolated by counts (false positives grow in proportion to true
    ones), so precision is not linear in recall; the exact integral.

    On the way from (TP, FP) to (TP', FP') the precision at t true positives
    is t / (t + FP + h (t - TP)), h = (FP' - FP) / (TP' - TP): with
    k = 1 + h and c = FP - h TP its integral is t / k - c / k^2 ln(k t + c)."""
    return _at_or_above(st).agg(_pr_area_interpolated().alias("PR_AUC_interpolated"))


def _pr_area_interpolated() -> Column:
    rise = F.col("pos").cast("double")
    h = F.col("neg") / rise
    k, c = F.lit(1.0) + h, F.col("fp_prev") - h * F.col("tp_prev")
    bent = F.when(c == 0, 0.0).otherwise(c / (k * k) * F.log((F.col("tp") + F.col("fp")) / (F.col("tp_prev") + F.col("fp_prev"))))
    step = F.when(F.col("pos") > 0, rise / k - bent).otherwise(0.0)
    return F.try_divide(F.sum(step), F.first("pos_total").cast("double"))


def average_precision(st: DataFrame) -> DataFrame:
    """Average precision: sum over thresholds of (recall step) x precision
    (the step-wise alternative to the trapezoid PR area)."""
    a = _at_or_above(st)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    return a.agg(F.sum((F.col("pos") / F.col("pos_total").cast("double")) * prec).alias("AP"))


def metrics_report(scored: DataFrame, model_name: str, label: str = "label", score: str = "score",
                   pred: str | None = None, threshold: float = CLASS_THRESHOLD) -> DataFrame:
    """One row: model_name, ROC_AUC, PR_AUC, Accuracy, Precision, Recall,
    F1_score. Rows with a NULL label or score are left out first.

    With classes from the threshold (``pred=None``) everything comes from
    ONE aggregation over the per-score table: the confusion counts at the
    threshold are sums over the distinct scores above / below it, so the
    scored rows are read once. A separate ``pred`` column costs one more
    pass (its own confusion counts).
    """
    d = valid(scored, label, score)
    if pred is not None:
        d = d.select(F.col(label).alias("label"), F.col(score).alias("score"), F.col(pred).alias("pred"))
        st = score_table(d)
        one = side_by_side(roc_auc(st), pr_auc(st), class_metrics(d))
        return one.select(F.lit(model_name).alias("model_name"), "*")
    st = score_table(d.select(F.col(label).alias("label"), F.col(score).alias("score")))
    a = _at_or_above(st)
    above = F.col("score") > F.lit(float(threshold))
    agg = a.agg(
        _roc_area().alias("ROC_AUC"), _pr_area().alias("PR_AUC"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("double").alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("double").alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).cast("double").alias("fn"),
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return agg.select(F.lit(model_name).alias("model_name"), "ROC_AUC", "PR_AUC",
                      F.try_divide(tp + tn, tp + fp + fn + tn).alias("Accuracy"),
                      prec.alias("Precision"), rec.alias("Recall"),
                      F.try_divide(F.lit(2.0) * prec * rec, prec + rec).alias("F1_score"))


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Side-by-side combination of one-row frames without a join: stack
    them (missing columns NULL) and keep each column's one value."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    cols = [c for f in frames for c in f.columns]
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE, RMSE, R² (= 1 - SSE/SST; NULL when the target is constant), one
    aggregation."""
    e = F.col(y) - F.col(yhat)
    d = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    a = d.agg(F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
              F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"))
    return a.select("MAE", "RMSE", F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))
                    .alias("R2"))
