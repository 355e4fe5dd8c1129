"""Classification and regression with Spark MLlib.

Model choices mirror the analysis: logistic regression, a 100-tree random
forest and gradient-boosted trees (100 rounds, step 0.3, depth 6) for the
two classifiers; a 100-tree forest and 200-round boosted trees for the
arrival-delay regression; classes at probability > 0.3. The cancellation
"forest" is a *regression* forest on the 0/1 target, thresholded at 0.3,
because that is what the analysis fits.

Training is distributed by MLlib; boosted trees checkpoint every 10
iterations into the cluster's ``spark.checkpoint.dir`` when one is set, so
a lost executor never replays the whole iteration history. On large tables
boosted trees are grown by :mod:`.boosting`, which visits only the entries
of a row that are not zero; the model is MLlib's, the trees are the same up
to rounding between equal gains. Forests of large tables are grown by
:mod:`.forest` in the same way, with draws of their own. Forests of others
keep the node that each row has reached in each tree, so that a pass over
the rows does not walk every tree from its root; the trees are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize
from ..sources.schema import CLASS_THRESHOLD
from . import boosting, evaluate, features, forest
from .design import Design


def _checkpointing(spark) -> bool:
    try:
        checkpoint_dir(spark)
        return True
    except RuntimeError:
        return False


def classifier(kind: str, label: str, seed: int = 42, forest_depth: int = 10):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol=label, regParam=0.0, maxIter=100)
    if kind == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=100,
                                      maxDepth=forest_depth, seed=seed, cacheNodeIds=True)
    if kind == "forest_regression":
        return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=100,
                                     maxDepth=forest_depth, seed=seed, cacheNodeIds=True)
    if kind == "boosted":
        return GBTClassifier(featuresCol="features", labelCol=label, maxIter=100, stepSize=0.3,
                             maxDepth=6, seed=seed, checkpointInterval=10)
    raise ValueError(f"unknown classifier {kind!r}")


def regressor(kind: str, label: str, seed: int = 42, forest_depth: int = 10):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    if kind == "forest":
        return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=100,
                                     maxDepth=forest_depth, seed=seed, cacheNodeIds=True)
    if kind == "boosted":
        return GBTRegressor(featuresCol="features", labelCol=label, maxIter=200, stepSize=0.3,
                            maxDepth=6, seed=seed, checkpointInterval=10)
    raise ValueError(f"unknown regressor {kind!r}")


@dataclass
class Fitted:
    model: object
    feature_names: list[str]
    label: str
    kind: str
    scorer: forest.Scorer | None = None         # of a forest grown by .forest

    def score(self, design: DataFrame) -> DataFrame:
        """Append ``score`` (probability of class 1, or the prediction of
        a regression model) to a table holding the model's feature columns
        (other columns pass through)."""
        from pyspark.ml.feature import VectorAssembler
        if self.scorer is not None and "features" in design.columns:
            return self.scorer.score(design)
        if "features" in design.columns:        # already one vector, see .design
            out = self.model.transform(design)
        else:
            va = VectorAssembler(inputCols=self.feature_names, outputCol="_features", handleInvalid="error")
            out = self.model.copy({self.model.featuresCol: "_features"}).transform(va.transform(design))
        s = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        return out.select(*design.columns, s.alias("score"))


def fit(design: DataFrame | Design, label: str, kind: str, task: str = "classification", seed: int = 42) -> Fitted:
    """Fit on a :class:`.design.Design`, or on a dense design table: numeric
    columns + label + ROW_KEY."""
    from pyspark import StorageLevel
    if isinstance(design, Design):
        v, names = design.rows.withColumn(label, F.col(label).cast("double")), design.names
    else:
        v, names = features.assemble(design, label)
    _checkpointing(v.sparkSession)
    v = v.select("features", label).persist(StorageLevel.MEMORY_AND_DISK)   # read once per iteration
    try:
        est = classifier(kind, label, seed) if task == "classification" else regressor(kind, label, seed)
        scorer = None
        if kind == "boosted":
            model = boosting.fit(est, v, len(names))
        elif kind.startswith("forest"):
            model, scorer = forest.fit(est, v, len(names))
        else:
            model = est.fit(v)
    finally:
        v.unpersist()
    return Fitted(model, names, label, kind, scorer)


def train_test(design: DataFrame | Design, p: float = 0.8):
    """Hash split on ROW_KEY."""
    return design.split(p) if isinstance(design, Design) else features.split(design, p)


def _rows(part: DataFrame | Design) -> DataFrame:
    return part.rows if isinstance(part, Design) else part


def fit_and_score(design: DataFrame | Design, label: str, kind: str, p: float = 0.8, seed: int = 42) -> DataFrame:
    """(label, score) of the test side by a classifier fitted on the train side.

    The scores are stored: a filter on them, or a second reader, would have
    every tree walked again for every row."""
    train, test = train_test(design, p)
    return materialize(fit(train, label, kind, seed=seed).score(_rows(test)).select(F.col(label).alias("label"), "score"))


def classification_report(design: DataFrame | Design, label: str, kind: str, model_name: str,
                          threshold: float = CLASS_THRESHOLD, p: float = 0.8) -> DataFrame:
    """Split, fit on train, score test, one-row metrics (EV-9 layout)."""
    return evaluate.metrics_report(fit_and_score(design, label, kind, p), model_name, threshold=threshold)


def classification_tables(design: DataFrame | Design, label: str, kind: str, threshold: float = CLASS_THRESHOLD,
                          p: float = 0.8) -> DataFrame:
    """The three tables behind the plots of a classifier, stacked: (part, x, y, n).

    ``confusion``: x predicted, y actual, n rows; ``roc``: x false, y true
    positive rate; ``pr``: x recall, y precision, n NULL. One training, one
    scoring; the curves come from one table of distinct scores."""
    scored = evaluate.valid(fit_and_score(design, label, kind, p))
    st = evaluate.score_table(scored)
    cells = evaluate.confusion(evaluate.predict_class(scored, threshold=threshold)).select(
        F.lit("confusion").alias("part"), F.col("Predicted").cast("double").alias("x"), F.col("Actual").cast("double").alias("y"), F.col("Freq").cast("long").alias("n"))
    none = F.lit(None).cast("long").alias("n")
    roc = evaluate.roc_curve(st).select(F.lit("roc").alias("part"), F.col("fpr").alias("x"), F.col("tpr").alias("y"), none)
    pr = evaluate.pr_curve(st).select(F.lit("pr").alias("part"), F.col("recall").alias("x"), F.col("precision").alias("y"), none)
    return cells.unionByName(roc).unionByName(pr)


def classification_facts(design: DataFrame | Design, label: str, kind: str, model_name: str, threshold: float = CLASS_THRESHOLD,
                         p: float = 0.8) -> DataFrame:
    """What must hold of any classifier's test side: rows, positives, scores
    outside 0..1, and rows the confusion counts add up to."""
    scored = fit_and_score(design, label, kind, p)
    y, s = F.col("label"), F.col("score")
    facts = scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(y == 1).alias("n_positive"),
                       F.count_if(s.isNull() | F.isnan(s) | (s < 0) | (s > 1)).alias("n_outside"))
    cells = evaluate.confusion(evaluate.predict_class(evaluate.valid(scored), threshold=threshold)).agg(F.sum("Freq").cast("long").alias("confusion_total"))
    one = evaluate.side_by_side(facts, cells)
    return one.select(F.lit(model_name).alias("model_name"), "*")


def regression_report(design: DataFrame, label: str, kind: str, model_name: str, p: float = 0.8) -> DataFrame:
    """Split by the hash key, fit, score, report MAE / RMSE / R²."""
    train, test = train_test(design, p)
    return _regression_row(fit(train, label, kind, task="regression"), _rows(test), model_name)


def _regression_row(m: Fitted, test: DataFrame, model_name: str) -> DataFrame:
    scored = materialize(m.score(test).select(m.label, "score"))          # stored: see fit_and_score
    r = evaluate.regression_metrics(scored, y=m.label, yhat="score")
    return r.select(F.lit(model_name).alias("model_name"), "*")


def arrival_report(design: Design, kind: str, model_name: str, p: float = 0.8) -> DataFrame:
    """Arrival-delay regression, split within the quartiles of the target, fitted and reported."""
    train, test = design.split(p, strata_groups=4)
    return _regression_row(fit(train, design.label, kind, task="regression"), test.rows, model_name)
