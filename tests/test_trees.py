"""Node tables, importances and exact Shapley values of tree ensembles."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from skylane.operators import design, trees
from skylane.operators.models import Fitted


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 300
    rows = [(i, float(a), str(c), float(b), d, int(a + (c == "u") + 0.5 * b + rng.normal() > 1.2))
            for i, (a, c, b, d) in enumerate(zip(rng.integers(0, 5, n), rng.choice(list("uvwx"), n), rng.random(n).round(2), rng.choice(["p", "q", "r"], n)))]
    df = spark.createDataFrame(rows, "ROW_KEY long, a double, c string, b double, d string, y int")
    return design.build(df, "y", ["a", "b"], ["c", "d"])


ESTIMATORS = {
    "forest": lambda: RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=5, seed=1),
    "forest_regression": lambda: RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=4, seed=2),
    "boosted": lambda: GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=3),
    "boosted_regression": lambda: GBTRegressor(labelCol="y", maxIter=4, maxDepth=4, stepSize=0.3, seed=3),
}


FITTED = {}


def _fit(data, kind):
    if kind not in FITTED:
        FITTED[kind] = _new_fit(data, kind)
    return FITTED[kind]


def _new_fit(data, kind):
    return ESTIMATORS[kind]().fit(data.rows.withColumn("y", design.F.col("y").cast("double")))


def _scores(model, vectors):
    """Scores by walking MLlib's own trees, one vector at a time."""
    from pyspark.ml.linalg import Vectors
    if hasattr(model, "predictProbability") and "RandomForest" in type(model).__name__:
        return np.array([model.predictProbability(Vectors.dense(v))[1] for v in vectors])
    if type(model).__name__ == "GBTClassificationModel":
        return np.array([model.predictRaw(Vectors.dense(v))[1] for v in vectors])
    return np.array([model.predict(Vectors.dense(v)) for v in vectors])


@pytest.mark.parametrize("bits", [7, 1])            # 1: nearly all leaves pattern by pattern
@pytest.mark.parametrize("kind", ESTIMATORS)
def test_shapley_equals_all_coalitions(spark, data, monkeypatch, kind, bits):
    if bits == 1 and kind not in ("forest", "boosted"):
        pytest.skip("one of each is enough")
    monkeypatch.setattr(trees, "DENSE_BITS", bits)
    model = _fit(data, kind)
    rows, back = data.rows.where("ROW_KEY < 3"), data.rows.where("ROW_KEY >= 290")
    got = {}
    for r in trees.forest_shapley(model, rows, back, data.sources, ["ROW_KEY"]).collect():
        got.setdefault(r["ROW_KEY"], {})[r["feature"]] = r["phi"]
    names = sorted(set(data.sources))
    as_lists = lambda d: [r["v"] for r in d.orderBy("ROW_KEY").select(vector_to_array("features").alias("v")).collect()]
    z = np.array(as_lists(back))

    def value(x, chosen):
        mixed = z.copy()
        at = [i for i, s in enumerate(data.sources) if s in chosen]
        mixed[:, at] = np.array(x)[at]
        return _scores(model, mixed).mean()

    for key, x in enumerate(as_lists(rows)):
        for f in names:
            rest = [g for g in names if g != f]
            want = sum(factorial(len(s)) * factorial(len(rest) - len(s)) / factorial(len(names)) * (value(x, {*s, f}) - value(x, set(s)))
                       for k in range(len(rest) + 1) for s in combinations(rest, k))
            assert got[key][f] == pytest.approx(want, abs=1e-9)
        assert sum(got[key].values()) == pytest.approx(_scores(model, [x])[0] - _scores(model, z).mean(), abs=1e-9)


def test_ranks_share_ties_and_rows_do_not_depend_on_partitions(spark, data):
    model = _fit(data, "forest")
    one = trees.forest_shapley(model, data.rows, data.rows, data.sources, ["ROW_KEY"])
    two = trees.forest_shapley(model, data.rows.repartition(7), data.rows.repartition(5), data.sources, ["ROW_KEY"])
    key = lambda r: (r["ROW_KEY"], r["feature"])
    a, b = sorted(one.collect(), key=key), sorted(two.collect(), key=key)
    assert len(a) == 300 * 4
    for x, y in zip(a, b, strict=True):
        assert key(x) == key(y) and x["phi"] == pytest.approx(y["phi"], abs=1e-12)
        same = [r for r in a if r["ROW_KEY"] == x["ROW_KEY"]]
        assert x["abs_phi"] == abs(x["phi"]) and x["rank"] == 1 + sum(r["abs_phi"] > x["abs_phi"] for r in same)


def test_empty_sides(spark, data):
    model = _fit(data, "forest")
    assert trees.forest_shapley(model, data.rows.limit(0), data.rows, data.sources, ["ROW_KEY"]).count() == 0
    with pytest.raises(ValueError):
        trees.forest_shapley(model, data.rows, data.rows.limit(0), data.sources, ["ROW_KEY"])


@pytest.mark.parametrize("kind", ESTIMATORS)
def test_importances_equal_the_models(spark, data, kind):
    model = _fit(data, kind)
    got = trees.importance_table(trees.node_table(model, spark), data.names, "forest" in kind).collect()
    want = dict(zip(data.names, model.featureImportances.toArray()))
    assert {r["feature"]: r["gain"] for r in got} == pytest.approx(want, abs=1e-12)
    for c in ("gain", "cover", "frequency"):
        assert sum(r[c] for r in got) == pytest.approx(1.0)


def test_score_is_the_sum_of_the_leaves(spark, data):
    model = _fit(data, "forest")
    nodes = trees.node_table(model, spark).toPandas()
    group = [sorted(set(data.sources)).index(s) for s in data.sources]
    rows = data.rows.orderBy("ROW_KEY").toArrow().column("features").combine_chunks()
    parts = trees.Rows(rows.chunk(0) if isinstance(rows, trees.pa.ChunkedArray) else rows)
    total = np.zeros(parts.n)
    for _, pdf in nodes.groupby("tree"):
        tree = trees.Tree(pdf, group)
        for value, fails in zip(tree.value, tree.walk(parts.goes_left, parts.n), strict=True):
            total[fails == 0] += value
    scored = Fitted(model, data.names, "y", "forest").score(data.rows).orderBy("ROW_KEY").collect()
    assert total == pytest.approx(np.array([r["score"] for r in scored]), abs=1e-12)


@pytest.mark.parametrize("groups", [4, 1, 40])          # as they are; one group for all slots; a group per slot
@pytest.mark.parametrize("kind", ["forest", "boosted_regression"])
def test_leaves_counted_by_splits_show_the_patterns_of_the_walk(spark, data, kind, groups):
    nodes = trees.node_table(_fit(data, kind), spark).toPandas()
    names = sorted(set(data.sources))
    group = [names.index(s) if groups == 4 else slot % groups for slot, s in enumerate(data.sources)]
    rows = trees.Rows(data.rows.toArrow().column("features").combine_chunks())
    for _, pdf in nodes.groupby("tree"):
        tree = trees.Tree(pdf, group)
        counted = list(tree.counts(rows.goes_left, rows.n))
        walked = [np.unique(fails, return_counts=True) for fails in tree.walk(rows.goes_left, rows.n)]
        assert len(counted) == len(tree.leaves) == len(walked)
        for (at, found), (want_at, want) in zip(counted, walked, strict=True):
            assert at.tolist() == want_at.tolist() and found.tolist() == want.tolist()


def test_patterns_are_as_narrow_as_the_paths(spark, data):
    nodes = trees.node_table(_fit(data, "forest"), spark).toPandas()
    group = [sorted(set(data.sources)).index(s) for s in data.sources]
    rows = trees.Rows(data.rows.toArrow().column("features").combine_chunks())
    for _, pdf in nodes.groupby("tree"):
        assert {fails.dtype for fails in trees.Tree(pdf, group).walk(rows.goes_left, rows.n)} == {np.dtype(np.uint8)}


def test_long_paths_keep_all_their_groups():
    """A path of 20 groups, more than a table of patterns is made for: left is a leaf, right goes on."""
    import pandas as pd
    n, deep = 200, 20
    inner = [(2 * i, i, 2 * i + 1, 2 * i + 2) for i in range(deep)]
    cells = [(node, float(f), 0.5, None, left, right, 0.0) for node, f, left, right in inner]
    cells += [(2 * i + 1, None, None, None, None, None, 1.0) for i in range(deep)] + [(2 * deep, None, None, None, None, None, 2.0)]
    pdf = pd.DataFrame(cells, columns=["node", "feature", "threshold", "categories", "left", "right", "value"]).assign(weight=1.0)
    pdf["categories"] = pdf["categories"].astype(object).where(pdf["categories"].notna(), None)
    tree = trees.Tree(pdf, list(range(deep)))
    x = np.random.default_rng(2).integers(0, 2, (n, deep))
    goes_left = lambda slot, border: x[:, slot] <= border
    counted = list(tree.counts(goes_left, n))
    for (at, found), fails in zip(counted, tree.walk(goes_left, n), strict=True):
        want_at, want = np.unique(fails, return_counts=True)
        assert at.tolist() == want_at.tolist() and found.tolist() == want.tolist()
    assert len(counted) == deep + 1 and max(len(p) for _, p in tree.leaves) == deep
