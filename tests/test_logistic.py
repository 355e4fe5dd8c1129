"""Newton fit of the logistic regression."""

import numpy as np
import pytest

from skylane.operators import design, logistic


def _data(spark, n=600, twin=False):
    rng = np.random.default_rng(8)
    a, c = rng.normal(size=n), rng.choice(list("uvw"), n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + a - 1.5 * (c == "v"))))).astype(int)
    df = spark.createDataFrame([(i, float(x), str(z), int(t)) for i, (x, z, t) in enumerate(zip(a, c, y))], "ROW_KEY long, a double, c string, y int")
    if twin:
        df = df.withColumn("b", design.F.col("a") * 2 + 1)
    d = design.build(df, "y", ["a", "b"] if twin else ["a"], ["c"])
    x = np.column_stack([np.ones(n), a, c == "v", c == "w"]).astype(float)
    return d, x, y


def _newton(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - p))
    return b, np.sqrt(np.diagonal(np.linalg.inv(h)))


def test_fit_equals_a_plain_one(spark):
    d, x, y = _data(spark)
    fit = logistic.fit_logistic(d)
    b, se = _newton(x, y)
    assert fit.converged and fit.names == ["(Intercept)", "a", "c_v", "c_w"]
    assert fit.estimate == pytest.approx(b, abs=1e-9) and fit.std_error == pytest.approx(se, abs=1e-6)
    p = 1 / (1 + np.exp(-x @ b))
    assert fit.log_likelihood == pytest.approx((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    got = {r["feature"]: r["gradient"] for r in logistic.gradient(fit, d).collect()}
    assert list(got) == fit.names and max(got.values()) < 1e-9
    scored = [r["p"] for r in d.rows.orderBy("ROW_KEY").select(fit.probability().alias("p")).collect()]
    assert scored == pytest.approx(p)


def test_gradient_tells_a_wrong_fit(spark):
    d, _, _ = _data(spark)
    fit = logistic.fit_logistic(d, max_steps=1)
    assert not fit.converged and max(r["gradient"] for r in logistic.gradient(fit, d).collect()) > 1e-5


def test_dependent_column_has_no_coefficient(spark):
    d, x, y = _data(spark, twin=True)
    fit = logistic.fit_logistic(d)
    assert fit.estimate[2] is None and fit.std_error[2] is None and fit.converged
    assert [b for b in fit.estimate if b is not None] == pytest.approx(_newton(x, y)[0], abs=1e-8)


def test_no_rows_and_separated_classes(spark):
    d, _, _ = _data(spark)
    empty = design.Design(d.rows.limit(0), "y", d.names, d.sources, d.source.limit(0), d.encode)
    assert not logistic.fit_logistic(empty).converged
    df = spark.createDataFrame([(i, float(i), int(i > 9)) for i in range(20)], "ROW_KEY long, a double, y int")
    assert not logistic.fit_logistic(design.build(df, "y", ["a"], []), max_steps=12).converged


def test_a_step_is_one_job_over_packed_rows(spark):
    d, _, _ = _data(spark)
    rows = d.rows.select("features", d.rows.y.cast("double").alias("y")).mapInArrow(logistic._packed, "size binary, slot binary, value binary, y binary").persist()
    n = rows.count()
    assert n < 600 and sum(len(r["value"]) for r in rows.collect()) <= 600 * 2 * 8       # no zero is kept
    spark.sparkContext.setJobGroup("step", "step")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("step"))
        m, g, ll, count = logistic._totals(rows, np.zeros(4))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("step")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows.unpersist()
    plain = spark.range(100).groupBy("id").count()
    assert count == 600 and jobs <= 2 and m.shape == (4, 4) and ll == pytest.approx(600 * np.log(0.5)) and plain.count() == 100
