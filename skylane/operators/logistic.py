"""Logistic regression by Newton steps (iteratively reweighted least squares).

Every step sums X'WX and X'(y - p) over the rows in the tasks, in one pass over
rows kept by the entries that are not zero; only these sums, as large as the square of the model's width, reach the driver, which
solves for the next coefficients. At the end the same matrix gives the
standard errors. No penalty: the maximum of the likelihood itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .design import Design

CELLS = 1 << 21         # cells of a dense block of rows in a task
INTERCEPT = "(Intercept)"


@dataclass
class LogisticFit:
    """Coefficients by name (the intercept first), None where a column is a
    combination of earlier ones; standard errors, log-likelihood and steps."""

    names: list[str]
    estimate: list[float | None]
    std_error: list[float | None]
    log_likelihood: float
    steps: int
    converged: bool

    def table(self, spark) -> DataFrame:
        """(feature, estimate, std_error, z_value)."""
        rows = [(n, b, s, None if b is None or not s else b / s) for n, b, s in zip(self.names, self.estimate, self.std_error, strict=True)]
        return spark.createDataFrame(rows, "feature string, estimate double, std_error double, z_value double")

    def probability(self, features: str = "features") -> Column:
        """Probability of class 1 for a vector column."""
        b = [0.0 if x is None else x for x in self.estimate]
        weights = F.array(*[F.lit(float(x)) for x in b[1:]])
        eta = F.aggregate(F.zip_with(vector_to_array(features), weights, lambda x, w: x * w), F.lit(float(b[0])), lambda s, p: s + p)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def _packed(batches):
    """Blocks of rows: how many entries each row has that are not zero, their slots and values, and the labels."""
    for b in batches:
        v = dict(zip([f.name for f in b.column("features").type], b.column("features").flatten(), strict=True))
        size = v["values"].value_lengths().to_numpy(zero_copy_only=False)
        values = v["values"].flatten().to_numpy(zero_copy_only=False)
        slot = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)               # dense vectors: the place itself
        sparse = np.repeat(v["type"].to_numpy(zero_copy_only=False) == 0, size)
        if sparse.any():
            slot[sparse] = v["indices"].flatten().to_numpy(zero_copy_only=False)              # indices are null for dense vectors
        row = np.repeat(np.arange(b.num_rows), size)[values != 0]
        parts = [np.bincount(row, minlength=b.num_rows).astype(np.int32), slot[values != 0].astype(np.int32), values[values != 0],
                 b.column("y").to_numpy(zero_copy_only=False)]
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["size", "slot", "value", "y"])


def _blocks(batches, width: int):
    """(x, y) of at most CELLS cells each, x dense with a first column of ones."""
    step = max(1, CELLS // width)
    for b in batches:
        for size, slot, value, y in zip(*(b.column(c).to_pylist() for c in ("size", "slot", "value", "y")), strict=True):
            size, slot, value, y = np.frombuffer(size, np.int32), np.frombuffer(slot, np.int32), np.frombuffer(value), np.frombuffer(y)
            first = np.concatenate([[0], np.cumsum(size)])
            for at in range(0, len(y), step):
                n = min(step, len(y) - at)
                of = slice(first[at], first[at + n])
                x = np.zeros((n, width))
                x[:, 0] = 1.0
                x[np.repeat(np.arange(n), size[at:at + n]), slot[of] + 1] = value[of]
                yield x, y[at:at + n]


def _sums(beta: np.ndarray):
    """Rows (i, values): row i of X'WX; i = -1: X'(y - p), the log-likelihood and the number of rows. All of one length."""
    width = len(beta)

    def run(batches):
        xwx, xr, ll, n = np.zeros((width, width + 2)), np.zeros(width), 0.0, 0
        for x, y in _blocks(batches, width):
            eta = x @ beta
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            xwx[:, :width] += (x * (p * (1 - p))[:, None]).T @ x
            xr += x.T @ (y - p)
            ll += float((y * eta - np.logaddexp(0, eta)).sum())
            n += len(y)
        rows = [*xwx, np.concatenate([xr, [ll, n]])]
        yield pa.RecordBatch.from_arrays([pa.array([*range(width), -1], pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["i", "values"])
    return run


def _totals(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """One pass over the packed rows, one job."""
    width = len(beta)
    parts = rows.mapInArrow(_sums(beta), "i int, values array<double>")
    found = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("values")).alias("s"))
    out = {r["i"]: r["s"].toArray() for r in found.collect()}
    if not out:
        return np.zeros((width, width)), np.zeros(width), 0.0, 0
    last = out[-1]
    return np.array([out[i][:width] for i in range(width)]), last[:width], float(last[width]), int(last[width + 1])


def independent(m: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Which columns of X are no combination of earlier ones, from X'WX."""
    d = np.sqrt(np.maximum(np.diagonal(m), 0.0))
    a = m / np.where(d > 0, d, 1)[:, None] / np.where(d > 0, d, 1)
    keep = np.zeros(len(m), bool)
    for j in range(len(m)):
        if d[j] > 0 and a[j, j] > tolerance:
            keep[j] = True
            a[j + 1:, j + 1:] -= np.outer(a[j + 1:, j], a[j, j + 1:]) / a[j, j]
    return keep


def fit_logistic(design: Design, max_steps: int = 30, tolerance: float = 1e-10) -> LogisticFit:
    """Maximum likelihood fit of ``design`` (label 0/1). Ends when no mean gradient component exceeds ``tolerance``;
    a step that would lower the likelihood is halved. With separated classes there is no maximum: the fit stops
    after ``max_steps`` and says so in ``converged``."""
    from pyspark import StorageLevel
    rows = design.rows.select("features", F.col(design.label).cast("double").alias("y")).filter(F.col("y").isNotNull())
    rows = rows.mapInArrow(_packed, "size binary, slot binary, value binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)        # read once per step
    try:
        beta = np.zeros(1 + len(design.names))
        m, g, ll, n = _totals(rows, beta)
        keep, steps, done = independent(m), 0, n == 0
        while not done and steps < max_steps:
            step = np.zeros_like(beta)
            step[keep] = np.linalg.solve(m[np.ix_(keep, keep)], g[keep])
            for _ in range(20):
                m2, g2, ll2, _ = _totals(rows, beta + step)
                if ll2 >= ll - 1e-9 * abs(ll):
                    break
                step /= 2
            beta, m, g, ll, steps = beta + step, m2, g2, ll2, steps + 1
            done = np.abs(g[keep]).max(initial=0.0) / n <= tolerance
    finally:
        rows.unpersist()
    error = np.full(len(beta), np.nan)
    if keep.any():
        error[keep] = np.sqrt(np.diagonal(np.linalg.inv(m[np.ix_(keep, keep)])))
    value = lambda v: [float(x) if k else None for x, k in zip(v, keep, strict=True)]
    return LogisticFit([INTERCEPT, *design.names], value(beta), value(error), ll, steps, bool(done and n))


def gradient(fit: LogisticFit, design: Design) -> DataFrame:
    """(feature, gradient): size of the mean derivative of the log-likelihood for each coefficient, from the rows and
    the coefficients alone, with built-in expressions; 0 at the maximum."""
    e = design.rows.select(vector_to_array("features").alias("x"), (F.col(design.label).cast("double") - fit.probability()).alias("e"))
    means = [F.avg("e"), *[F.avg(F.col("x")[i] * F.col("e")) for i in range(len(design.names))]]
    wide = e.agg(F.array(*[F.abs(m) for m in means]).alias("g"))
    return wide.select(F.inline(F.arrays_zip(F.array(*[F.lit(n) for n in fit.names]).alias("feature"), F.col("g").alias("gradient"))))
