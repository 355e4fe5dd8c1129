"""Fitted tree ensembles as tables: nodes, importances, exact Shapley values.

``node_table`` reads the nodes of an MLlib ensemble as a DataFrame. From it
come the importances (sums per feature) and the exact Shapley values of any
number of rows against any number of background rows:

For a leaf, only the source features on its path matter. A row passes or
fails each of them, and so does a background row; whether the leaf is reached
when some features come from the row and the others from the background
depends on these two patterns alone. So one pass over the background counts
the patterns per leaf (a table as large as the model, whatever the number of
background rows), and one pass over the explained rows looks up, for the
pattern of each leaf, the exact average over all orders of the features.
Nothing is sampled, and the work per row does not grow with the background.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_folder

CHUNK_ROWS = 1 << 15        # rows counted at once, or explained with one set of leaf tables
BATCH_ROWS = 1 << 13        # rows explained by one tree at once
KNOWN_BYTES = 1 << 25       # comparisons remembered at once
DENSE_BITS = 7              # leaves with more features on their path are treated pattern by pattern


# ------------------------------------------------------------------- nodes
def node_table(model, spark) -> DataFrame:
    """(tree, weight, node, feature, threshold, categories, left, right, gain, rows, value): a row per node of the ensemble.

    ``feature`` is the slot of the split, NULL for a leaf; rows with values up
    to ``threshold``, or among the ``categories`` where the split has these,
    go left. ``value`` is the node's answer: the share of
    class 1 of a classification forest, else the prediction. The sum over the
    trees of weight x value of the leaf reached is the score (for boosted
    classification the margin)."""
    path = new_folder(spark, "model")
    model.write().save(path)
    trees = spark.read.parquet(f"{path}/treesMetadata")
    trees = trees.select(F.col(trees.columns[0]).alias("tree"), F.col(trees.columns[2]).cast("double").alias("weight"))
    n = F.col("nodeData")
    stats = n["impurityStats"]
    forest = "RandomForest" in type(model).__name__
    shares = forest and "Classification" in type(model).__name__
    value = stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if shares else n["prediction"]
    weight = F.lit(1.0 / len(model.trees)) if forest else F.col("weight")
    inner, border = n["leftChild"] >= 0, n["split"]["leftCategoriesOrThreshold"]
    number = n["split"]["numCategories"] < 0
    nodes = spark.read.parquet(f"{path}/data").withColumnRenamed("treeID", "tree").join(F.broadcast(trees), "tree")      # a row per tree
    return nodes.select(
        "tree", weight.alias("weight"), n["id"].alias("node"),
        F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner & number, F.get(border, F.lit(0))).alias("threshold"), F.when(inner & ~number, border).alias("categories"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
        F.when(inner, n["gain"]).alias("gain"), n["rawCount"].alias("rows"), value.alias("value"))


def importance_table(nodes: DataFrame, names: list[str], per_tree: bool) -> DataFrame:
    """(feature, gain, cover, frequency), largest gain first; each sums to 1.

    gain: impurity decrease times rows, over the splits on the feature, each
    tree scaled to 1 first if ``per_tree`` (forests) or not (boosting);
    cover: rows that the splits saw; frequency: number of splits. Features
    never split on have zeros."""
    spark = nodes.sparkSession
    used = nodes.filter(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * F.col("rows")).alias("g"), F.sum("rows").cast("double").alias("c"), F.count(F.lit(1)).cast("double").alias("f"))
    if per_tree:
        whole = used.groupBy("tree").agg(F.sum("g").alias("t"))
        used = used.join(F.broadcast(whole), "tree").withColumn("g", F.coalesce(F.try_divide("g", "t"), F.lit(0.0)))     # a row per tree
    sums = used.groupBy("feature").agg(*[F.sum(c).alias(c) for c in "gcf"])
    slots = spark.createDataFrame(list(enumerate(names)), "slot int, name string")
    d = slots.join(F.broadcast(sums), F.col("slot") == F.col("feature"), "left")                     # a row per slot
    one = sums.agg(*[F.sum(c).alias(f"all_{c}") for c in "gcf"])
    share = lambda c: F.coalesce(F.try_divide(c, f"all_{c}"), F.lit(0.0))
    return (d.join(F.broadcast(one)).select(F.col("name").alias("feature"), share("g").alias("gain"), share("c").alias("cover"),
                                            share("f").alias("frequency")).orderBy(F.desc("gain"), "feature"))


# ----------------------------------------------------------- Shapley values
class Tree:
    """A tree as arrays, and for each leaf the groups on its path in order of first use."""

    def __init__(self, pdf: pd.DataFrame, groups: list[int]) -> None:
        pdf = pdf.sort_values("node")
        if (pdf["node"].to_numpy() != np.arange(len(pdf))).any():
            raise ValueError("nodes are not numbered from 0")
        inner = pdf["feature"].notna().to_numpy()
        whole = lambda c: pdf[c].fillna(-1).to_numpy().astype(int)
        self.feature, self.left, self.right = whole("feature"), whole("left"), whole("right")
        # what goes left: values up to a number, or a set of values
        self.border = [t if c is None else frozenset(c) for t, c in zip(pdf["threshold"], pdf["categories"], strict=True)]
        self.weight = float(pdf["weight"].iloc[0])
        self.bit = np.full(len(pdf), -1)
        self.size = np.zeros(len(pdf), int)         # groups on the path to a node, its own included
        self.leaves: list[tuple[int, tuple[int, ...]]] = []         # node and groups, in the order of the walk
        self.value: list[float] = []
        values = pdf["value"].to_numpy(dtype=float)
        stack: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        while stack:
            node, path = stack.pop()
            if not inner[node]:
                self.size[node] = len(path)
                self.leaves.append((node, path))
                self.value.append(values[node] * self.weight)
                continue
            g = groups[self.feature[node]]
            if g not in path:
                path = (*path, g)
            self.bit[node], self.size[node] = path.index(g), len(path)
            stack += [(self.right[node], path), (self.left[node], path)]
        self.first = np.concatenate([[0], np.cumsum([1 << len(p) for _, p in self.leaves])])       # place of each leaf's first pattern

        bits = max(len(p) for _, p in self.leaves) + 1              # a pattern and one more answer
        self.kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32

    def walk(self, goes_left: Callable[[int, float | frozenset], np.ndarray], rows: int) -> Iterator[np.ndarray]:
        """For each leaf in order, the pattern of each row: bit i set where the row fails group i of the path."""
        stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(rows, self.kind))]
        while stack:
            node, fails = stack.pop()
            if self.bit[node] < 0:
                yield fails
                continue
            stack += self._below(node, fails, goes_left(self.feature[node], self.border[node]))

    def _below(self, node: int, fails: np.ndarray, left: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The right and the left child with the patterns of the rows there."""
        bit = self.kind(1 << int(self.bit[node]))
        out = left * bit
        right = fails | out
        out ^= bit
        out |= fails
        return [(self.right[node], right), (self.left[node], out)]

    def counts(self, goes_left: Callable[[int, float | frozenset], np.ndarray], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each leaf in order, the patterns shown and their rows.

        Two leaves of one split have the same groups on their paths, so their
        rows are counted once, with the answer of the split as one more bit."""
        stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(rows, self.kind))]
        while stack:
            node, fails = stack.pop()
            k = int(self.size[node])
            if self.bit[node] < 0:
                yield _shown(np.bincount(fails, minlength=1 << k)) if k <= 16 else np.unique(fails, return_counts=True)
                continue
            left = goes_left(self.feature[node], self.border[node])
            if k > 15 or self.bit[self.left[node]] >= 0 or self.bit[self.right[node]] >= 0:
                stack += self._below(node, fails, left)
                continue
            low = 1 << int(self.bit[node])
            both = np.bincount(left * self.kind(1 << k) | fails, minlength=2 << k).reshape(2, -1, 2, low)
            for passes, other in ((both[1], both[0]), (both[0], both[1])):      # the left leaf, then the right one
                found = passes.copy()
                found[:, 1] += other[:, 0] + other[:, 1]
                yield _shown(found.ravel())


def _shown(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(found)
    return at, found[at]


class Rows:
    """Sparse rows by column, with remembered comparisons."""

    def __init__(self, vectors: pa.StructArray) -> None:
        self.n = len(vectors)
        field = dict(zip([f.name for f in vectors.type], vectors.flatten(), strict=True))       # unlike field(), minds a slice's offset
        kind, values, indices = field["type"].to_numpy(zero_copy_only=False), field["values"], field["indices"]
        size = values.value_lengths().to_numpy(zero_copy_only=False)
        flat = values.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(self.n), size)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        slot = np.arange(len(flat)) - np.repeat(start, size)                  # dense vectors: the place itself
        sparse = np.repeat(kind == 0, size)
        if sparse.any():
            slot[sparse] = indices.flatten().to_numpy(zero_copy_only=False)   # indices are null for dense vectors
        order = np.argsort(slot, kind="stable")
        self.row, self.flat = row[order], flat[order]
        self.cuts = np.searchsorted(slot[order], np.arange(int(slot.max(initial=-1)) + 2))
        self.known: dict[tuple[int, float | frozenset], np.ndarray] = {}

    def goes_left(self, slot: int, border: float | frozenset) -> np.ndarray:
        found = self.known.get((slot, border))
        if found is None:
            one = isinstance(border, float)
            found = np.full(self.n, 0.0 <= border if one else 0.0 in border)
            if slot + 1 < len(self.cuts):
                at = slice(self.cuts[slot], self.cuts[slot + 1])
                found[self.row[at]] = self.flat[at] <= border if one else np.isin(self.flat[at], list(border))
            if len(self.known) * max(self.n, BATCH_ROWS) > KNOWN_BYTES:
                self.known.clear()
            self.known[slot, border] = found
        return found


def _bits(k: int, patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(k)) & 1


def shapley_kernel(k: int, fails: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Shapley values (row patterns x background patterns x k) of the game that
    pays 1 when the leaf is reached.

    Groups that both pass do not matter, one that both fail rules the leaf
    out. Of the a groups only the row passes all must come from it, of the b
    only the background passes none may."""
    x, z = _bits(k, fails)[:, None, :], _bits(k, background)[None, :, :]
    plus, minus = (z & ~x & 1).astype(float), (x & ~z & 1).astype(float)
    a, b = plus.sum(axis=2).astype(int), minus.sum(axis=2).astype(int)
    fact = np.array([math.factorial(i) for i in range(k + 1)], dtype=float)
    gain = np.where(a > 0, fact[np.maximum(a - 1, 0)] * fact[b] / fact[a + b], 0.0)
    loss = np.where(b > 0, fact[a] * fact[np.maximum(b - 1, 0)] / fact[a + b], 0.0)
    never = (x & z).any(axis=2)
    return np.where(never[..., None], 0.0, plus * gain[..., None] - minus * loss[..., None])


@lru_cache(maxsize=16)
def _whole_kernel(k: int) -> np.ndarray:
    every = np.arange(1 << k)
    return np.ascontiguousarray(shapley_kernel(k, every, every).transpose(1, 0, 2)).reshape(1 << k, -1)


def _batches(batches, rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _split(batch: pa.RecordBatch, rows: int) -> list[Rows]:
    """Rows of a batch in parts; ``features`` is a vector column."""
    return [Rows(batch.column("features").slice(at, rows)) for at in range(0, batch.num_rows, rows)]


def _count_patterns(model):
    """Rows tree, cells, counts: the patterns the background shows, by place in the tree's table."""
    def run(batches):
        trees: dict[int, Tree] = model.value
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        n = 0
        for batch in _batches(batches, CHUNK_ROWS):
            n += batch.num_rows
            for rows in _split(batch, CHUNK_ROWS):
                for t, tree in trees.items():
                    cells, counts = [], []
                    for leaf, (at, found) in enumerate(tree.counts(rows.goes_left, rows.n)):
                        cells.append(at + tree.first[leaf])
                        counts.append(found)
                    total[t] = _added(total.get(t), np.concatenate(cells), np.concatenate(counts))
        for t, (cells, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([n], pa.int64()), pa.array([cells], pa.list_(pa.int64())),
                                              pa.array([counts], pa.list_(pa.int64()))], ["tree", "n", "cells", "counts"])
    return run


def _added(old, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if old is None:
        return cells, counts
    if len(old[0]) == len(cells) and (old[0] == cells).all():
        return cells, old[1] + counts
    both, place = np.unique(np.concatenate([old[0], cells]), return_inverse=True)
    return both, np.bincount(place, weights=np.concatenate([old[1], counts])).astype(np.int64)


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = None
    for cells, counts in zip(pdf["cells"], pdf["counts"], strict=True):
        total = _added(total, np.asarray(cells), np.asarray(counts))
    return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "n": [int(pdf["n"].sum())], "cells": [total[0]], "counts": [total[1]]})


def background_counts(background: DataFrame, trees: dict[int, Tree]) -> tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows of the background, and for each tree the patterns seen with their counts. One pass; what the tasks
    hand on, and what reaches the driver, is as large as the model."""
    spark = background.sparkSession
    model = spark.sparkContext.broadcast(trees)
    schema = "tree int, n long, cells array<long>, counts array<long>"
    found = background.select("features").mapInArrow(_count_patterns(model), schema)
    parts = max(1, math.isqrt(background.rdd.getNumPartitions()))
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    add = lambda pdf: _add_up(pdf)
    some = found.groupBy("tree", "part").applyInPandas(add, schema)           # first within groups of tasks, then all
    rows = some.groupBy("tree").applyInPandas(add, schema).collect()
    model.destroy()
    return (rows[0]["n"] if rows else 0), {r["tree"]: (np.array(r["cells"], np.int64), np.array(r["counts"], np.int64)) for r in rows}


def _leaf_values(tree: Tree, counts: tuple[np.ndarray, np.ndarray], n: int, n_groups: int) -> list[np.ndarray | None]:
    """For each leaf with few groups, the values of all row patterns (patterns x groups)."""
    out: list[np.ndarray | None] = [None] * len(tree.leaves)
    by_size: dict[int, list[int]] = {}
    for i, (_, path) in enumerate(tree.leaves):
        by_size.setdefault(len(path), []).append(i)
    for k, leaves in by_size.items():
        if not 0 < k <= DENSE_BITS:
            continue
        c = np.zeros((len(leaves), 1 << k))
        for j, i in enumerate(leaves):
            at, found = _leaf_counts(tree, counts, i)
            c[j, at] = found * (tree.value[i] / n)
        values = (c @ _whole_kernel(k)).reshape(len(leaves), 1 << k, k)
        for j, i in enumerate(leaves):
            out[i] = np.zeros((1 << k, n_groups))
            out[i][:, list(tree.leaves[i][1])] = values[j]
    return out


def _leaf_counts(tree: Tree, counts: tuple[np.ndarray, np.ndarray], leaf: int) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.searchsorted(counts[0], tree.first[leaf:leaf + 2])
    return counts[0][lo:hi] - tree.first[leaf], counts[1][lo:hi]


def _explain(model, n_groups: int, keys: list[str]):
    def run(batches):
        trees, n, counts = model.value
        for batch in _batches(batches, CHUNK_ROWS):
            parts = _split(batch, BATCH_ROWS)
            phi = [np.zeros((p.n, n_groups)) for p in parts]
            for t, tree in trees.items():
                tables = _leaf_values(tree, counts[t], n, n_groups)
                for rows, out in zip(parts, phi, strict=True):
                    room = np.empty_like(out)
                    for leaf, fails in enumerate(tree.walk(rows.goes_left, rows.n)):
                        path = tree.leaves[leaf][1]
                        if tables[leaf] is not None:
                            out += np.take(tables[leaf], fails, axis=0, out=room, mode="clip")
                        elif path:
                            shown, back = np.unique(fails, return_inverse=True)
                            at, found = _leaf_counts(tree, counts[t], leaf)
                            values = np.einsum("xzk,z->xk", shapley_kernel(len(path), shown, at), found * (tree.value[leaf] / n))
                            out[:, list(path)] += values[back]
            flat = np.concatenate(phi)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, n_groups, dtype=np.int32)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], lists], [*keys, "phi"])
    return run


def forest_shapley(model, rows: DataFrame, background: DataFrame, sources: list[str], keys: list[str]) -> DataFrame:
    """(``keys``..., feature, phi, abs_phi, rank): exact Shapley values of a tree ensemble for every row of ``rows``.

    The value of a set of source features is the mean score over all rows of
    ``background`` with these features taken from the explained row, so the
    values of a row add up to its score less the mean score of the
    background. Slots of one source (``sources`` by slot) move together.
    ``rank`` is by falling |phi| within the row, ties share it.

    Both tables hold a ``features`` vector; each is read once. A row gets
    its values from its own vector alone, so equal rows get equal ones. Without
    background rows there is no value to compare with: an error.
    """
    spark = rows.sparkSession
    names = sorted(set(sources))
    group = [names.index(s) for s in sources]
    nodes = node_table(model, spark).toPandas()                               # as large as the model
    trees = {int(t): Tree(pdf, group) for t, pdf in nodes.groupby("tree")}
    n, counts = background_counts(background, trees)
    if n == 0:
        raise ValueError("no background rows")
    shared = spark.sparkContext.broadcast((trees, n, counts))
    schema = T.StructType([rows.schema[k] for k in keys]).add("phi", T.ArrayType(T.DoubleType()))
    found = rows.select(*keys, "features").mapInArrow(_explain(shared, len(names), keys), schema)
    size = F.transform("phi", lambda p: F.abs(p))
    cells = F.transform(F.array(*[F.lit(x) for x in names]), lambda name, i: F.struct(
        name.alias("feature"), F.col("phi")[i].alias("phi"), F.col("_size")[i].alias("abs_phi"),
        (F.size(F.filter("_size", lambda s: s > F.col("_size")[i])) + 1).alias("rank")))
    return found.withColumn("_size", size).select(*keys, F.inline(cells))
