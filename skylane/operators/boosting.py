"""Gradient-boosted trees over rows with few entries that are not zero.

``fit`` grows the trees of MLlib's ``GBTClassifier`` and ``GBTRegressor`` (same
thresholds, losses, splits and stopping rules) and hands them over as MLlib's
model. MLlib visits every slot of every row at every level, a one-hot level
that the row does not have among them, and keeps a number per slot and row.
Here a row is kept as its *cells*: the bin of each number, and the 0/1 slots
that are 1. No tree can tell rows of the same cells apart, so they are kept
once, with their number, the sum of their labels and of the squares; what the
next tree is fitted to follows from these. A level of a tree is one job: each
task sums rows, answers and squared answers per node and cell; where a 0/1 slot
is 0 is the node's total less the slot's sums. These sums, as large as the
model's width, reach the driver, which picks the splits. The predictions so far
are kept with the rows. Every ``ANEW`` rounds they are made anew from all trees,
so that a lost executor replays a bounded number of rounds and nothing is written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder
from .trees import Rows, _batches

FEW_CELLS = 100_000_000     # rows x slots up to which MLlib's own pass over every slot is quicker than a Python job a level
BLOCK_ROWS = 1 << 16        # rows of a block
PART_ROWS = 4_000_000       # rows of a partition, where that makes more than one a core
ANEW = 25                   # rounds after which the predictions are made anew
FLAT_PARTS = 64             # sums of more tasks are added up in two steps
EPSILON = float(np.finfo(float).eps)
TIE = 1e-13                 # gains that differ by less, against the mean square of the answers, are equal

Block = tuple[np.ndarray, np.ndarray, np.ndarray]           # cells (columns x rows), sums of the labels (see _block), prediction so far


@dataclass
class Layout:
    """Where the sums of a slot are: ``borders`` of a number's bins, by slot, and the first cell of every slot.

    A number has a cell per bin, a 0/1 slot one cell. Last come a cell that fills up short rows and one for all rows."""

    borders: dict[int, np.ndarray]
    first: np.ndarray

    @property
    def cells(self) -> int:
        return int(self.first[-1]) + 2

    @property
    def kind(self) -> type:
        return np.uint16 if self.cells < 1 << 16 else np.uint32

    @property
    def kept(self) -> type:
        """The kind that blocks are kept in: every job reads them."""
        return np.uint8 if self.cells < 1 << 8 else self.kind


@dataclass
class Grown:
    """A tree by heap number (root 1, children 2i and 2i + 1). Bit i of ``hits[0]``, by cell, says that the cell is among
    those of node i's split; bit i of ``left[0]`` that these go left. Word w holds nodes 64w and on. ``value`` is the
    node's answer; rows at a leaf go on to the left, where the answer is the same."""

    hits: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @staticmethod
    def root(depth: int, n_cells: int) -> Grown:
        words = max(1, (1 << depth) >> 6)
        return Grown(np.zeros((words, n_cells), np.uint64), np.zeros(words, np.uint64), np.zeros(2 << depth))

    def split(self, node: int, low: int, span: int, cells_left: bool) -> None:
        """Rows with a cell within ``span`` of ``low`` go to one side of ``node``, the others to the other side."""
        word, bit = node >> 6, np.uint64(1 << (node & 63))
        self.hits[word, low:low + span + 1] |= bit
        if cells_left:
            self.left[word] |= bit

    def walk(self, cells: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has reached after so many levels."""
        at = np.ones(cells.shape[1], np.uint64)
        for level in range(levels):
            if level == 0 or level >= 6:                # the first six levels are in one word
                word = (at >> 6).astype(np.intp) if level else 0
                right = np.zeros(len(at), np.uint64)
                for c in cells:
                    right |= self.hits[word, c] if level else self.hits[0].take(c)
                right ^= self.left[word]
            at = 2 * at + ((right >> (at & 63)) & 1)
        return at.astype(np.intp)


@dataclass
class Node:
    stats: np.ndarray               # rows, sum of answers, of squared answers
    impurity: float
    gain: float = -1.0
    split: tuple[int, list[float], int] = (-1, [], -1)          # slot, threshold or categories to the left, number of categories
    valid: bool = True

    @property
    def answer(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0


# ------------------------------------------------------------------- cells
def thresholds(values: np.ndarray, expected: float, n_splits: int) -> np.ndarray:
    """MLlib's borders between the bins of a number, from its values that are not zero among a sample of ``expected`` rows."""
    if not len(values):
        return np.empty(0)
    seen, counts = np.unique(values, return_counts=True)
    weights = counts.astype(float)
    zeros = expected - weights.sum()
    if zeros > EPSILON * len(values) * 100:
        at = np.searchsorted(seen, 0.0)
        seen, weights = np.insert(seen, at, 0.0), np.insert(weights, at, zeros)
    middle = (seen[:-1] + seen[1:]) / 2.0
    if len(middle) <= n_splits:
        return middle
    stride = expected / (n_splits + 1)
    found, target, below = [], stride, weights[0]
    for i in range(1, len(seen)):
        now = below + weights[i]
        if abs(below - target) < abs(now - target):
            found.append(middle[i - 1])
            target += stride
        below = now
    return np.array(found)


def _sampled(rows: DataFrame, n: int, max_bins: int, seed: int) -> tuple[DataFrame, float]:
    """The rows that MLlib takes thresholds from, and their expected number: all, or about 10,000 (or the square of the bins)."""
    enough = max(max_bins * max_bins, 10_000)
    if enough >= n:
        return rows, float(n)
    spark, fraction = rows.sparkSession, enough / n
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    some = rows._jdf.toJavaRDD().sample(False, fraction, draw)              # the same rows as in MLlib
    return DataFrame(spark._jsparkSession.createDataFrame(some, rows._jdf.schema()), spark), fraction * n


def _layout(rows: DataFrame, width: int, binary: set[int], n: int, max_bins: int, seed: int) -> Layout:
    borders: dict[int, np.ndarray] = {}
    if len(binary) < width:
        some, expected = _sampled(rows, n, max_bins, seed)
        found = some.select("features").toArrow().column("features").combine_chunks()
        found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
        sample = Rows(found) if len(found) else None
        for slot in sorted(set(range(width)) - binary):
            known = sample is not None and slot + 1 < len(sample.cuts)
            values = sample.flat[sample.cuts[slot]:sample.cuts[slot + 1]] if known else np.empty(0)
            borders[slot] = thresholds(values[values != 0], expected, min(max_bins, n) - 1)
    sizes = [len(borders[s]) + 1 if s in borders else 1 for s in range(width)]
    return Layout(borders, np.concatenate([[0], np.cumsum(sizes)]))


def cells_of(layout: Layout, rows: Rows) -> np.ndarray:
    """The cells of rows, column by column; short rows are filled up."""
    columns, numbers = [], np.array(sorted(layout.borders), int)
    for slot in numbers:
        x = np.zeros(rows.n)
        if slot + 1 < len(rows.cuts):
            at = slice(rows.cuts[slot], rows.cuts[slot + 1])
            x[rows.row[at]] = rows.flat[at]
        columns.append(layout.first[slot] + np.searchsorted(layout.borders[slot], x))
    slot = np.repeat(np.arange(len(rows.cuts) - 1), np.diff(rows.cuts))
    ones = (rows.flat != 0) & ~np.isin(slot, numbers)
    if (rows.flat[ones] != 1).any():
        raise ValueError("0/1 slots hold other values")
    order = np.argsort(rows.row[ones], kind="stable")
    row, slot = rows.row[ones][order], slot[ones][order]
    each = np.bincount(row, minlength=rows.n)
    rest = np.full((int(each.max(initial=0)), rows.n), layout.cells - 2)
    rest[np.arange(len(row)) - (np.cumsum(each) - each)[row], row] = layout.first[slot]
    return np.vstack([*[c[None] for c in columns], rest]).astype(layout.kind)


def _packed(layout: Layout, classes: bool):
    """Blocks of rows: their cells, column by column, and for each row 1, the label (-1 or 1 of two classes) and its square."""
    def run(batches):
        for batch in _batches(batches, BLOCK_ROWS):
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            rows = Rows(batch.column("features"))
            if not np.isfinite(y).all() or not np.isfinite(rows.flat).all() or batch.column("features").null_count:
                raise ValueError("labels and features must be numbers")
            if classes and not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("labels of two classes are 0 and 1")
            y = 2.0 * y - 1.0 if classes else y
            yield _record(cells_of(layout, rows), np.array([np.ones(rows.n), y, y * y]))
    return run


def _record(cells: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (cells, sums)], ["cells", "sums"])


def _keyed(layout: Layout):
    """The rows of blocks, alike ones of a block as one: their cells as ``key``, rows, sum of the labels and of the squares."""
    names, kind = ["key", "n", "s", "q"], np.dtype(layout.kind)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sums = np.frombuffer(r["sums"]).reshape(3, -1)
                cells = np.frombuffer(r["cells"], kind).reshape(-1, sums.shape[1]).T
                known = cells != layout.cells - 2                     # short rows of another block may be filled up to another width
                ends = np.concatenate([[0], np.cumsum(known.sum(axis=1))]) * kind.itemsize
                key = pa.Array.from_buffers(pa.large_binary(), len(cells), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(cells[known])])
                alike = pa.table([key.cast(pa.binary()), *[pa.array(x) for x in sums]], names).group_by("key", use_threads=False)
                yield from alike.aggregate([(x, "sum") for x in "nsq"]).select(["key", "n_sum", "s_sum", "q_sum"]).rename_columns(names).to_batches()
    return run


def _blocked(layout: Layout):
    """Blocks of the rows that :func:`_keyed` gives."""
    kind = np.dtype(layout.kind)

    def run(batches):
        for batch in _batches(batches, BLOCK_ROWS):
            key = batch.column("key").cast(pa.large_binary())
            ends = np.frombuffer(key.buffers()[1], np.int64)[key.offset:key.offset + len(key) + 1] // kind.itemsize
            each = np.diff(ends)
            cells = np.full((len(key), int(each.max(initial=0))), layout.cells - 2, kind)
            cells[np.arange(cells.shape[1]) < each[:, None]] = np.frombuffer(key.buffers()[2], kind)[ends[0]:ends[-1]] if ends[-1] else []
            yield _record(cells.T.astype(layout.kept, order="C"), np.array([batch.column(x).to_numpy(zero_copy_only=False) for x in "nsq"]))
    return run


def _block(kind: type, classes: bool):
    """A block from its record. The sums are a row each: rows, sum of the labels, of their squares (left out for two classes, always 1)."""
    def run(r) -> Block:
        sums = np.frombuffer(r["sums"]).reshape(3, -1)
        cells = np.frombuffer(r["cells"], kind).reshape(-1, sums.shape[1])
        if classes:
            most = sums[0].max(initial=0)
            sums = sums[:2].astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), float))
        return cells, sums.T, np.zeros(len(sums.T))
    return run


def _alike_once(rows: DataFrame, layout: Layout, classes: bool, n_parts: int) -> DataFrame:
    """Blocks of the distinct rows. Partitions and their order depend on the rows only; the order is one by hashes, as
    neighbours in the same cell would slow the sums down."""
    keyed = (rows.mapInArrow(_packed(layout, classes), "cells binary, sums binary")
             .mapInArrow(_keyed(layout), "key binary, n double, s double, q double"))
    once = keyed.repartition(n_parts, "key").groupBy("key").agg(*[F.sum(x).alias(x) for x in "nsq"])
    return once.sortWithinPartitions(F.xxhash64("key"), "key").mapInArrow(_blocked(layout), "cells binary, sums binary")


# ----------------------------------------------------------------- a level
def _moved(trees: list[tuple[Grown, float]], depth: int):
    """A block with the answers of the trees added to its predictions."""
    def run(block: Block) -> Block:
        cells, sums, margin = block
        for tree, weight in trees:
            margin = margin + tree.value[tree.walk(cells, depth)] * weight
        return cells, sums, margin
    return run


def _answers(sums: np.ndarray, margin: np.ndarray, classes: bool, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sum and squared sum of what the next tree is fitted to: the label, then the loss's negative gradient."""
    n, s = sums[:, 0].astype(float), sums[:, 1].astype(float)
    q = n if classes else sums[:, 2]
    if first:
        return n, s, q
    if not classes:
        rest = s - n * margin
        return n, 2.0 * rest, 4.0 * (np.maximum(q - s * s / n, 0.0) + rest * rest / n)
    with np.errstate(over="ignore"):
        one, zero = 4.0 / (1.0 + np.exp(2.0 * margin)), -4.0 / (1.0 + np.exp(-2.0 * margin))
    ones, zeros = (n + s) / 2.0 * one, (n - s) / 2.0 * zero
    return n, ones + zeros, ones * one + zeros * zero


def _sums(tree: Grown, level: int, place: np.ndarray, nodes: int, n_cells: int, classes: bool, first: bool):
    """Rows, answers and squared answers by node of the level and cell; rows at other nodes are left out."""
    def run(blocks: Iterator[Block]):
        total = np.zeros((3, (nodes + 1) * n_cells))
        for cells, labels, margin in blocks:
            weights = _answers(labels, margin, classes, first)
            start = place[tree.walk(cells, level)] * n_cells
            for c in (*cells, n_cells - 1):
                at = start + c
                for sums, w in zip(total, weights, strict=True):
                    found = np.bincount(at, w)
                    sums[:len(found)] += found
        yield total.reshape(3, nodes + 1, n_cells)[:, :nodes]
    return run


def _impurity(stats: np.ndarray) -> np.ndarray:
    n = np.where(stats[0] > 0, stats[0], 1.0)
    return np.where(stats[0] > 0, (stats[2] - stats[1] * stats[1] / n) / n, 0.0)


def _gains(left: np.ndarray, right: np.ndarray, impurity: np.ndarray) -> np.ndarray:
    """Fall of the variance for sides (3 x nodes x splits); -inf where a side is empty or nothing is gained."""
    n = np.maximum(left[0] + right[0], 1.0)
    gain = impurity[:, None] - left[0] / n * _impurity(left) - right[0] / n * _impurity(right)
    return np.where((left[0] < 1) | (right[0] < 1) | (gain < 0), -np.inf, gain)


def _split(total: np.ndarray, layout: Layout, nodes: list[Node]) -> list[tuple[np.ndarray, np.ndarray, int, int, bool] | None]:
    """For each node the best split (left and right sums, first cell, further cells, whether these cells go left), or None.

    The first slot and the first border of equal gains win, as in MLlib; slots that part the rows alike differ by
    rounding here, as sums of zeros are differences. Sets gain and split of the nodes."""
    k, width = len(nodes), len(layout.first) - 1
    impurity = np.array([n.impurity for n in nodes])
    best, place = np.full((k, width), -np.inf), np.zeros((k, width), int)
    for slot, borders in layout.borders.items():
        if len(borders):
            upto = np.cumsum(total[:, :, layout.first[slot]:layout.first[slot + 1]], axis=2)
            gain = _gains(upto[:, :, :-1], upto[:, :, -1:] - upto[:, :, :-1], impurity)
            place[:, slot] = gain.argmax(axis=1)
            best[:, slot] = gain.max(axis=1)
    binary = np.array([s for s in range(width) if s not in layout.borders], int)
    ones = total[:, :, layout.first[binary]]
    zeros = total[:, :, -1:] - ones
    mean = lambda x: np.where(x[0] > 0, x[1] / np.maximum(x[0], 1.0), np.inf)
    one_left = mean(ones) < mean(zeros)                                         # the side of the smaller mean is the left one
    if len(binary):
        best[:, binary] = _gains(np.where(one_left, ones, zeros), np.where(one_left, zeros, ones), impurity)
    out: list = []
    for i, node in enumerate(nodes):
        top = best[i].max()
        slot = int((best[i] >= top - TIE * node.stats[2] / node.stats[0]).argmax()) if top > 0 else int(best[i].argmax())
        if not best[i, slot] > 0:
            node.valid = bool(np.isfinite(best[i, slot]))
            out.append(None)
            continue
        node.gain, at = float(best[i, slot]), int(layout.first[slot])
        if slot in layout.borders:
            upto = np.cumsum(total[:, i, at:layout.first[slot + 1]], axis=1)
            p = int(place[i, slot])
            node.split = (slot, [float(layout.borders[slot][p])], -1)
            out.append((upto[:, p], upto[:, -1] - upto[:, p], at, p, True))
        else:
            b = int(np.searchsorted(binary, slot))
            one = bool(one_left[i, b])
            node.split = (slot, [float(one)], 2)
            sides = (ones[:, i, b], zeros[:, i, b])
            out.append((*(sides if one else sides[::-1]), at, 0, one))
    return out


def _grow(blocks, layout: Layout, depth: int, classes: bool, first: bool, n_parts: int) -> tuple[Grown, dict[int, Node]]:
    """A tree, level by level: the tree as the tasks walk it, and its nodes by heap number."""
    tree = Grown.root(depth, layout.cells)
    nodes: dict[int, Node] = {}
    open_, level = [1], 0
    while open_ and level < depth:
        place = np.full(2 << depth, len(open_))
        place[open_] = np.arange(len(open_))
        parts = blocks.mapPartitions(_sums(tree, level, place, len(open_), layout.cells, classes, first))
        total = parts.reduce(add) if n_parts <= FLAT_PARTS else parts.treeReduce(add)
        if not nodes:
            nodes[1] = Node(total[:, 0, -1], float(_impurity(total[:, 0, -1])))
            tree.value[1] = nodes[1].answer
        after: list[int] = []
        for i, found in zip(open_, _split(total, layout, [nodes[i] for i in open_]), strict=True):
            if found is None:
                continue
            left, right, low, span, cells_left = found
            tree.split(i, low, span, cells_left)
            for child, stats in ((2 * i, left), (2 * i + 1, right)):
                nodes[child] = Node(stats, float(_impurity(stats)))
                tree.value[child] = nodes[child].answer
                if abs(nodes[child].impurity) >= EPSILON:
                    after.append(child)
        open_, level = after, level + 1
    for i in range(1, 1 << depth):
        if 2 * i not in nodes:
            tree.value[2 * i] = tree.value[2 * i + 1] = tree.value[i]
    return tree, nodes


# ------------------------------------------------------------------- model
def _saved(nodes: dict[int, Node]) -> list[tuple]:
    """The nodes as MLlib stores them, in order of the walk; two leaves with one answer become one."""
    def pruned(i: int) -> bool:
        """Whether node ``i`` is a leaf of the final tree."""
        if nodes[i].split[0] < 0:
            return True
        if pruned(2 * i) & pruned(2 * i + 1) and nodes[2 * i].answer == nodes[2 * i + 1].answer:
            nodes[i].split, nodes[i].gain = (-1, [], -1), -1.0
            return True
        return False

    pruned(1)
    out: list[tuple] = []

    def walk(i: int) -> int:
        n, at = nodes[i], len(out)
        out.append(())
        left, right = (walk(2 * i), walk(2 * i + 1)) if n.split[0] >= 0 else (-1, -1)
        out[at] = (at, n.answer, n.impurity if n.valid else -1.0, [float(x) for x in n.stats], int(n.stats[0]), n.gain, left, right, n.split)
        return at

    walk(1)
    return out


def as_model(est, spark, width: int, saved: list[list[tuple]], param: str, weights: list[float]):
    """The trees as MLlib's model: a model of one tree over two rows is stored, its trees are replaced, and it is read again.
    ``param`` is the parameter that holds the number of trees."""
    from pyspark.ml.linalg import Vectors
    two = spark.createDataFrame([(Vectors.sparse(width, [0], [float(y)]), float(y)) for y in (0, 1)], ["features", est.getLabelCol()])
    small = est.copy({est.getParam(param): 1}).fit(two)
    old, new = new_folder(spark, "trees"), new_folder(spark, "trees")
    small.write().save(old)
    about = json.loads(spark.read.text(f"{old}/metadata").first()[0])
    about["paramMap"][param], about["numTrees"] = est.getOrDefault(param), len(saved)
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{new}/metadata")
    trees = spark.read.parquet(f"{old}/treesMetadata")
    like = trees.first()[1]
    spark.createDataFrame([(t, like, w) for t, w in enumerate(weights)], trees.schema).coalesce(1).write.parquet(f"{new}/treesMetadata")
    rows = [(t, n) for t, nodes in enumerate(saved) for n in nodes]                      # as large as the model
    spark.createDataFrame(rows, spark.read.parquet(f"{old}/data").schema, verifySchema=False).coalesce(1).write.parquet(f"{new}/data")
    return type(small).load(new)


def fit(est, rows: DataFrame, width: int):
    """The model of ``est`` (a boosting estimator of MLlib; rounds, step, depth, bins, seed and label are taken from it,
    the rest as by default) on ``rows`` with a ``features`` vector of ``width`` slots. ``rows`` is read up to three times.

    0/1 slots are known by the attributes of the vector, as MLlib knows them. Slots with more categories, and tables of
    up to ``FEW_CELLS``, are left to MLlib: the trees are the same, but that rounding may choose between equal gains."""
    from pyspark import StorageLevel
    attrs = (rows.schema["features"].metadata or {}).get("ml_attr", {}).get("attrs", {})
    n = rows.count()
    if attrs.get("nominal") or n * width <= FEW_CELLS:
        return est.fit(rows)
    spark, classes = rows.sparkSession, "Classifier" in type(est).__name__
    depth = est.getMaxDepth()
    layout = _layout(rows, width, {a["idx"] for a in attrs.get("binary", [])}, n, est.getMaxBins(), est.getSeed())
    cores = spark.sparkContext.defaultParallelism
    n_parts = cores * max(1, -(-n // (cores * PART_ROWS)))          # alike in size, as dealt by hashes
    once = _alike_once(rows.select("features", F.col(est.getLabelCol()).alias("y")), layout, classes, n_parts)
    keep = StorageLevel.MEMORY_AND_DISK_DESER          # bytes as they are: the other level packs them, which every job has to undo
    base = once.rdd.map(_block(layout.kept, classes)).persist(keep)
    state, trees, grown = base, [], []
    try:
        for r in range(est.getMaxIter()):
            before = state
            if r:
                anew = r % ANEW == 0
                state = (base if anew else before).map(_moved(trees if anew else trees[-1:], depth)).persist(keep)
            tree, nodes = _grow(state, layout, depth, classes, r == 0, n_parts)
            if before is not base and before is not state:
                before.unpersist()
            trees = [*trees, (tree, 1.0 if r == 0 else est.getStepSize())]
            grown.append(nodes)
    finally:
        state.unpersist()
        base.unpersist()
    weights = [1.0 if t == 0 else float(est.getStepSize()) for t in range(len(grown))]
    return as_model(est, spark, width, [_saved(nodes) for nodes in grown], "maxIter", weights)
