"""Random forests over rows with few entries that are not zero.

``fit`` grows the forests of MLlib's ``RandomForestClassifier`` and
``RandomForestRegressor`` (same thresholds, bootstrap, slots drawn for each
node, gains, stopping rules and pruning) and hands them over as MLlib's model.
MLlib keeps a number per slot and row, and a count and a node per tree and
row. Here rows are kept by their cells as in :mod:`.boosting`, alike ones once
with their number; how often a tree draws a row follows from a hash of the row
and the tree (Poisson, as in MLlib), and the node it has reached from its
cells, so nothing is kept per tree. A level of all trees is a few jobs. Each
task sums rows and labels per node and cell and hands on the slots that the
node has drawn; the driver picks the splits.

The draws are not MLlib's, whose depend on the partitions: the forest is
another one of the same kind, the same for every layout of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .boosting import EPSILON, Layout
from .trees import Rows, _batches

FEW_CELLS = 150_000_000     # rows x slots up to which the forest is left to MLlib
BLOCK_ROWS = 1 << 18        # rows of a block
PART_ROWS = 4_000_000       # rows of a partition, where that makes more than one a core
JOB_BYTES = 1 << 27         # sums that the tasks of a job hand on
FLAT_PARTS = 64             # sums of more tasks are added up in two steps
TABLE_ROWS = 15             # Poisson numbers up to this mean come from a table
FIRST, DEEP = 6, 4          # levels of a tree in its first table, and in each further one
COUNT_BITS = 24             # rows and labels are summed at once, as one number: bits of the rows, of the labels
LABEL_BITS = 28
TIE = 1e-12                 # gains that differ by less, against the larger, are equal

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]     # cells (columns x rows), hashes, and see _weights


# ---------------------------------------------------------------- bootstrap
@lru_cache(maxsize=1)
def _poisson() -> tuple[np.ndarray, list[np.ndarray]]:
    """By mean and the first 16 bits of a random number: the Poisson number, 255 where further bits decide; and the shares up to each number."""
    shares = []
    for mean in range(TABLE_ROWS + 1):
        p, each = math.exp(-mean), []
        for k in range(80):
            each.append(p)
            p *= mean / (k + 1)
        shares.append(np.cumsum(each))
    at = np.arange(1 << 16) / (1 << 16)
    table = np.empty((TABLE_ROWS + 1, 1 << 16), np.uint8)
    for mean, upto in enumerate(shares):
        low, high = np.searchsorted(upto, at, "right"), np.searchsorted(upto, at + 1 / (1 << 16), "left")
        table[mean] = np.where(low == high, low, 255) if mean else 0
    return table.ravel(), shares


def _mixed(hashes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """64 random bits for each row of a tree, from the hashes of the rows."""
    key = np.random.default_rng([seed, tree]).integers(0, 1 << 63, 2, np.uint64)
    x = (hashes ^ key[0]) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    x += key[1]
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _drawn(bits: np.ndarray, means: np.ndarray, seed: list[int]) -> np.ndarray:
    """A Poisson number of each mean (whole numbers); ``bits`` are 32 random bits each."""
    table, shares = _poisson()
    many = means > TABLE_ROWS
    some = np.where(many, 0, means)
    out = table.take(((some.astype(np.int64) << 16) | (bits >> np.uint64(16)).astype(np.int64)))
    open_ = np.flatnonzero(out == 255)
    if len(open_):
        exact, mean = (bits[open_] + 0.5) / float(1 << 32), some[open_]
        for m in np.unique(mean):
            out[open_[mean == m]] = np.searchsorted(shares[int(m)], exact[mean == m], "right")
    at = np.flatnonzero(many)
    if not len(at):
        return out
    out = out.astype(np.int64)
    out[at] = np.random.default_rng(seed).poisson(means[at])
    return out


def _weights(block: Block, binary: bool, bootstrap: bool, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Times that a tree draws each row, and the sum of the labels. A block holds rows of label 0 and of label 1 that are
    alike, or rows and their label."""
    _, hashes, a, b = block
    if not bootstrap:
        return (a + b, b) if binary else (a, a * b)
    x = _mixed(hashes, seed, tree)
    first = int(hashes[0])
    drawn = _drawn(x >> np.uint64(32), a, [seed, tree, 0, first])
    if not binary:
        return drawn, drawn * b
    ones = _drawn(x & np.uint64(0xFFFFFFFF), b, [seed, tree, 1, first])
    return drawn.astype(np.int64) + ones, ones


# -------------------------------------------------------------------- trees
class Walk:
    """A tree as the tasks walk it. Nodes are numbered as in a heap; a table of the first levels, and one for each few
    levels below, say by cell (and node above) which nodes' splits the cell is among, as bits; ``left`` which of these
    lead to the left. Rows at a leaf go on to the left."""

    def __init__(self, depth: int, n_cells: int) -> None:
        self.n_cells = n_cells
        starts = [0, *range(FIRST, max(depth, 1), DEEP)]
        self.steps = [(s, e - s) for s, e in zip(starts, [*starts[1:], max(depth, 1)], strict=True)]        # first level, levels
        kinds = [np.uint64, *[np.uint16] * (len(starts) - 1)]
        self.hits = [np.zeros((1 << s, n_cells), k) for s, k in zip(starts, kinds, strict=True)]
        self.left = [np.zeros(1 << s, k) for s, k in zip(starts, kinds, strict=True)]

    def split(self, level: int, node: int, low: int, span: int, cells_left: bool) -> None:
        """Rows with a cell within ``span`` of ``low`` go to one side of ``node``, the others to the other side."""
        table = 0 if level < FIRST else 1 + (level - FIRST) // DEEP
        below = level - self.steps[table][0]
        top, kind = (node >> below) - (1 << self.steps[table][0]), self.hits[table].dtype.type
        bit = kind(1 << ((1 << below) | (node & ((1 << below) - 1))))
        self.hits[table][top, low:low + span + 1] |= bit
        if cells_left:
            self.left[table][top] |= bit

    def reached(self, cells: np.ndarray, levels: int) -> np.ndarray:
        """The place within its level that each row has reached after so many levels."""
        at = np.zeros(cells.shape[1], np.intp)
        for (start, most), hits, left in zip(self.steps, self.hits, self.left, strict=True):
            if start >= levels:
                break
            flat, base = hits.ravel(), at * self.n_cells if start else 0
            word = left[at] if start else np.full(len(at), left[0])
            seen = np.zeros(len(at), hits.dtype)
            for c in cells:
                seen |= flat.take(base + c if start else c)
            word ^= seen
            one = hits.dtype.type(1)
            local = np.full(len(at), one)
            n = min(levels - start, most)
            for _ in range(n):
                bit = word >> local
                bit &= one
                local <<= one
                local |= bit
            at = (at << n) + (local.astype(np.intp) - (1 << n))
        return at


@dataclass
class Grown:
    """Nodes of a tree by heap number: rows, sums of the labels and of their squares (not a number where not known),
    gain (-1 for a leaf), split; ``valid`` as MLlib has it."""

    stats: np.ndarray               # 3 x nodes
    gain: np.ndarray
    slot: np.ndarray
    border: np.ndarray              # threshold, or the category to the left
    known: np.ndarray               # whether there is such a node
    valid: np.ndarray

    @staticmethod
    def root(depth: int) -> Grown:
        n = 2 << depth
        known = np.zeros(n, bool)
        known[1] = True
        return Grown(np.zeros((3, n)), np.full(n, -1.0), np.full(n, -1), np.zeros(n), known, np.ones(n, bool))


def _places(chosen: np.ndarray, layout: Layout) -> np.ndarray:
    """Where the sums of each node's slots are in a table of nodes x cells."""
    sizes = np.diff(layout.first)[chosen]
    start = layout.first[chosen] + np.arange(len(chosen))[:, None] * layout.cells
    each, start = sizes.ravel(), start.ravel()
    return np.repeat(start - (np.cumsum(each) - each), each) + np.arange(each.sum())


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest kind."""
    whole = x.astype(np.int64) if len(x) and np.abs(x).max() < 1 << 62 else None
    if whole is None or (whole != x).any():
        return x
    most = np.abs(whole).max(initial=0)
    return whole.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _sums(trees: dict[int, tuple[Walk, np.ndarray, np.ndarray]], level: int, layout: Layout, binary: bool, whole: bool, bootstrap: bool,
          seed: int, last: bool):
    """For each tree, the sums of rows and labels at the places of its open nodes, and the nodes' rows, labels and squares."""
    n_cells = layout.cells

    def table(index: np.ndarray, cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        if 4 * size > len(index):                       # one table for all columns
            return np.bincount((cells + index).ravel(), np.broadcast_to(values, cells.shape).ravel(), size)
        out = np.zeros(size)
        for c in cells:
            out += np.bincount(index + c, values, size)
        return out

    def run(blocks: Iterator[Block]):
        blocks = list(blocks)
        out = {}
        for t, (walk, place, chosen) in trees.items():
            n_open = len(chosen)
            size = (n_open + 1) * n_cells
            total, nodes = np.zeros((2, size)), np.zeros((3, n_open + 1))
            held, rows_held, labels_held = np.zeros(size), 0.0, 0.0

            def unpack():
                nonlocal rows_held, labels_held
                labels = np.floor(held / (1 << COUNT_BITS))
                total[1] += labels
                total[0] += held - labels * (1 << COUNT_BITS)
                held[:] = 0
                rows_held = labels_held = 0.0

            for block in blocks:
                n, y = _weights(block, binary, bootstrap, seed, t)
                cells = block[0]
                if np.count_nonzero(n) < 0.8 * len(n):
                    keep = np.flatnonzero(n)
                    n, y, cells = n[keep], y[keep], cells[:, keep]
                    label = None if binary else block[3][keep]
                else:
                    label = None if binary else block[3]
                cells = cells.astype(np.intp)
                at = place[walk.reached(cells, level)]
                n, y = n.astype(float), y.astype(float)
                if level == 0 or not binary:
                    for i, w in enumerate((n, y, y if binary else y * label)):
                        nodes[i] += np.bincount(at, w, n_open + 1)
                if last:
                    continue
                index = at * n_cells
                rows, labels = n.sum(), np.abs(y).sum()
                if whole and rows < 1 << COUNT_BITS and labels < 1 << LABEL_BITS:
                    if rows_held + rows >= 1 << COUNT_BITS or labels_held + labels >= 1 << LABEL_BITS:
                        unpack()
                    held += table(index, cells, n + y * (1 << COUNT_BITS), size)
                    rows_held, labels_held = rows_held + rows, labels_held + labels
                else:
                    total[0] += table(index, cells, n, size)
                    total[1] += table(index, cells, y, size)
            if rows_held:
                unpack()
            at = _places(chosen, layout) if not last else np.empty(0, int)
            out[t] = (_narrow(total[0, at]), _narrow(total[1, at]), nodes[:, :n_open])
        yield out
    return run


def _added(a: dict, b: dict) -> dict:
    wide = lambda x: x.astype(np.int64) if x.dtype.kind == "i" else x
    return {t: tuple(wide(x) + wide(y) for x, y in zip(a[t], b[t], strict=True)) for t in a}


def _split(grown: Grown, walk: Walk, level: int, open_: np.ndarray, chosen: np.ndarray, sums, layout: Layout, classes: bool, binary: bool) -> np.ndarray:
    """Gives the open nodes their best splits among the chosen slots, and returns the nodes to go on with."""
    rows, labels, nodes = sums
    if level == 0 or not binary:
        grown.stats[:, open_] = nodes
    k, width = len(open_), len(layout.first) - 1
    total = np.zeros((2, k * layout.cells))
    at = _places(chosen, layout)
    total[0, at], total[1, at] = rows, labels
    total = total.reshape(2, k, -1)
    whole = grown.stats[:2, open_][:, :, None]
    best, place = np.full((k, width), -np.inf), np.zeros((k, width), int)

    def gains(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        some = (left[0] >= 1) & (right[0] >= 1)
        a, b = np.where(some, left[0], 1.0), np.where(some, right[0], 1.0)
        gain = a * b / (a + b) ** 2 * (left[1] / a - right[1] / b) ** 2
        return np.where(some, 2.0 * gain if classes else gain, -np.inf)

    for slot, borders in layout.borders.items():
        if len(borders):
            left = np.cumsum(total[:, :, layout.first[slot]:layout.first[slot + 1] - 1], axis=2)
            gain = gains(left, whole - left)
            place[:, slot], best[:, slot] = gain.argmax(axis=1), gain.max(axis=1)
    binaries = np.array([s for s in range(width) if s not in layout.borders], int)
    ones = total[:, :, layout.first[binaries]]
    if len(binaries):
        best[:, binaries] = gains(ones, whole - ones)
    drawn = np.zeros((k, width), bool)
    drawn[np.arange(k)[:, None], chosen] = True
    best[~drawn] = -np.inf
    top = best.max(axis=1)
    slots = (best >= np.where(np.isfinite(top), top, 0)[:, None] * (1 - TIE)).argmax(axis=1)
    after = []
    n, s, q = grown.stats[:, open_]
    pure = np.abs((q - s * s / np.maximum(n, 1)) / np.maximum(n, 1)) < EPSILON
    for i, node in enumerate(open_):
        if pure[i] and node > 1:
            continue
        if not top[i] > 0:
            grown.valid[node] = bool(np.isfinite(top[i]))
            continue
        slot = int(slots[i])
        low, both = int(layout.first[slot]), grown.stats[:2, node]
        if slot in layout.borders:
            p = int(place[i, slot])
            left = total[:, i, low:low + p + 1].sum(axis=1)
            grown.border[node], span, cells_left = layout.borders[slot][p], p, True
        else:
            left, span = total[:, i, low], 0
            other = both - left
            # the left side is that of the smaller mean, of two classes that with fewer rows of class 1
            cells_left = bool(left[1] < other[1] if classes else left[1] / left[0] < other[1] / other[0])
            left = left if cells_left else other
            grown.border[node] = float(cells_left)
        grown.gain[node], grown.slot[node] = best[i, slot], slot
        walk.split(level, int(node), low, span, cells_left)
        for child, stats in ((2 * node, left), (2 * node + 1, both - left)):
            grown.known[child] = True
            grown.stats[:2, child] = stats
            grown.stats[2, child] = stats[1] if binary else np.nan
            if not binary or 0 < stats[1] < stats[0]:
                after.append(child)
    return np.array(after, int)


def _chosen(seed: int, tree: int, level: int, nodes: int, width: int, n: int) -> np.ndarray:
    """The slots that each node draws, ascending."""
    if n >= width:
        return np.tile(np.arange(width), (nodes, 1))
    keys = np.random.default_rng([seed, tree, level, 7]).random((nodes, width))
    return np.sort(np.argpartition(keys, n, axis=1)[:, :n], axis=1)


def grow(blocks, layout: Layout, n_parts: int, n_trees: int, depth: int, n_slots: int, classes: bool, binary: bool, whole: bool, bootstrap: bool, seed: int) -> list[Grown]:
    """All trees, level by level."""
    sc, width = blocks.context, len(layout.first) - 1
    grown, walks = [Grown.root(depth) for _ in range(n_trees)], [Walk(depth, layout.cells) for _ in range(n_trees)]
    open_: list[np.ndarray] = [np.array([1]) for _ in range(n_trees)]
    mean_cells = layout.cells / width
    for level in range(depth + 1):
        last = level == depth
        left = [t for t in range(n_trees) if len(open_[t])]
        if last and binary:
            break                                       # all is known of the leaves
        while left:
            job, size = {}, 0.0
            while left and (not job or size < JOB_BYTES):
                t = left.pop(0)
                place = np.full(1 << level, len(open_[t]))
                place[open_[t] - (1 << level)] = np.arange(len(open_[t]))
                chosen = _chosen(seed, t, level, len(open_[t]), width, n_slots)
                job[t] = (walks[t], place, chosen)
                size += len(open_[t]) * (24 if last else n_slots * mean_cells * 6) * min(n_parts, FLAT_PARTS)
            shared = sc.broadcast(job)
            parts = blocks.mapPartitions(lambda x, shared=shared, level=level, last=last: _sums(shared.value, level, layout, binary, whole, bootstrap, seed, last)(x))
            sums = parts.reduce(_added) if n_parts <= FLAT_PARTS else parts.treeReduce(_added)
            shared.destroy()
            for t, (walk, _, chosen) in job.items():
                if last:
                    grown[t].stats[:, open_[t]] = sums[t][2]
                    open_[t] = np.empty(0, int)
                else:
                    open_[t] = _split(grown[t], walk, level, open_[t], chosen, sums[t], layout, classes, binary)
    return grown


# -------------------------------------------------------------------- model
def _saved(g: Grown, layout: Layout, classes: bool) -> list[tuple]:
    """The nodes as MLlib stores them, in order of the walk; two leaves of one answer (class, or number) become one."""
    n, s, q = g.stats
    with np.errstate(invalid="ignore", divide="ignore"):
        answer = (2 * s > n).astype(float) if classes else s / n
        share = s / n
        impurity = 2.0 * share * (1.0 - share) if classes else (q - s * s / n) / n
    inner = g.slot >= 0
    for i in np.flatnonzero(inner)[::-1]:               # children have larger numbers
        if not inner[2 * i] and not inner[2 * i + 1] and answer[2 * i] == answer[2 * i + 1]:
            inner[i] = False
    out: list[tuple] = []
    pending = [(1, -1, 0)]
    while pending:                                      # a node, its left subtree, its right one
        i, parent, side = pending.pop()
        at = len(out)
        if parent >= 0:
            out[parent][side] = at
        stats = [float(n[i] - s[i]), float(s[i])] if classes else [float(n[i]), float(s[i]), float(q[i])]
        if inner[i]:
            category = int(g.slot[i]) not in layout.borders
            split, gain = (int(g.slot[i]), [float(g.border[i])], 2 if category else -1), float(g.gain[i])
            pending += [(2 * i + 1, at, 7), (2 * i, at, 6)]
        else:
            split, gain = (-1, [], -1), -1.0
        out.append([at, float(answer[i]), float(impurity[i]) if g.valid[i] else -1.0, stats, int(n[i]), gain, -1, -1, split])
    return [tuple(x) for x in out]


def _kept(layout: Layout, binary: bool):
    """Rows as their cells, label (none where that is 0 or 1), number and sum of the labels; alike ones of a block as one."""
    pack = boosting._packed(layout, False)
    kind = np.dtype(layout.kind)

    def run(batches):
        for batch in pack(batches):
            for r in batch.to_pylist():
                n, y, _ = np.frombuffer(r["sums"]).reshape(3, -1)
                if binary and not np.isin(y, (0.0, 1.0)).all():
                    raise ValueError("labels of two classes are 0 and 1")
                cells = np.frombuffer(r["cells"], kind).reshape(-1, len(n)).T
                known = cells != layout.cells - 2                     # short rows of another block may be filled up to another width
                ends = np.concatenate([[0], np.cumsum(known.sum(axis=1))]) * kind.itemsize
                key = pa.Array.from_buffers(pa.large_binary(), len(cells), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(cells[known])]).cast(pa.binary())
                label, s = (np.zeros(len(n)), y) if binary else (y, np.zeros(len(n)))
                alike = pa.table([key, pa.array(label), pa.array(n), pa.array(s)], ["key", "y", "n", "s"]).group_by(["key", "y"], use_threads=False)
                yield from alike.aggregate([("n", "sum"), ("s", "sum")]).select(["key", "y", "n_sum", "s_sum"]).rename_columns(["key", "y", "n", "s"]).to_batches()
    return run


def _blocked(layout: Layout, binary: bool):
    kind = np.dtype(layout.kind)

    def run(batches):
        for batch in _batches(batches, BLOCK_ROWS):
            key = batch.column("key").cast(pa.large_binary())
            ends = np.frombuffer(key.buffers()[1], np.int64)[key.offset:key.offset + len(key) + 1] // kind.itemsize
            each = np.diff(ends)
            cells = np.full((len(key), int(each.max(initial=0))), layout.cells - 2, kind)
            cells[np.arange(cells.shape[1]) < each[:, None]] = np.frombuffer(key.buffers()[2], kind)[ends[0]:ends[-1]] if ends[-1] else []
            y, n, s = (batch.column(x).to_numpy(zero_copy_only=False) for x in "yns")
            pair = (n - s, s) if binary else (n, y)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
                cells.T.astype(layout.kept, order="C").tobytes(), batch.column("h").to_numpy(zero_copy_only=False).tobytes(),
                pair[0].tobytes(), pair[1].tobytes())], ["cells", "h", "a", "b"])
    return run


def _block(kind: type, binary: bool):
    def run(r) -> Block:
        counts = lambda x: x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if x.max(initial=0) <= np.iinfo(t).max))
        h, a, b = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["a"]), np.frombuffer(r["b"])
        return np.frombuffer(r["cells"], kind).reshape(-1, len(h)), h, counts(a), counts(b) if binary else b
    return run


def fit(est, rows: DataFrame, width: int):
    """The model of ``est`` (a forest estimator of MLlib; trees, depth, bins, seed, label, bootstrap and the slots of a node
    are taken from it, the rest as by default) on ``rows`` with a ``features`` vector of ``width`` slots, and its
    :class:`Scorer`; None where MLlib has fitted it. ``rows`` is read up to three times.

    0/1 slots are known by the attributes of the vector, as MLlib knows them. Slots with more categories, and tables of
    up to ``FEW_CELLS``, are left to MLlib."""
    from pyspark import StorageLevel
    attrs = (rows.schema["features"].metadata or {}).get("ml_attr", {}).get("attrs", {})
    classes, y = "Classifier" in type(est).__name__, F.col(est.getLabelCol())
    slots = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "onethird": math.ceil(width / 3.0)}
    slots["auto"] = width if est.getNumTrees() == 1 else slots["sqrt" if classes else "onethird"]
    about = rows.agg(F.count(F.lit(1)), F.count_if(~F.coalesce(y.isin(0.0, 1.0), F.lit(False))), F.count_if(y != F.rint(y))).first()
    n, binary, whole = about[0], not about[1], not about[2]
    if attrs.get("nominal") or n * width <= FEW_CELLS or est.getFeatureSubsetStrategy() not in slots or (classes and not binary):
        return est.fit(rows), None
    spark, depth = rows.sparkSession, est.getMaxDepth()
    layout = boosting._layout(rows, width, {a["idx"] for a in attrs.get("binary", [])}, n, est.getMaxBins(), est.getSeed())
    cores = spark.sparkContext.defaultParallelism
    n_parts = cores * max(1, -(-n // (cores * PART_ROWS)))          # alike in size, as dealt by hashes
    keyed = rows.select("features", y.alias("y")).mapInArrow(_kept(layout, binary), "key binary, y double, n double, s double")
    once = keyed.repartition(n_parts, "key", "y").groupBy("key", "y").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    once = once.withColumn("h", F.xxhash64("key", "y")).sortWithinPartitions("h", "key", "y")
    blocks = (once.mapInArrow(_blocked(layout, binary), "cells binary, h binary, a binary, b binary").rdd
              .map(_block(layout.kept, binary)).persist(StorageLevel.MEMORY_AND_DISK_DESER))
    try:
        grown = grow(blocks, layout, n_parts, est.getNumTrees(), depth, slots[est.getFeatureSubsetStrategy()], classes, binary, whole,
                     est.getBootstrap(), est.getSeed() & 0x7FFFFFFF)
    finally:
        blocks.unpersist()
    saved = [_saved(g, layout, classes) for g in grown]
    model = boosting.as_model(est, spark, width, saved, "numTrees", [1.0] * len(saved))
    return model, Scorer(saved, layout, depth, classes)


# ------------------------------------------------------------------- scores
class Scorer:
    """The score of a forest (share of class 1, or the mean) from the cells of a row, all rows of a batch at once."""

    def __init__(self, saved: list[list[tuple]], layout: Layout, depth: int, classes: bool) -> None:
        self.layout, self.depth = layout, depth
        self.walks: list[Walk] = []
        self.values: list[np.ndarray] = []
        for nodes in saved:
            deepest = self._depth(nodes)
            walk, values = Walk(deepest, layout.cells), np.zeros(1 << deepest)
            pending = [(0, 1, 0)]
            while pending:
                at, heap, level = pending.pop()
                _, answer, _, stats, _, _, left, right, (slot, border, categories) = nodes[at]
                if left < 0:
                    values[(heap << (deepest - level)) - (1 << deepest)] = stats[1] / (stats[0] + stats[1]) if classes else answer
                    continue
                low = int(layout.first[slot])
                if categories < 0:
                    walk.split(level, heap, low, int(np.searchsorted(layout.borders[slot], border[0])), True)
                else:
                    walk.split(level, heap, low, 0, border[0] == 1.0)
                pending += [(left, 2 * heap, level + 1), (right, 2 * heap + 1, level + 1)]
            self.walks.append(walk)
            self.values.append(values)

    @staticmethod
    def _depth(nodes: list[tuple]) -> int:
        level = {0: 0}
        for at, node in enumerate(nodes):
            if node[6] >= 0:
                level[node[6]] = level[node[7]] = level[at] + 1
        return max(level.values())

    def scores(self, vectors: pa.StructArray) -> np.ndarray:
        cells = boosting.cells_of(self.layout, Rows(vectors)).astype(np.intp)
        total = np.zeros(cells.shape[1])
        for walk, values in zip(self.walks, self.values, strict=True):
            depth = len(values).bit_length() - 1
            total += values[walk.reached(cells, depth)]
        return total / len(self.walks)

    def score(self, design: DataFrame) -> DataFrame:
        """Append ``score`` to a table with ``features``."""
        from pyspark.sql.functions import arrow_udf
        shared = design.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                yield pa.array(shared.value.scores(vectors), pa.float64())
        return design.withColumn("score", arrow_udf(run, "double")("features"))
