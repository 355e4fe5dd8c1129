"""Hard-negative mining with angular triangle filtering.

Every row is stored with its integer vector, its norm and its angles to some
reference directions. The angle between two rows lies between the difference
and the sum of their angles to each reference, so stored numbers alone give a
cosine interval; times the norms, with a margin for rounding, it bounds the
integer score. Rows are read tile by tile: first whole tiles, then rows are
left out where their interval does not meet the scores still wanted, and only
the rest is scored. References decide how much is left out, never the result.

Anchors are taken in blocks of bounded size; each block is one pass over the
stored rows for the positives and one for the negatives.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylane.llm.common import staged

POSITIVES = 5           # positives of an anchor, and negatives of a positive
REFERENCES = 16
SAMPLE_ROWS = 4096      # rows the reference directions are chosen from
BLOCK_BYTES = 16 << 20  # vectors of one block of anchors
TILE_ROWS, TILE_ANCHORS = 2048, 512
PART_ROWS = 1 << 18     # stored rows of a partition, about
NONE = np.iinfo(np.int64).min


def quantised(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vec: Column) -> Column:
    """Not null, and every component a finite number."""
    x = F.transform(vec, lambda x: x.cast("double"))
    fine = F.forall(x, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an integer list column, filled with zeros up to ``dims``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _norms(q: np.ndarray) -> np.ndarray:
    return np.sqrt((q.astype(float) ** 2).sum(axis=1))


def choose_references(q: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors far from each other: each next one is the row with the largest angle to those taken."""
    norm = _norms(q)
    unit = q[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.zeros((0, q.shape[1]))
    taken, near = [unit[0]], unit @ unit[0]
    while len(taken) < count and near.min() < 1 - 1e-9:
        taken.append(unit[int(near.argmin())])
        near = np.maximum(near, unit @ taken[-1])
    return np.array(taken)


def angles(q: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle of each row to each reference; 0 for zero rows, whose scores are 0 whatever the angle."""
    cos = (q @ references.T) / np.where(norm > 0, norm, 1)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def _describe(model, dims: int):
    def run(batches):
        references = model.value
        for b in batches:
            q = _matrix(b.column("q"), dims)
            norm = _norms(q)
            a = angles(q, norm, references)
            cell = a.argmin(axis=1) if a.shape[1] else np.zeros(len(q), int)
            near = a[np.arange(len(q)), cell] if a.shape[1] else np.zeros(len(q))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("q"), pa.array(norm), pa.array(list(a), pa.list_(pa.float64())),
                                              pa.array(cell.astype(np.int32)), pa.array(near)], ["vec_id", "label", "q", "norm", "angles", "cell", "near"])
    return run


def store(rows: DataFrame, references: int = REFERENCES, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, int]:
    """The rows with norm and angles, near ones together, as a staged table; and the number of components.

    The reference directions are chosen from ``sample_rows`` rows, those with
    the smallest hash of the vector.
    """
    spark = rows.sparkSession
    count, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    sample = rows.select("q").orderBy(F.xxhash64("q"), "q").limit(sample_rows).collect()
    fill = np.zeros((len(sample), dims), np.int64)
    for i, r in enumerate(sample):
        fill[i, :len(r["q"])] = r["q"]
    model = spark.sparkContext.broadcast(choose_references(fill, references))
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], rows.schema["q"]])
    schema = schema.add("norm", "double").add("angles", T.ArrayType(T.DoubleType())).add("cell", "integer").add("near", "double")
    order = ["label", "cell", "near", "vec_id"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_ROWS))
    out = rows.mapInArrow(_describe(model, dims), schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = staged(out, "vectors")
    model.destroy()
    return out, dims


def angle_interval(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest angle between each row of ``a`` (anchors x references) and each of
    ``low``, ``high`` (rows x references): rows whose angles lie between the two."""
    least = np.zeros((len(a), len(low)))
    most = np.full((len(a), len(low)), np.pi)
    for r in range(a.shape[1]):
        x, lo, hi = a[:, r, None], low[:, r], high[:, r]
        np.maximum(least, np.maximum(x - hi, lo - x), out=least)
        np.minimum(most, np.minimum(x + hi, 2 * np.pi - x - lo), out=most)
    return least, np.maximum(most, least)


def score_bounds(norm_a, least, most, small, large) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper score for angles from ``least`` to ``most`` and norms from ``small`` to ``large``, safe for rounding."""
    up, down = np.cos(least), np.cos(most)
    up *= np.where(up > 0, large, small)
    down *= np.where(down > 0, small, large)
    a = norm_a[:, None]
    margin = 1 + 1e-6 * a * large
    return a * down - margin, a * up + margin


class _Rows:
    """Rows as arrays, by ascending vec_id."""

    def __init__(self, b, dims: int) -> None:
        order = np.argsort(ids := np.asarray(b.column("vec_id").to_numpy(zero_copy_only=False)), kind="stable")
        self.ids, self.labels = ids[order], b.column("label").to_numpy(zero_copy_only=False)[order]
        self.q, self.norm = _matrix(b.column("q"), dims)[order], b.column("norm").to_numpy()[order]
        self.angles = b.column("angles").flatten().to_numpy().reshape(len(ids), -1)[order]
        self.largest = float(np.abs(self.q).max(initial=0))

    def tiles(self, size: int):
        for at in range(0, len(self.ids), size):
            yield np.arange(at, min(at + size, len(self.ids)))


def _scores(a: np.ndarray, x: np.ndarray, wanted: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products of the pairs wanted, NONE elsewhere. ``whole``: doubles hold every sum exactly."""
    kind = np.float64 if whole else np.int64
    if wanted.mean() > 1 / 16:
        s = (a.astype(kind) @ x.astype(kind).T).astype(np.int64)
        s[~wanted] = NONE
        return s
    s = np.full(wanted.shape, NONE)
    i, j = np.nonzero(wanted)
    for at in range(0, len(i), 1 << 14):
        k = slice(at, at + (1 << 14))
        s[i[k], j[k]] = np.einsum("ij,ij->i", a[i[k]], x[j[k]])
    return s


def _first(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first entries of each key: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_key, sorted_key)
    return order[rank < k]


class _Top:
    """The k best rows of each key so far, and the score a row needs."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.k, self.least = k, least.copy()
        self.key, self.score, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        """``s``: keys x rows, NONE where a pair does not count."""
        need = np.maximum(self.least[keys], NONE + 1)
        if s.shape[1] > self.k:
            need = np.maximum(need, np.partition(s, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(s >= need[:, None])
        if not len(i):
            return
        key, score, found = np.concatenate([self.key, keys[i]]), np.concatenate([self.score, s[i, j]]), np.concatenate([self.ids, ids[j]])
        best = _first(key, score, found, self.k)
        self.key, self.score, self.ids = key[best], score[best], found[best]
        full = np.flatnonzero(np.bincount(self.key, minlength=len(self.least)) == self.k)
        worst = np.full(len(self.least), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.key, self.score)
        self.least[full] = np.maximum(self.least[full], worst[full])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.key), pa.array(self.ids), pa.array(self.score)], ["slot", "vec_id", "score"])


def _overlap(anchors: _Rows, some: np.ndarray, rows: _Rows, tile: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Anchors, rows and pairs whose score bounds meet low..high of the anchor: whole tile first, then row by row."""
    a = rows.angles[tile]
    least, most = angle_interval(anchors.angles[some], a.min(axis=0)[None], a.max(axis=0)[None])
    down, up = score_bounds(anchors.norm[some], least, most, rows.norm[tile].min(), rows.norm[tile].max())
    some = some[(up[:, 0] >= low[some]) & (down[:, 0] <= high[some])]
    least, most = angle_interval(anchors.angles[some], a, a)
    down, up = score_bounds(anchors.norm[some], least, most, rows.norm[tile], rows.norm[tile])
    pairs = (up >= low[some, None]) & (down <= high[some, None])
    return some, pairs


def _exact(anchors: _Rows, rows: _Rows, dims: int) -> bool:
    return anchors.largest * rows.largest * max(1, dims) < 2 ** 53


def _find_positives(model, dims: int, k: int):
    """Slots: anchors of the block."""
    def run(batches):
        anchors = model.value
        top = _Top(np.full(len(anchors.ids), NONE), k)
        open_end = np.full(len(anchors.ids), np.inf)
        for b in batches:
            rows = _Rows(b, dims)
            for label in np.unique(rows.labels):
                own, same = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
                for i in range(0, len(own), TILE_ANCHORS):
                    for j in range(0, len(same), TILE_ROWS):
                        tile = same[j:j + TILE_ROWS]
                        low = np.where(top.least == NONE, -np.inf, top.least)
                        some, pairs = _overlap(anchors, own[i:i + TILE_ANCHORS], rows, tile, low, open_end)
                        pairs &= anchors.ids[some, None] != rows.ids[tile]
                        if pairs.any():
                            top.add(some, _scores(anchors.q[some], rows.q[tile], pairs, _exact(anchors, rows, dims)), rows.ids[tile])
        yield top.batch()
    return run


def _find_negatives(model, dims: int, k: int):
    """Slots: anchor x k + place of the positive."""
    def run(batches):
        anchors, high = model.value                             # high: anchors x k, NONE where there is no positive
        top = _Top(np.where(high == NONE, np.iinfo(np.int64).max, -((-4 * high) // 5)).ravel(), k)     # 80 p <= 100 s: s >= 4 p / 5
        most = high.max(axis=1, initial=NONE).astype(float)
        for b in batches:
            rows = _Rows(b, dims)
            for tile in rows.tiles(TILE_ROWS):
                for i in range(0, len(anchors.ids), TILE_ANCHORS):
                    some = np.arange(i, min(i + TILE_ANCHORS, len(anchors.ids)))
                    low = top.least.reshape(-1, k).min(axis=1).astype(float)
                    some, pairs = _overlap(anchors, some, rows, tile, low, most)
                    pairs &= anchors.labels[some, None] != rows.labels[tile]
                    if pairs.any():
                        s = _scores(anchors.q[some], rows.q[tile], pairs, _exact(anchors, rows, dims))
                        for p in range(k):
                            top.add(some * k + p, np.where(s <= high[some, p, None], s, NONE), rows.ids[tile])
        yield top.batch()
    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mine_block(spark: SparkSession, anchors: _Rows, stored: DataFrame, dims: int, k: int) -> DataFrame:
    rows = stored.select("vec_id", "label", "q", "norm", "angles")
    found = T.StructType().add("slot", "long").add("vec_id", "long").add("score", "long")
    model = spark.sparkContext.broadcast(anchors)
    positives = _merged(rows.mapInArrow(_find_positives(model, dims, k), found), k).toPandas()      # k rows an anchor of the block
    model.destroy()
    high = np.full((len(anchors.ids), k), NONE)
    high[positives["slot"].to_numpy(), positives["rank"].to_numpy() - 1] = positives["score"].to_numpy()
    model = spark.sparkContext.broadcast((anchors, high))
    pairs = pd.DataFrame({"slot": positives["slot"] * k + positives["rank"] - 1, "anchor_id": anchors.ids[positives["slot"].to_numpy()],
                          "positive_id": positives["vec_id"], "positive_score": positives["score"]})
    names = spark.createDataFrame(pairs, "slot long, anchor_id long, positive_id long, positive_score long")
    negatives = _merged(rows.mapInArrow(_find_negatives(model, dims, k), found), k)
    out = negatives.join(F.broadcast(names), "slot")        # names: k rows an anchor of the block
    out = out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = staged(out, "negatives")
    model.destroy()
    return out


def mine(vectors: DataFrame, is_anchor: Column, k: int = POSITIVES, references: int = REFERENCES, id_col: str = "vec_id",
         vec_col: str = "embedding", label_col: str = "label", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``vec_id``.

    * rows with a null id, label or vector, or a null or non-finite component take no part;
    * of rows with one id the one with the smallest label and integer vector counts;
    * shorter vectors count as filled up with zeros, so an empty one scores 0;
    * equal scores come by smaller id; an anchor without a positive, and a positive without a
      negative in its window, has no rows; scores must fit 64 bits;
    * an empty table, or one without anchors, gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    rows = rows.select("vec_id", "label", quantised(F.col("vec")).alias("q")).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v"))
    rows = staged(rows.select("vec_id", "v.label", "v.q"), "quantised")
    stored, dims = store(rows, references)
    wanted = stored.where(is_anchor)
    blocks = max(1, -(-wanted.count() * 8 * max(dims, 1) // block_bytes))
    out = []
    for i in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).select("vec_id", "label", "q", "norm", "angles").toArrow()
        if block.num_rows:
            out.append(_mine_block(spark, _Rows(block.combine_chunks().to_batches()[0], dims), stored, dims, k))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionAll, out)


def shifted_labels(label: str = "label") -> Column:
    """The labels the registered query mines with: (label + 1) % 10 where the id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS other_id, a.label = x.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, x.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows a JOIN rows x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM pairs WHERE same) WHERE place <= 5),
negatives AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS place
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id
  WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE place <= 5
"""
