"""Quality scores by Bradley-Terry pairwise ranking.

From labelled documents, preference pairs are formed (one good, one bad), and
weights are learned by logistic loss on the difference of their features, so
that the better document of a pair gets the higher score. The cut between bad
and good is a quantile of the scores: the share of bad labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.llm.common import staged
from skylane.operators.prefix import prefix_sums

PAIRS_PER_DOC = 4
PASS_SCORE = 0.7        # score at the cut
_KINDS = 16             # kinds of characters; the features count their bigrams
_OTHERS = 9             # measures beside the bigrams
# Kinds of ASCII signs; letters, digits, spaces and the rest are told apart in _kinds
_SIGNS = {7: ".", 8: ",;:", 9: "!?", 10: "|", 11: "()[]{}<>", 12: "\"'`", 13: "-_/\\", 14: "#$%&*+=@^~"}
_table: list = []


def _kinds() -> np.ndarray:
    """Kind of each code point: 1 lower, 2 upper, 3 other letter, 4 digit, 5 line end, 6 space, 7-14 signs, 15 other, 0 text end."""
    if not _table:
        kinds = np.full(0x110000, 15, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                kinds[i] = 1 if c.islower() else 2 if c.isupper() else 3
            elif c.isdigit():
                kinds[i] = 4
            elif c.isspace():
                kinds[i] = 5 if c in "\n\r" else 6
        for kind, signs in _SIGNS.items():
            kinds[[ord(c) for c in signs]] = kind
        _table.append(kinds)
    return _table[0]


def _spread(items: list[str]) -> tuple[float, float]:
    """Share of distinct items, and share of the most frequent one."""
    if not items:
        return 0.0, 0.0
    counts: dict[str, int] = {}
    for x in items:
        counts[x] = counts.get(x, 0) + 1
    return len(counts) / len(items), max(counts.values()) / len(items)


def _measures(text: str | None) -> tuple[np.ndarray, list[float]]:
    """Counts of the bigrams of character kinds, then size, word and line measures; of the whole text."""
    text = text or ""
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    kinds = np.concatenate(([0], kinds, [0])).astype(np.int64)
    bigrams = np.bincount(kinds[:-1] * _KINDS + kinds[1:], minlength=_KINDS * _KINDS)
    words, lines = text.lower().split(), [x for x in text.split("\n") if x.strip()]
    distinct, most = _spread(words)
    distinct_lines, most_line = _spread(lines)
    letters = sum(map(len, words)) / max(1, len(words))
    return bigrams, [math.log1p(len(words)) / 10, 0.0 if words else 1.0, distinct, most, distinct * math.log1p(len(words)) / 10, distinct_lines, most_line,
                     min(letters, 40.0) / 10, min(len(words) / max(1, len(lines)), 200.0) / 100]


def features(text: str | None) -> np.ndarray:
    """Shares (square roots) of the bigrams of character kinds, then the other measures."""
    return unpacked(packed(text))


def packed(text: str | None) -> bytes:
    """The measures of a text in some hundred bytes: the others, the bigrams' places and their counts."""
    bigrams, extra = _measures(text)
    at = np.flatnonzero(bigrams)
    return np.array(extra).tobytes() + at.astype(np.uint8).tobytes() + bigrams[at].astype(np.int64).tobytes()


def unpacked(p: bytes) -> np.ndarray:
    n = (len(p) - 8 * _OTHERS) // 9
    at, counts = np.frombuffer(p, np.uint8, n, 8 * _OTHERS), np.frombuffer(p, np.int64, n, 8 * _OTHERS + n)
    bigrams = np.zeros(_KINDS * _KINDS)
    bigrams[at] = counts
    return np.concatenate([np.sqrt(bigrams / bigrams.sum()), np.frombuffer(p, np.float64, _OTHERS)])


def _described(batches):
    for b in batches:
        cols = [c for c in b.schema.names if c != "text"]
        x = [packed(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(x, pa.binary())], [*cols, "x"])


@dataclass
class Model:
    """Weights, and the raw score of the cut. Without weights every text scores 0.5."""

    weights: np.ndarray | None
    cut: float = 0.0

    def score(self, x: np.ndarray) -> float:
        if self.weights is None:
            return 0.5
        z = float(x @ self.weights) - self.cut + math.log(PASS_SCORE / (1 - PASS_SCORE))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(id_col: str = "doc_id"):
    """True for the rows that nothing is learned from (and for null ids)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def _paired(sample: DataFrame, per_doc: int) -> DataFrame:
    """``id, g, b``: the features of a good and a bad document of each pair."""
    n = {r["quality"]: r["count"] for r in sample.groupBy("quality").count().collect()}
    draws = sample.sparkSession.range(per_doc * max(n.values())).select(
        F.col("id"), (F.col("id") % n[1]).alias("good"), ((F.col("id") + F.floor(F.col("id") / max(n.values())) * 7919) % n[0]).alias("bad"))
    good = sample.where("quality = 1").select(F.col("place").alias("good"), F.col("x").alias("g"))
    bad = sample.where("quality = 0").select(F.col("place").alias("bad"), F.col("x").alias("b"))
    return draws.hint("merge").join(good, "good").hint("merge").join(bad, "bad").select("id", "g", "b")


def preference_pairs(sample: DataFrame, per_doc: int = PAIRS_PER_DOC) -> DataFrame:
    """``label, x``: differences of the features of a good and a bad document, every second one turned round.

    ``sample`` has quality 0/1, place from 0 in its label, and x (an array, or packed); each document
    of the larger side stands in ``per_doc`` pairs, the others in as many or more."""
    turn = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    pairs = _paired(sample, per_doc)
    if sample.schema["x"].dataType.typeName() == "binary":
        pairs = pairs.mapInArrow(_opened, "id long, g array<double>, b array<double>")
    return pairs.select(
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("label"),
        F.zip_with("g", "b", lambda g, b: (g - b) * turn).alias("x"))


def _opened(batches):
    for b in batches:
        cols = [c for c in b.schema.names if c not in ("g", "b")]
        sides = [[unpacked(x) for x in b.column(c).to_pylist()] for c in ("g", "b")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *(pa.array(x, pa.list_(pa.float64())) for x in sides)], [*cols, "g", "b"])


def _cut(raw: np.ndarray, quality: np.ndarray, bad_share: float) -> float:
    """Quantile ``bad_share`` of the scores, each label weighing as in the whole set; halfway between the two scores beside it."""
    weight = np.where(quality == 0, bad_share / (quality == 0).sum(), (1 - bad_share) / (quality == 1).sum())
    order = np.argsort(raw, kind="stable")
    below = int((np.cumsum(weight[order]) <= bad_share + 1e-9).sum())
    below = min(max(below, 1), len(raw) - 1)
    return float(raw[order[below - 1]] + raw[order[below]]) / 2


def _placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, the number (from 0) of each row in this order: sorted in ranges, numbered within, then shifted by the rows before."""
    at = F.monotonically_increasing_id()         # the part above 33 bits, the row in it below
    ranged = staged(df.orderBy(*order).withColumns({"part": F.shiftright(at, 33), "place": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    before, rows = 0, []
    for r in sorted(ranged.groupBy("part").count().collect()):      # a row per range
        rows.append((r["part"], before))
        before += r["count"]
    shift = df.sparkSession.createDataFrame(rows, "part long, before long")
    return ranged.join(F.broadcast(shift), "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def _weighed(weights):
    def run(batches):
        w = weights.value
        for b in batches:
            raw = [float(unpacked(x) @ w) for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(raw, pa.float64())], ["quality", "raw"])
    return run


def _whole_cut(sample: DataFrame, weights: np.ndarray, bad_share: float) -> float:
    """:func:`_cut` of all rows of ``sample`` (quality, x), whatever their number: from running counts of both labels by score."""
    shared = sample.sparkSession.sparkContext.broadcast(weights)
    raw = sample.select("quality", "x").mapInArrow(_weighed(shared), "quality int, raw double")
    sums = staged(prefix_sums(raw.select("raw", *[(F.col("quality") == q).cast("long").alias(f"n{q}") for q in (0, 1)]), "raw", ["n0", "n1"]), "scores")
    heavy = (bad_share / F.col("n0_total"), (1 - bad_share) / F.col("n1_total"))                # what a row of each label weighs
    upto = lambda n0, n1: F.col(n0) * heavy[0] + F.col(n1) * heavy[1]
    first = F.least(*[F.when(F.col(f"n{q}") > 0, heavy[q]) for q in (0, 1)])
    most = F.lit(bad_share + 1e-9)
    some, all_ = upto("n0_below", "n1_below") + first <= most, upto("n0_below", "n1_below") + upto("n0", "n1") <= most
    lowest = [(r["raw"], r["n"]) for r in sums.select("raw", (F.col("n0") + F.col("n1")).alias("n")).orderBy("raw").limit(2).collect()]
    low, high, last = sums.agg(F.max(F.when(some, F.col("raw"))), F.min(F.when(~all_, F.col("raw"))), F.max("raw")).first()
    if low is None:             # one row is below the cut at least
        low, high = lowest[0][0], lowest[0][0] if lowest[0][1] > 1 else lowest[1][0]
    return (low + (last if high is None else high)) / 2


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, h, x: the packed measures of every text and its hash, computed once."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))
    return staged(rows.mapInArrow(_described, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, h long, x binary"), "measured")


def _learned(measured: DataFrame, labels: DataFrame, sample_docs: int | None, id_col: str, label_col: str) -> Model:
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    placed = _placed(measured.join(marks, "doc_id").select("quality", "h", "doc_id"), "quality", "h", "doc_id")
    n = {r["quality"]: r["count"] for r in placed.groupBy("quality").count().collect()}
    if len(n) < 2:
        return Model(None)
    chosen = placed.select("quality", "doc_id", (F.col("place") - F.when(F.col("quality") == 1, n[0]).otherwise(0)).alias("place"))
    if sample_docs is not None:
        chosen = chosen.where(F.col("place") < sample_docs)
    sample = staged(chosen.join(measured.select("doc_id", "x"), "doc_id").select("quality", "place", "x"), "sample")
    pairs = preference_pairs(sample).select("label", array_to_vector("x").alias("features"))
    w = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=60, tol=1e-6).fit(pairs).coefficients.toArray()
    return Model(w, _whole_cut(sample, w, n[0] / (n[0] + n[1])))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Learns from the documents that ``labels`` (id, 0/1) marks; other labels and nulls are left out.

    All of them count, unless ``sample_docs`` names a number for each label: then those with the smallest hash of
    the text. With one label only there is nothing to prefer."""
    return _learned(_measured(docs, id_col, text_col), labels, sample_docs, id_col, label_col)


def _scored(model):
    def run(batches):
        m = model.value
        for b in batches:
            cols = [c for c in b.schema.names if c != "x"]
            s = [m.score(unpacked(x)) for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(s, pa.float64())], [*cols, "score"])
    return run


def rank_quality(docs: DataFrame, labels: DataFrame, sample_docs: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from PASS_SCORE).

    Learns from the labelled rows that are not held out; scores by the text alone.

    * a null or empty text is scored like any other, from its size alone;
    * without labels of both kinds every score is 0.5;
    * repeated rows each get the same row; of repeated labels each counts;
    * texts are read whole; an empty table gives an empty result; other columns are ignored.
    """
    measured = _measured(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(_learned(measured.where("NOT held_out"), labels, sample_docs, id_col, label_col))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double"
    return measured.select("doc_id", "held_out", "x").mapInArrow(_scored(model), schema).withColumn("predicted", (F.col("score") >= PASS_SCORE).cast("int"))


def best_share(scored: DataFrame, share: float, accuracy: int = 100_000) -> DataFrame:
    """Rows of ``scored`` whose score is at or above its quantile 1 - ``share`` over all rows (ties at the cut all stay)."""
    at = scored.agg(F.percentile_approx("score", 1.0 - share, accuracy)).first()[0]
    return scored.where(F.col("score") >= at) if at is not None else scored
