"""Language identification by multilingual mixture inference.

Each document is taken as a mixture: every letter trigram was drawn from one
of the learned languages or from a flat "other" source. Expectation
maximisation estimates the shares, and a language joins the document's set
only if the gain in log-likelihood pays a penalty per extra language.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 18       # trigram hash buckets of the model
SMOOTHING = 0.01        # added to every bucket of a language
PENALTY = 3.0           # log(n trigrams) times this per language in the set
MAX_LANGUAGES = 512     # bound of the broadcast model: 512 x 2^18 x 4 bytes
DENSE_LANGUAGES = 16    # languages that a task adds up itself: 16 x 2 MiB
MAX_OTHER = 0.5         # share of "other" from which a document is rejected
MIN_SHARE = 0.01        # share of the full mixture from which a language may join the set
ROUNDS = 60

_letters: list = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str | None) -> np.ndarray | None:
    """Bucket of each trigram of the lower-cased letters, words apart by one space; None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    c = np.where(letter, codes, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]                     # the first non-letter after a word stands for the gap
    c = np.concatenate(([32], c[keep], [32])).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def _count_batches(batches):
    """Rows lang, bucket, n. The first ``DENSE_LANGUAGES`` languages of a task are added up in it, others leave text by
    text, so the memory of a task does not grow with the languages."""
    total: dict[str, np.ndarray] = {}

    def rows(lang: str, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            g = trigrams(text)
            if g is None:
                continue
            if lang not in total and len(total) < DENSE_LANGUAGES:
                total[lang] = np.zeros(BUCKETS, np.int64)
            if lang not in total:
                yield rows(lang, *np.unique(g, return_counts=True))
            elif len(g) > 4096:
                total[lang] += np.bincount(g, minlength=BUCKETS)
            else:
                np.add.at(total[lang], g, 1)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield rows(lang, at, n[at])


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log-probabilities, language x bucket, from all rows with a language.

    Counts are summed in the tasks and by language and bucket; only the
    finished model (languages x buckets) reaches the driver."""
    return learn(labelled, lang_col, text_col)[:2]


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """As :func:`train`, and for each language the share of trigrams that a new text of it can be expected to
    show for the first time: the share of those met once among all met (Good and Turing)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()       # before any count is collected
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model is bounded to as many")
    counts = (rows.mapInArrow(_count_batches, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    table = counts.toPandas()
    langs = sorted(table["lang"].unique())
    n = np.zeros((len(langs), BUCKETS), np.float64)
    n[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    new = (n == 1).sum(axis=1) / np.maximum(n.sum(axis=1), 1)
    n += SMOOTHING
    return langs, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32), new


def _em(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Shares of the sources (rows of ``p``: likelihood of each trigram) that maximise the likelihood."""
    share = np.full(len(p), 1.0 / len(p), np.float32)
    weight = count / count.sum()
    for _ in range(ROUNDS):
        new = share * (p @ (weight / (share @ p)))
        if np.abs(new - share).max() < 1e-4:
            return new
        share = new
    return share


def infer(grams: np.ndarray, logp: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Share of each language (0 outside the chosen set) and of "other".

    The set grows from the language with the largest share of the full
    mixture: the next largest is added while its gain in log-likelihood pays
    the penalty."""
    at, count = np.unique(grams, return_counts=True)
    count = count.astype(np.float32)
    langs = len(logp)
    p = np.vstack([np.exp(logp[:, at]), np.full((1, len(at)), 1.0 / BUCKETS, np.float32)])
    full = _em(p, count)
    order = np.lexsort((np.arange(langs), -full[:langs]))
    out = np.zeros(langs)
    chosen = [int(order[0])]
    if langs == 1 or full[order[1]] < MIN_SHARE:
        best, rest = float(full[chosen[0]]), float(full[langs])
        out[chosen] = best / (best + rest)
        return out, rest / (best + rest)
    fit = lambda rows, share: float(count @ np.log(share @ p[rows]))
    rows = [*chosen, langs]
    share = _em(p[rows], count)
    ll, cost = fit(rows, share), penalty * np.log(count.sum() + 1.0)
    for k in order[1:]:
        if full[k] < MIN_SHARE:
            break
        rows = [*chosen, int(k), langs]
        more = _em(p[rows], count)
        gain = fit(rows, more)
        if gain - ll <= cost:
            break
        chosen.append(int(k))
        share, ll = more, gain
    out[chosen] = share[:-1]
    return out, float(share[-1])


def _predict(langs: list[str], model):
    def run(batches):
        logp = model.value
        for b in batches:
            pred, score, sets, other = [], [], [], []
            for text in b.column("text").to_pylist():
                g = trigrams(text) if langs else None
                if g is None:
                    pred.append("und")
                    score.append(0.0)
                    sets.append([])
                    other.append(1.0)
                    continue
                share, rest = infer(g, logp)
                best = int(share.argmax())
                pred.append(langs[best])
                score.append(min(1.0, max(0.0, float(share[best]))))
                sets.append([{"lang": langs[i], "share": float(share[i])} for i in np.argsort(-share, kind="stable") if share[i] > 0])
                other.append(min(1.0, max(0.0, rest)))
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            cols = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(sets, kind), pa.array(other, pa.float64())],
                                             [*cols, "lang_pred", "score", "languages", "other"])
    return run


def held_out(id_col: str = "doc_id"):
    """True for the rows that nothing is learned from (and for null ids)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, learn_from: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, languages, other.

    Learns from the rows of ``learn_from`` (default: ``docs``) that are not
    held out and have a language; predicts from the text alone.

    * ``und`` with score 0 if the text is null or has no letter, or if there
      is nothing to learn from; equal shares go to the first name in order;
    * repeated rows each get the same row; an empty table an empty result;
    * texts are read whole; other columns are ignored.
    """
    source = docs if learn_from is None else learn_from
    langs, logp = train(source.where(~held_out(id_col)), lang_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(logp)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    pair = T.StructType().add("lang", "string").add("share", "double")
    schema = schema.add("languages", T.ArrayType(pair)).add("other", "double")
    return rows.mapInArrow(_predict(langs, model), schema)


def accepted(pred: DataFrame, max_other: float = MAX_OTHER) -> DataFrame:
    """Predictions of documents in a learned language: not ``und``, and not mostly "other"."""
    return pred.where((F.col("lang_pred") != "und") & (F.col("other") < max_other))


def is_foreign(text: str | None, langs: list[str], logp: np.ndarray, new: np.ndarray, max_other: float = MAX_OTHER) -> bool:
    """Whether a text has no letter, or is mostly in none of the learned languages.

    New trigrams go to "other" too, and a language with many letters or few
    labelled texts shows many: of a text's share of "other" only what exceeds
    the expected share of new trigrams of its main language speaks against it.
    Where nothing was learned, every text with a letter is at home."""
    grams = trigrams(text)
    if grams is None:
        return True
    if not langs:
        return False
    share, other = infer(grams, logp)
    expected = new[int(share.argmax())]
    return other >= expected + (1 - expected) * max_other


def without_foreign(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not foreign, as they are; learns from the rows of ``learn_from`` that are not held out."""
    model = docs.sparkSession.sparkContext.broadcast(learn(learn_from.where(~held_out(id_col)), lang_col, text_col))

    @F.pandas_udf("boolean")
    def at_home(texts: pd.Series) -> pd.Series:
        return pd.Series([not is_foreign(t, *model.value) for t in texts], dtype=bool)

    return docs.where(at_home(F.col(text_col).cast("string")))
