"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

The corpus is read once into compact term counts of the searched terms. Each
task then takes shards of it, sorts the impacts of every term in a list, and
reads the lists of an item from their tops: every document seen has a lower
score (impacts read so far) and an upper one (plus the impact last read of
each list that has not shown it). A document goes when its upper score is
below the k-th lower one, and reading goes on until the documents left, their
ties and their scores are all known. Shards are cut by documents, so the best
of all is among the best of each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylane.llm.common import staged

TOP = 50
BLOCK_BYTES = 1 << 20           # item text searched by one pass over the corpus
SHARD_DOCS = 1 << 15            # documents and postings a task holds at once
SHARD_POSTINGS = 1 << 21
FIRST_READ = 256                # entries read from each list in the first round, doubled each round
# Letters and digits stay (A-Z lower-cased), bytes of other characters too; the rest of ASCII parts the terms
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_FOLD).split() if text else []


def _count(vocabulary):
    """Rows ``doc_id, n, terms, tfs``: number of terms, and the searched ones with their counts."""
    def run(batches):
        number = vocabulary.value
        for b in batches:
            n, found, tfs = [], [], []
            for text in b.column("text"):
                words = terms(text.as_py())
                n.append(len(words))
                counts = Counter(words)
                hit = [(number[w], c) for w, c in counts.items() if w in number]
                found.append([t for t, _ in hit])
                tfs.append([c for _, c in hit])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    return run


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Score that each posting adds, in 64-bit integers."""
    m = 100 - 50 + (50 * n * docs) // total
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents (indexes below ``docs``) and scores of the k best of at least ``floor``, best first, ties by index.

    ``lists`` holds, for each term, documents and impacts, largest impact
    first. Only the next entries of each list are ever read.
    """
    lists = [x for x in lists if len(x[0])]
    here = np.arange(docs)              # documents still in question
    slot = np.arange(docs)              # their places in the arrays below, -1 for those that went
    lower = np.zeros(docs, np.int64)
    seen = np.zeros((len(lists), docs), bool)
    bound = np.array([x[1][0] for x in lists], np.int64)
    at, step = [0] * len(lists), FIRST_READ
    while len(here):
        for t, (ids, gain) in enumerate(lists):
            if at[t] < len(ids):
                end = min(len(ids), at[t] + step)
                place = slot[ids[at[t]:end]]
                inside = place >= 0
                place = place[inside]
                lower[place] += gain[at[t]:end][inside]
                seen[t, place] = True
                at[t] = end
                bound[t] = gain[end - 1] if end < len(ids) else 0
        step *= 2
        upper = lower + bound @ ~seen
        least = max(floor, int(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) > k else 0)
        left = upper >= least
        if not left.all():
            slot[here] = -1
            here, lower, upper, seen = here[left], lower[left], upper[left], seen[:, left]
            slot[here] = np.arange(len(here))
        if (lower == upper).all():
            break
    best = np.lexsort((here, -lower))[:k]
    return here[best], lower[best]


class _Best:
    """The k best documents of each item that a task has seen."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.found = k, [(np.empty(0, np.int64), None)] * items

    def floor(self, item: int) -> int:
        scores = self.found[item][0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, item: int, scores: np.ndarray, ids: pa.Array) -> None:
        old, kept = self.found[item]
        if kept is not None:
            scores, ids = np.concatenate([old, scores]), pa.concat_arrays([kept, ids])
        order = pc.sort_indices(pa.table({"s": scores, "d": ids}), [("s", "descending"), ("d", "ascending")], null_placement="at_start")[:self.k]
        self.found[item] = (scores[order.to_numpy()], ids.take(order))


def _search_shard(batches: list[pa.RecordBatch], queries: list[list[int]], w: np.ndarray, docs: int, total: int, best: _Best) -> None:
    shard = pa.Table.from_batches(batches).combine_chunks()
    shard = shard.take(pc.sort_indices(shard, [("doc_id", "ascending")], null_placement="at_start"))
    ids = shard.column("doc_id").combine_chunks()
    size = pc.list_value_length(shard.column("terms")).to_numpy()
    doc = np.repeat(np.arange(len(ids)), size)
    term = pc.list_flatten(shard.column("terms")).to_numpy()
    tf = pc.list_flatten(shard.column("tfs")).to_numpy()
    gain = impacts(tf, shard.column("n").to_numpy()[doc], w[term], docs, total)
    some = gain > 0
    doc, term, gain = doc[some], term[some], gain[some]
    order = np.lexsort((doc, -gain, term))
    doc, gain = doc[order], gain[order]
    cuts = np.searchsorted(term[order], np.arange(len(w) + 1))
    for item, query in enumerate(queries):
        found, scores = nra([(doc[cuts[t]:cuts[t + 1]], gain[cuts[t]:cuts[t + 1]]) for t in query], len(ids), best.k, best.floor(item))
        if len(found):
            best.add(item, scores, ids.take(pa.array(found)))


def _search(model, k: int):
    def run(batches):
        queries, w, docs, total = model.value
        best, held, n, postings, kind = _Best(len(queries), k), [], 0, 0, None
        for b in batches:
            kind = b.schema.field("doc_id").type
            b = b.filter(pc.greater(pc.list_value_length(b.column("terms")), 0))
            for at in range(0, b.num_rows, SHARD_DOCS // 8):
                part = b.slice(at, SHARD_DOCS // 8)
                more = pc.sum(pc.list_value_length(part.column("terms"))).as_py()
                if held and (n + part.num_rows > SHARD_DOCS or postings + more > SHARD_POSTINGS):
                    _search_shard(held, queries, w, docs, total, best)
                    held, n, postings = [], 0, 0
                held.append(part)
                n, postings = n + part.num_rows, postings + more
        if held:
            _search_shard(held, queries, w, docs, total, best)
        for item, (scores, ids) in enumerate(best.found):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item, np.int32)), ids.cast(kind), pa.array(scores)],
                                                 ["item", "doc_id", "score"])
    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items as rows (item_id, text), in blocks of at most BLOCK_BYTES of text (or one item)."""
    block, size = [], 0
    for row in items.toLocalIterator():
        more = len(row["text"] or b"")
        if block and size + more > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(row)
        size += more
    if block:
        yield block


def _search_block(spark: SparkSession, block: list, corpus: DataFrame, item_type: T.DataType, k: int) -> DataFrame:
    words = [sorted(set(terms(bytes(r["text"] or b"")))) for r in block]
    number = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    vocabulary = spark.sparkContext.broadcast(number)
    id_field = corpus.schema["doc_id"]
    counted = T.StructType([id_field]).add("n", "long").add("terms", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.LongType()))
    postings = staged(corpus.mapInArrow(_count(vocabulary), counted), "postings")
    vocabulary.destroy()
    docs, total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["count"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # one row a searched term
    w = np.array([weight(docs, df.get(i, 0)) for i in range(len(number))], np.int64)
    model = spark.sparkContext.broadcast(([[number[x] for x in found] for found in words], w, docs, total))
    found = T.StructType().add("item", "integer").add(id_field).add("score", "long")
    best = postings.mapInArrow(_search(model, k), found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], T.StructType().add("item", "integer").add("item_id", item_type))
    out = staged(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")     # names: one block
    model.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per item and hit: item_id, rank (1..k), doc_id, score, for the k best documents with a score above 0.

    * null and empty texts have no terms: such a document is no hit and does
      not count, such an item has no rows;
    * equal scores rank by ascending doc_id (null first); repeated document
      rows count and rank each for itself, a repeated item row is searched
      again;
    * texts are read whole; an empty table on either side gives no rows;
      other columns are ignored.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    wanted = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text"))
    kind = wanted.schema["item_id"].dataType
    parts = [_search_block(spark, block, corpus, kind, k) for block in _blocks(wanted)]
    if not parts:
        schema = T.StructType().add("item_id", kind).add("rank", "integer").add(corpus.schema["doc_id"]).add("score", "long")
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)


# The same by whole joins; terms by the contract's pattern
ORACLE_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n FROM lowered WHERE len(words) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
tfs AS (
  SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, unnest(words) AS term FROM lowered)
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole),
gains AS (
  SELECT t.doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS gain
  FROM tfs t JOIN sizes USING (doc_id) JOIN weights USING (term), whole),
scores AS (
  SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score
  FROM wanted JOIN gains USING (term) GROUP BY item_id, doc_id HAVING sum(gain) > 0),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
