"""Exact deduplication by content-defined chunk recipes (built-in functions only).

A text is cut into chunks where its own content says so (after a sentence or
clause mark, 1,024 to 4,096 characters on), so equal passages give equal
chunks wherever they stand. Chunks are deduplicated to identifiers, a
document becomes the ordered list of its chunks' identifiers (its recipe),
and documents are compared by recipe: from then on no text moves.

Identifiers are verified: a chunk is looked up by a 64-bit hash, and every
hash is checked against the SHA-256 digests and lengths of all chunks that
have it; contents that share the short hash get a number each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.llm.common import staged, text_or_empty

# Content-defined cut: lazily 1,024 to 4,096 characters up to a mark and a
# space; where there is none (scripts without such marks) 4,096 characters.
CHUNK_PATTERN = r"(?s).{1024,4096}?(?:(?<=[.,;:!?] )|\z)|.{1,4096}"
# runs of ASCII white space, but for single spaces, which stay as they are
WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, WHITE, " ")


def chunks_of(norm: Column, pattern: str = CHUNK_PATTERN) -> Column:
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit(pattern), F.lit(0)))


def chunk_occurrences(docs: DataFrame, id_col: str, text_col: str, pattern: str = CHUNK_PATTERN) -> DataFrame:
    """One row per chunk of each document: key columns, place, hash, digest with length."""
    return (docs.select(F.col(id_col).alias("doc_id"), normalised(text_or_empty(text_col)).alias("norm"))
            .select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode(chunks_of(F.col("norm"), pattern)).alias("pos", "chunk"))
            .select("doc_id", "text_sha256", "pos", F.xxhash64("chunk").alias("h"),
                    F.concat(F.unhex(F.sha2("chunk", 256)), F.encode(F.octet_length("chunk").cast("string"), "utf-8")).alias("d")))


def chunk_ids(occ: DataFrame) -> DataFrame:
    """``h, ds``: for each 64-bit hash the digests (with lengths) of its distinct chunks, sorted.

    A chunk's identifier is (h, place of its digest in ds)."""
    return occ.select("h", "d").distinct().groupBy("h").agg(F.sort_array(F.collect_list("d")).alias("ds"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = CHUNK_PATTERN) -> DataFrame:
    """``doc_id, text_sha256, n_rows, recipe``: one row per distinct (id, text).

    Identical rows (same id, same normalised text) share a row; ``n_rows``
    counts them."""
    occ = staged(chunk_occurrences(docs, id_col, text_col, pattern), "chunks")
    refs = occ.join(chunk_ids(occ), "h")
    place = F.struct("pos", "h", F.array_position("ds", F.col("d")).cast("int").alias("seq"))
    lists = refs.groupBy("doc_id", "text_sha256").agg(
        F.sort_array(F.collect_set(place)).alias("places"),
        F.sum((F.col("pos") == 0).cast("long")).alias("n_rows"))
    return lists.select("doc_id", "text_sha256", "n_rows",
                        F.transform("places", lambda x: F.struct(x["h"].alias("h"), x["seq"].alias("seq"))).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = CHUNK_PATTERN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    * null text counts as empty; empty texts form one group like any other;
    * of equal texts the row with the smallest id stays; null ids sort last;
    * repeated rows (same id, same text) each get a row, one of them is kept;
    * an empty table gives an empty result; other columns are ignored.
    """
    rec = staged(recipes(docs, id_col, text_col, pattern), "recipes")
    groups = rec.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    return (rec.join(groups, "recipe")
            .select("doc_id", "keep_id", "group_size", "text_sha256", F.size("recipe").alias("n_chunks"),
                    F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("copy"))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    "text_sha256", "n_chunks"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns."""
    # an id may come with several texts: rows are matched by id and text
    keys = (exact_dedup(docs, id_col, text_col).where("kept")
            .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")))
    marked = docs.withColumn("__id", F.col(id_col)).withColumn("__sha", F.sha2(normalised(text_or_empty(text_col)), 256))
    joined = marked.alias("m").join(keys.alias("k"), F.col("m.__id").eqNullSafe(F.col("k.__id")) & (F.col("m.__sha") == F.col("k.__sha")), "left_semi")
    return joined.dropDuplicates(["__id", "__sha"]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
), r AS (
  SELECT t.doc_id, g.keep_id, g.group_size, t.text_sha256,
         row_number() OVER (PARTITION BY t.doc_id, t.text_sha256 ORDER BY t.doc_id) AS copy
  FROM t JOIN g USING (text_sha256)
)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND copy = 1) AS kept, text_sha256
FROM r
"""
