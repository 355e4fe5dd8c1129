"""Token counts through a digest cache.

Counts are stored under (digest of the tokenizer file, SHA-256 of the text).
A run joins the digests of its texts to the stored counts, encodes only the
distinct texts that miss, appends their counts to the cache, and joins again.
Only digests are grouped; of the texts that miss, one copy each moves, keyed
by (id, digest), so a text that a third of all rows share is no hot key.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.llm.common import text_or_empty

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
LONG_TEXT = 1 << 16     # characters from which a text is cut at exact places
BATCH_CHARS = 1 << 22   # characters encoded in one call

_loaded: dict = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _exact_parts(text: str) -> list[str]:
    """Parts of a long text whose counts add up to the text's count.

    No piece of the vocabulary holds the white-space mark after another
    character (checked on loading), so no merge crosses a single space
    between two visible ASCII signs; and the space itself is what the library
    puts before each part again. Other neighbours could be a literal
    white-space mark, or become one or a space when the library normalises:
    there a text is not cut."""
    parts, at = [], 0
    for m in re.finditer(r"(?<=[!-~]) (?=[!-~])", text):
        if m.start() - at >= LONG_TEXT:
            parts.append(text[at:m.start()])
            at = m.end()
    return [*parts, text[at:]]


def counter(path: str):
    """``list of texts -> list of token counts`` by the library of the file's kind."""
    if path in _loaded:
        return _loaded[path]
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        splits = not any("▁" in p.lstrip("▁") for p in pieces)

        def count(texts):
            out = []
            for t in texts:
                long = splits and len(t) > LONG_TEXT
                out.append(sum(map(len, sp.encode(_exact_parts(t), num_threads=1))) if long else len(sp.encode(t)))
            return out
    else:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        def count(texts):
            return [len(e) for e in tok.encode_batch_fast(list(texts), add_special_tokens=False)]
    _loaded[path] = count
    return count


def _encode(path: str):
    def run(batches):
        count = counter(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            counts, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                    size += len(texts[end])
                    end += 1
                counts += count(texts[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return run


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` stored for this tokenizer; empty before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    # two runs may have stored the same text
    return cache.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def add_misses(docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the distinct texts that the cache does not know and append their counts."""
    spark, version = docs.sparkSession, tokenizer_digest(model_path)
    rows = _digests(docs, id_col, text_col)
    reps = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    missing = reps.join(read_cache(spark, cache_path, version), "digest", "left_anti").hint("shuffle_hash")
    full = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    full = full.withColumn("d", F.unhex(F.sha2("text", 256)))
    todo = full.join(missing, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("d") == F.col("digest"))).select("digest", "text")
    counted = todo.mapInArrow(_encode(model_path), "digest binary, n_tokens long")
    (counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
     .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
     .write.mode("append").parquet(cache_path))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.unhex(F.sha2(text, 256)).alias("digest"))


def token_counts(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    The cached text is the text itself: any folding of white space or case
    could change its tokens, so the normal form is only null -> empty.

    * null and empty texts have 0 tokens; long texts are counted whole;
    * repeated rows and equal texts are encoded once and each get a row;
    * an empty table gives an empty result and appends nothing of note;
    * other columns are ignored. The cache may be shared by many runs; a
      task that is run again writes nothing twice (the commit is per job).
    """
    add_misses(docs, model_path, cache_path, id_col, text_col)
    cache = read_cache(docs.sparkSession, cache_path, tokenizer_digest(model_path))
    return (_digests(docs, id_col, text_col).join(cache, "digest", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
