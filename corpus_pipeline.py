"""Documents to packed sequences: five stages, each on all that the one before kept.

Language ID drops documents without a letter or mostly outside the learned
languages; exact dedup and the Jaccard join (five-word shingles, similarity
0.8) keep the smallest doc_id of each group; decontamination drops documents
that hold a benchmark item; packing returns the pieces of what is left.

All but the last stage return the rows they keep with all their columns.
Null texts are rejected by the first stage; repeated rows are left once by
the second; extra columns are carried along; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.llm import decontam, exact_dedup, jaccard, langid, packing
from skylane.llm.common import staged, table

SHINGLE, NUM, DEN = 5, 4, 5
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; null and letterless texts go, and where no row names a language
    every other text stays. Each row is judged by its own text, so repeated rows go or stay together."""
    return langid.without_foreign(docs, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, the smallest doc_id; null counts as empty."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the smallest doc_id; null texts and documents without words stay."""
    classes = jaccard.jaccard_components(docs, SHINGLE, NUM, DEN)
    gone = classes.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item; null texts hold none, repeated rows go or stay together."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2,048 tokens; null counts as empty."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language ID", language), ("exact dedup", exact), ("Jaccard join", near), ("decontamination", decontaminate), ("packing", pack)]
ORACLE_SQL = None       # SQL has no tokenizer and no trained model; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
