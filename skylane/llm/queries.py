"""Registered queries of the text operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.llm import chat, decontam, exact_dedup, hard_negatives, html_extract, jaccard, langid, lexical, license_scan, packing, pii, quality, token_cache
from skylane.llm.common import new_folder, table


def _tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own for each call, so that the result never rests on an earlier run
    return token_cache.token_counts(table(spark, sf_dir, "documents"), _tokenizer_path("piece_bpe_32k.model"), new_folder(spark, "token-cache"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer_path("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", hard_negatives.shifted_labels())
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_exact_dedup, op3_token_counts, op4_pii, op5_license_scan, op6_language_id,
                            op7_html_text, op8_jaccard_join, op9_chat_format, op10_pack, op11_hard_negatives, op12_quality_rank,
                            op13_lexical_search)}
ORACLES: dict[str, str] = {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op13_lexical_search": lexical.ORACLE_SQL}
