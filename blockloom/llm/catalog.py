"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm.session import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import matroska

    return matroska.text_media(table(spark, sf_dir, "documents"))


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import chat

    return chat.collapse_whole(table(spark, sf_dir, "conversations"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import url_reputation as url

    outcomes = table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", "quality AS good")
    return url.judge(table(spark, sf_dir, "pages"), outcomes, url.RULES)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import suffix_dedup

    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import imatch

    return imatch.edited_likeness(table(spark, sf_dir, "documents"))


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import quality

    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import jaccard

    return jaccard.component_ids(table(spark, sf_dir, "documents"), 4, (85, 100))


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from blockloom.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.PATTERN)


QUERIES = (op1_matroska_media, op2_snapshot_collapse, op3_url_reputation, op4_byte_bpe, op5_suffix_dedup, op6_imatch_fingerprints, op7_site_quality, op8_jaccard_trie, op9_toxicity_cnn, op10_best_fit_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from blockloom.llm import chat, url_reputation

    return {"op2_snapshot_collapse": chat.ORACLE, "op3_url_reputation": url_reputation.ORACLE}
