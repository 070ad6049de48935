"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, chat, langid, mixing, neardup, packing, perplexity, toxicity, urlfilter, warc
from .workspace import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.bins(table(spark, sf_dir, "documents"))


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"))


def op3_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.kept(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of every page's archive, with its bytes (text here, as the pages are)."""
    return warc.convert(warc.archives(table(spark, sf_dir, "pages"))).withColumn("record", F.col("record").cast("string"))


def op5_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.passages(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_chat_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turns(chat.records(table(spark, sf_dir, "conversations")))


def op7_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks; all vectors answer."""
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), asking=F.col("vec_id") % 20 == 0)


def op8_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.listed(pages, urlfilter.bad_urls(pages, table(spark, sf_dir, "labels")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_best_fit_packing,
        op2_entropy_mixing,
        op3_ngram_perplexity,
        op4_arc_to_warc,
        op5_toxic_passages,
        op6_chat_schema_fingerprint,
        op7_bit_sliced_top_k,
        op8_blocked_bloom_urls,
        op9_minhash_near_dedup,
        op10_language_id,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_arc_to_warc": warc.SQL,
        "op6_chat_schema_fingerprint": chat.SQL,
        "op7_bit_sliced_top_k": bitsliced.SQL,
        "op8_blocked_bloom_urls": urlfilter.SQL,
    }
