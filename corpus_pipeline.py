"""A training corpus from the documents table: filter, deduplicate, mix, pack.

Every stage takes (spark, docs, sf_dir); between stages the documents are
written as Parquet and read again, and what a stage has read is deleted
once its result is written.  Every stage but the last returns the columns of its
input, further ones too, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, mixing, neardup, packing, toxicity
from tessera.llm.workspace import delete, new_path, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified.

    Null and empty texts, and texts without letters, go.  Null and repeated doc_ids are
    judged by their texts, row by row; very long texts whole.  Rows without lang are no examples.
    """
    return langid.keep_accepted(docs, langid.fit(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic.

    Null and empty texts stay (they hold no toxic passage).  Null and repeated doc_ids are judged by
    their texts, row by row; very long texts whole.  Without toxic or clean labels all stay.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Null, empty and wordless texts are near duplicates of nothing and stay.  Of rows that are repeated, or
    that have no doc_id of their own, one stays as of any group.
    """
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's weight asks for.

    Null and empty texts have no tokens and stay once; null source and lang are a source and a language.  Equal rows are drawn for one by one.
    """
    return mixing.apply_copies(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' pieces.

    Null and empty texts are in no bin; rows with null or repeated doc_id are packed each; texts longer than a bin are cut.
    """
    return packing.bins(docs)


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The fits of the first two stages, the signatures and Newton's iterations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{at}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
