"""Completion and spelling over the vocabulary and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def autocomplete(vocab: DataFrame, prefix: str, k: int = 5) -> DataFrame:
    """Terms with the exact prefix, most documents first; the prefix filter reaches the Parquet scan."""
    return vocab.where(F.startswith("term", F.lit(prefix))).select("term", "df").orderBy(F.desc("df"), "term").limit(max(1, min(20, k)))


def spelling(vocab: DataFrame, word: str, most: int = 2) -> DataFrame:
    """(term, df, distance) within an edit distance, nearest first; lengths are compared before distances."""
    near = vocab.where(F.abs(F.length("term") - len(word)) <= most)
    near = near.withColumn("distance", F.levenshtein(F.col("term"), F.lit(word), most)).where("distance >= 0")
    return near.select("term", "df", "distance").orderBy("distance", F.desc("df"), "term")


def assistant(vocab: DataFrame, words: list[str], corrections: int = 3, completions: int = 5) -> DataFrame:
    """(word, kind, term, df) for the words of a query that found nothing."""
    out = None
    for w in dict.fromkeys(words):
        for kind, found in (("correction", spelling(vocab, w).limit(corrections)), ("completion", autocomplete(vocab, w, completions))):
            part = found.select(F.lit(w).alias("word"), F.lit(kind).alias("kind"), "term", "df")
            out = part if out is None else out.unionByName(part)
    return vocab.select(F.lit("").alias("word"), F.lit("").alias("kind"), "term", "df").limit(0) if out is None else out


def last_word(query: str) -> str | None:
    """What a search box completes: the last word, from two letters up."""
    word = query.split(" ")[-1]
    return word if len(word) >= 2 else None


def popular(log: DataFrame, k: int = 10) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(max(1, min(50, k)))


def suggest_queries(log: DataFrame, prefix: str, k: int = 5) -> DataFrame:
    return popular(log.where(F.startswith("query", F.lit(prefix))), k)


def distinct_queries(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("query").alias("distinct_queries"))
