"""Ranking: BM25 and TF-IDF, ranked OR, scores of Boolean matches, sort modes and pages."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import query as Q
from .index import Index, smooth_idf

K1, B = 1.5, 0.75
SORTS = {"score": "score", "date": "mtime", "size": "size_bytes"}


def bm25_idf(n: Column, df: Column) -> Column:
    """The logarithm of one more than the odds (n - df + 1/2) : (df + 1/2) that a document lacks the term."""
    return F.log((n + 1) / (df + 0.5))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    """A term's share of a document's score; 0 if no document has the term or lengths make no sense."""
    bottom = tf + K1 * (1 - B + B * dl / F.when(avgdl > 0, avgdl).otherwise(1.0))
    return F.when((df > 0) & (bottom > 0), bm25_idf(n, df) * tf * (K1 + 1) / bottom).otherwise(0.0)


def finite(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)


def query_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(term, qf): how often the query has each term.  Bounded by the query's length."""
    return spark.createDataFrame(sorted(Counter(terms).items()), "term string, qf int")


def _with_statistics(index: Index, terms: list[str], wanted: list[str] | None = None) -> DataFrame:
    """The terms' postings (and those of ``wanted``) with qf, df, n and avgdl: query-sized sides are broadcast, lengths and norms are in the postings."""
    spark = index.postings.sparkSession
    words = sorted({*terms, *(wanted or ())})
    side = index.vocab.where(F.col("term").isin(words)).select("term", "df").join(F.broadcast(query_terms(spark, terms)), "term").crossJoin(F.broadcast(index.stats.select("n", "avgdl")))
    return index.postings.where(F.col("term").isin(words)).join(F.broadcast(side), "term", "left" if wanted else "inner")


def _bm25_sum() -> Column:
    return finite(F.sum(bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl")) * F.col("qf")))


def score_bm25(index: Index, terms: list[str]) -> DataFrame:
    """(doc_id, score) of every document with one of the terms."""
    if not terms:
        return index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    return _with_statistics(index, terms).groupBy("doc_id").agg(_bm25_sum().alias("score"))


def score_tfidf(index: Index, terms: list[str]) -> DataFrame:
    """(doc_id, score): (1 + ln tf) idf for every occurrence in the query, over the document's norm (1 where that is 0)."""
    if not terms:
        return index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    part = (1 + F.log("tf")) * smooth_idf(F.col("n"), F.col("df")) * F.col("qf")
    norm = F.max("norm")
    return _with_statistics(index, terms).groupBy("doc_id").agg(finite(F.sum(part) / F.when(norm > 0, norm).otherwise(1.0)).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def match_scored(index: Index, node: Q.Node, terms: list[str]) -> DataFrame:
    """(doc_id, score): the tree's matches with their BM25 scores, whatever the scoring is set to; both from one scan and one aggregation."""
    if not terms:
        return Q.match(node, index.postings, index.docs).withColumn("score", F.lit(0.0))
    hits = _with_statistics(index, terms, Q.leaf_terms(node))
    return Q.match(node, hits, index.docs, {"score": _bm25_sum()}, terms).withColumn("score", F.coalesce("score", F.lit(0.0)))


def results(index: Index, query: str, scoring: str = "bm25", candidates: int = 200) -> DataFrame:
    """(doc_id, score) of all that a query finds: every match, or, where it doesn't parse, the best ``candidates`` of the ranked OR."""
    terms = index.analyzer.split(query)
    node = Q.parse(query, index.analyzer)
    if node is not None:
        return match_scored(index, node, terms)
    return top((score_bm25 if scoring == "bm25" else score_tfidf)(index, terms), candidates)


def search(index: Index, query: str, k: int = 10, sort: str = "score", scoring: str = "bm25", candidates: int | None = None) -> DataFrame:
    """(doc_id, path, size_bytes, mtime, score) of the k best.

    A query that parses is matched and all matches are sorted.  One that doesn't is a
    ranked OR, of which the best ``candidates`` (10 k) by score are sorted by the mode.
    """
    k = max(1, min(100, k))
    found = results(index, query, scoring, candidates or 10 * k)
    columns = index.docs.select("doc_id", "path", "size_bytes", "mtime")
    key = SORTS.get(sort, "score")
    if key == "score":  # at most 100 rows are sent
        return columns.join(F.broadcast(top(found, k)), "doc_id").select("doc_id", "path", "size_bytes", "mtime", "score").orderBy(F.desc("score"), "doc_id")
    return found.join(columns, "doc_id").select("doc_id", "path", "size_bytes", "mtime", "score").orderBy(F.desc(key), "doc_id").limit(k)


def ranked(results: DataFrame, key: str = "score") -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(key), "doc_id")))


def page(results: DataFrame, number: int, total: int, size: int = 10, key: str = "score") -> DataFrame:
    """A page of sorted results; its number is moved into 1 .. the last page."""
    last = max(1, -(-total // size))
    number = max(1, min(number, last))
    return results.orderBy(F.desc(key), "doc_id").offset(size * (number - 1)).limit(size)


def shard_of(path: Column, shards: int) -> Column:
    """The shard that a document belongs to, by its path."""
    return F.pmod(F.xxhash64(path), F.lit(shards))


def sharded_top(scored: DataFrame, docs: DataFrame, shards: int, k: int) -> DataFrame:
    """The k best of each shard (by path), merged: global statistics make it the same as without shards."""
    w = Window.partitionBy("shard").orderBy(F.desc("score"), "doc_id")
    placed = scored.join(docs.select("doc_id", shard_of(F.col("path"), shards).alias("shard")), "doc_id")
    best = placed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top(best.select("doc_id", "score"), k)
