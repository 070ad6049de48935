"""Query metrics as aggregates of a requests table (ts, route, latency_ms, cache_hit, error), and the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import Index, size_estimate, top_terms

BUCKETS = 32


def bucket(ms: Column) -> Column:
    """Number of the first power of two that is ms or more, by integer comparison; 31 for all above."""
    out = F.lit(BUCKETS - 1)
    for b in range(BUCKETS - 2, -1, -1):
        out = F.when(ms <= (1 << b), b).otherwise(out)
    return out


def latency_histogram(requests: DataFrame) -> DataFrame:
    return requests.groupBy(bucket(F.col("latency_ms")).alias("bucket")).agg(F.count("*").alias("n"))


def _ratio(hits: Column, n: Column) -> Column:
    return F.coalesce(hits * 100.0 / F.when(n > 0, n), F.lit(0.0))


def summary(requests: DataFrame) -> DataFrame:
    """One row; a latency of 0 counts as unset for the minimum."""
    n, hits = F.count("*"), F.sum(F.col("cache_hit").cast("long"))
    return requests.agg(
        n.alias("queries"),
        F.coalesce(hits, F.lit(0)).alias("cache_hits"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.min(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0)).alias("min_latency"),
        F.coalesce(F.max("latency_ms"), F.lit(0)).alias("max_latency"),
        _ratio(hits, n).alias("cache_hit_rate"),
        F.coalesce(F.sum(F.col("error").isNotNull().cast("long")), F.lit(0)).alias("errors"),
    )


def counters(events: DataFrame) -> DataFrame:
    """Sums by name of (name, value)."""
    return events.groupBy("name").agg(F.sum("value").alias("value"))


def latest(events: DataFrame, key: str, value: str) -> DataFrame:
    """Gauges, or the last error of each type: the value with the highest ts."""
    return events.groupBy(key).agg(F.max_by(value, "ts").alias(value))


def dashboard(index: Index, requests: DataFrame, log: DataFrame, scoring: str = "bm25") -> DataFrame:
    """One row of all that the statistics page shows."""
    size = size_estimate(index.postings, index.stats).select(F.floor(F.col("index_bytes") / 1024).alias("index_kb"))
    terms = top_terms(index.vocab).agg(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("o"), "term", "df"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["term"].alias("term"), x["df"].alias("df"))).alias("top_terms"))
    one = summary(requests).select("queries", "cache_hits", "avg_latency", "cache_hit_rate")
    row = index.stats.select(F.col("n").alias("docs"), F.col("avgdl").alias("avg_doc_len"), F.lit(scoring).alias("scoring"))
    for part in (size, one, log.agg(F.countDistinct("query").alias("distinct_queries")), terms):
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row


def _joined(rows: DataFrame | None, spark_of: DataFrame, form, name: str, before: str = "", after: str = "") -> DataFrame:
    """One row: the (name, value) rows as text, in order of name; empty where there are none."""
    if rows is None:
        return spark_of.select(F.lit("").alias(name))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda x: form(x["name"], x["value"])), "")
    return rows.agg(F.when(F.count("*") > 0, F.concat(F.lit(before), text, F.lit(after))).otherwise("").alias(name))


def _beside(row: DataFrame, *parts: DataFrame) -> DataFrame:
    for part in parts:
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row


def prometheus(requests: DataFrame, docs_indexed: DataFrame, counts: DataFrame | None = None, gauges: DataFrame | None = None) -> DataFrame:
    """Everything in the text format that scrapers read.  docs_indexed: one row (n); counts and gauges: (name, value)."""
    line = lambda name, kind, c, form="%d": F.format_string(f"# TYPE {name} {kind}\n{name} {form}\n", c)
    one = _beside(
        summary(requests),
        docs_indexed.select(F.col("n").cast("long").alias("docs_indexed")),
        _joined(counts, docs_indexed, lambda n, v: F.format_string("counter_%s %d\n", n, v.cast("long")), "counts"),
        _joined(gauges, docs_indexed, lambda n, v: F.format_string("gauge_%s %.2f\n", n, v.cast("double")), "gauges"),
    )
    text = F.concat(
        line("query_total", "counter", F.col("queries")),
        line("cache_hits_total", "counter", F.col("cache_hits")),
        line("cache_hit_rate", "gauge", F.col("cache_hit_rate"), "%.2f"),
        F.format_string("# TYPE query_latency_ms histogram\nquery_latency_avg_ms %.2f\n", F.col("avg_latency")),
        F.when(F.col("min_latency") > 0, F.format_string("query_latency_min_ms %d\nquery_latency_max_ms %d\n", F.col("min_latency"), F.col("max_latency"))).otherwise(""),
        line("errors_total", "counter", F.col("errors")),
        line("docs_indexed_total", "counter", F.col("docs_indexed")),
        F.col("counts"),
        F.col("gauges"),
    )
    return one.select(text.alias("report"))


def report(requests: DataFrame, docs_indexed: DataFrame, errors: DataFrame | None = None, counts: DataFrame | None = None, gauges: DataFrame | None = None) -> DataFrame:
    """The plain report.  docs_indexed: one row (n); errors: (name, value), the last message of each type; counts and gauges: (name, value)."""
    seen = latency_histogram(requests).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("seen"))
    buckets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.format_string("%d=%d", F.call_function("shiftleft", F.lit(1).cast("long"), i), F.coalesce(F.try_element_at(F.col("seen"), i), F.lit(0).cast("long")))), ", ")
    one = _beside(
        summary(requests),
        docs_indexed.select(F.col("n").cast("long").alias("docs_indexed")),
        seen,
        _joined(errors, docs_indexed, lambda n, v: F.format_string("  [%s] %s\n", n, v.cast("string")), "last", "RECENT ERRORS:\n"),
        _joined(counts, docs_indexed, lambda n, v: F.format_string("%s=%d ", n, v.cast("long")), "counts", "COUNTERS: { ", "}\n"),
        _joined(gauges, docs_indexed, lambda n, v: F.format_string("%s=%.2f ", n, v.cast("double")), "gauges", "GAUGES: { ", "}\n"),
    )
    text = F.concat(
        F.format_string("QUERY METRICS:\n  queries=%d, cacheHits=%d, avgLatencyMs=%.2f, cacheHitRate=%.2f%%\n", "queries", "cache_hits", "avg_latency", "cache_hit_rate"),
        F.format_string("ERROR METRICS:\n  errorCount=%d\nINDEXING METRICS:\n  docsIndexed=%d\n", "errors", "docs_indexed"),
        F.lit("[latency-buckets (ms): "),
        buckets,
        F.lit("]\n"),
        F.col("last"),
        F.col("counts"),
        F.col("gauges"),
    )
    return one.select(text.alias("report"))


def health(docs_indexed: DataFrame, requests: DataFrame) -> DataFrame:
    one = _beside(docs_indexed.select("n"), summary(requests).select("queries", "errors"))
    return one.select(F.to_json(F.struct(F.lit("ok").alias("status"), F.col("n").alias("docs"), "queries", "errors")).alias("health"))
