"""The engine's interface: build, search, look up, suggest, keep up to date."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import LRU
from .functions.text import Analyzer, display_path, sanitize_text
from .logs import LOG, Periodic
from .operators import crawl as C
from .operators import incremental, metrics, rank, suggest
from .operators.index import Index, build, load, save, stored
from .operators.snippet import snippets
from .plans import query as Q
from .sources.sinks import save_documents
from .workspace import delete, discard, written


@dataclass
class Hit:
    doc_id: int
    path: str
    score: float
    size: int
    mtime: int
    snippet: str = ""


@dataclass
class Answer:
    query: str
    results: list[Hit]
    cache_hit: bool
    latency_ms: int

    def to_json(self) -> str:
        rows = [{"docID": h.doc_id, "path": h.path, "score": round(h.score, 6), "size": h.size, "mtime": h.mtime, "snippet": h.snippet} for h in self.results]
        return json.dumps({"query": self.query, "cache_hit": self.cache_hit, "latency_ms": self.latency_ms, "results": rows}, ensure_ascii=False)


@dataclass
class SearchEngine:
    """Over an index that is written (``build``, ``load``): a query scans its terms' postings, nothing is computed again.

    ``documents``: path of the document table that updates go to; ``index_path``: where the index is saved after each.
    """

    spark: SparkSession
    index: Index
    scoring: str = "bm25"
    cache: LRU = field(default_factory=lambda: LRU(1000))
    log: list[str] = field(default_factory=list)
    requests: list[tuple[int, bool, str | None]] = field(default_factory=list)
    #: (kind, name, value, message, order) of counters, gauges and errors.
    events: list[tuple[str, str, float, str | None, int]] = field(default_factory=list)
    documents: str | None = None
    index_path: str | None = None

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, analyzer: Analyzer = Analyzer(), scoring: str = "bm25", **places: str) -> SearchEngine:
        began = time.monotonic()
        engine = cls(spark, stored(spark, build(docs, analyzer)), scoring, **places)
        engine._indexed(began)
        return engine

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer = Analyzer(), scoring: str = "bm25", **places: str) -> SearchEngine:
        began = time.monotonic()
        engine = cls(spark, load(spark, path, analyzer), scoring, **places)
        engine.count("index_loads")
        engine.gauge("last_load_time_ms", int((time.monotonic() - began) * 1000))
        return engine

    def save(self, path: str) -> None:
        save(self.index, path)

    # ---- counters, gauges, errors ----

    def count(self, name: str, by: int = 1) -> None:
        self.events.append(("counter", name, float(by), None, len(self.events)))

    def gauge(self, name: str, value: float) -> None:
        self.events.append(("gauge", name, float(value), None, len(self.events)))

    def error(self, kind: str, message: str) -> None:
        self.events.append(("error", kind, 1.0, message, len(self.events)))
        LOG.error("Error [%s]: %s", kind, message)

    def _indexed(self, began: float) -> int:
        n, ms = self.index.stats.first()["n"], int((time.monotonic() - began) * 1000)
        self.count("indexing_ops")
        self.count("total_docs_indexed", n)
        LOG.info("Indexed %d docs in %dms", n, ms)
        return ms

    # ---- queries ----

    def _key(self, query: str, k: int, sort: str) -> tuple:
        node = Q.parse(query, self.index.analyzer)
        return (node, tuple(self.index.analyzer.split(query)), self.scoring, sort, k, self.index.version)

    def search(self, query: str, k: int = 10, sort: str = "score", with_snippets: bool = True) -> Answer:
        """The best k (1 to 100) by score, date or size."""
        return self._search(query, k, sort, with_snippets, logged=True)

    def _search(self, query: str, k: int, sort: str, with_snippets: bool, logged: bool) -> Answer:
        began = time.monotonic()
        if len(query.encode()) > 1000:
            raise ValueError("query is longer than 1000 bytes")
        if not isinstance(k, int):
            raise ValueError("k must be a whole number")
        text, k, sort = sanitize_text(query), max(1, min(100, k)), sort if sort in rank.SORTS else "score"
        key = (*self._key(text, k, sort), with_snippets)
        found = self.cache.get(key)
        hit = found is not None
        try:
            if found is None:
                found = self._run(text, k, sort, with_snippets)
                self.cache.put(key, found)
        except Exception as e:
            self.error("search", f"{type(e).__name__}: {str(e)[:200]}")
            self.requests.append((int((time.monotonic() - began) * 1000), False, "search"))
            raise
        ms = int((time.monotonic() - began) * 1000)
        if logged:
            self.log.append(query)
            self.requests.append((ms, hit, None))
        return Answer(query, found, hit, ms)

    def _hits(self, rows: DataFrame) -> list[Hit]:
        shown = rows.withColumn("shown", display_path(F.col("path"))).collect()
        return [Hit(r["doc_id"], r["shown"], r["score"], r["size_bytes"], r["mtime"]) for r in shown]

    def _with_snippets(self, hits: list[Hit], text: str) -> list[Hit]:
        if hits:  # texts of the result's documents only, at most 100
            chosen = self.index.docs.where(F.col("doc_id").isin([h.doc_id for h in hits])).select("doc_id", "content")
            made = {r["doc_id"]: r["snippet"] for r in snippets(chosen, self.index.analyzer.split(text)).collect()}
            for h in hits:
                h.snippet = made.get(h.doc_id, "")
        return hits

    def _run(self, text: str, k: int, sort: str, with_snippets: bool) -> list[Hit]:
        hits = self._hits(rank.search(self.index, text, k, sort, self.scoring))
        return self._with_snippets(hits, text) if with_snippets else hits

    def page(self, query: str, number: int, size: int = 10, sort: str = "score") -> list[Hit]:
        """A page of all matches (of the best 200 where the query is a ranked OR); its number is moved into 1 .. the last page."""
        text, size = sanitize_text(query), max(1, min(100, size))
        key = (*self._key(text, 0, sort), "pages")
        kept = self.cache.get(key)
        if kept is None:
            found = rank.results(self.index, text, self.scoring).join(self.index.docs.select("doc_id", "path", "size_bytes", "mtime"), "doc_id")
            kept = written(found, "pages")
            self.cache.put(key, kept)
        rows = rank.page(kept, number, kept.count(), size, rank.SORTS.get(sort, "score"))
        return self._with_snippets(self._hits(rows), text)

    def document(self, doc_id: int) -> dict | None:
        row = self.index.docs.where(F.col("doc_id") == doc_id).first()
        return None if row is None else row.asDict()

    def autocomplete(self, prefix: str, k: int = 5, lower: bool = False) -> list[str]:
        return [r["term"] for r in suggest.autocomplete(self.index.vocab, prefix.lower() if lower else prefix, k).collect()]

    def correct(self, word: str, most: int = 2) -> list[str]:
        return [r["term"] for r in suggest.spelling(self.index.vocab, word, most).collect()]

    def assist(self, query: str) -> DataFrame:
        return suggest.assistant(self.index.vocab, self.index.analyzer.split(query))

    # ---- reports ----

    def _log_rows(self) -> DataFrame:
        return self.spark.createDataFrame([(q,) for q in self.log], "query string")

    def _request_rows(self) -> DataFrame:
        return self.spark.createDataFrame(self.requests, "latency_ms long, cache_hit boolean, error string")

    def _events(self, kind: str) -> DataFrame | None:
        own = [e[1:] for e in self.events if e[0] == kind]
        return self.spark.createDataFrame(own, "name string, value double, message string, ts long") if own else None

    def _tables(self) -> dict[str, DataFrame | None]:
        counts, gauges, errors = (self._events(k) for k in ("counter", "gauge", "error"))
        return {
            "counts": counts and metrics.counters(counts),
            "gauges": gauges and metrics.latest(gauges, "name", "value"),
            "errors": errors and metrics.latest(errors, "name", "message").withColumnRenamed("message", "value"),
        }

    def popular(self, k: int = 10) -> list[tuple[str, int]]:
        return [tuple(r) for r in suggest.popular(self._log_rows(), k).collect()]

    def suggest(self, prefix: str, k: int = 5) -> list[str]:
        return [r["query"] for r in suggest.suggest_queries(self._log_rows(), prefix, k).collect()]

    def prewarm(self, queries: int = 10, k: int = 100) -> None:
        """Answers the most frequent queries once, by the way any query takes; neither logged nor counted."""
        for q, _ in self.popular(queries):
            self._search(q, k, "score", True, logged=False)

    def preload(self, k: int = 50) -> DataFrame:
        """The longest documents, kept in memory."""
        return self.index.docs.orderBy(F.desc("dl"), "doc_id").limit(k).persist()

    def stats(self) -> dict:
        return metrics.dashboard(self.index, self._request_rows(), self._log_rows(), self.scoring).first().asDict(recursive=True)

    def metrics(self) -> str:
        parts = self._tables()
        return metrics.prometheus(self._request_rows(), self.index.stats, parts["counts"], parts["gauges"]).first()["report"]

    def report(self) -> str:
        return metrics.report(self._request_rows(), self.index.stats, **self._tables()).first()["report"]

    def report_every(self, seconds: float = 30.0) -> Periodic:
        """Logs the report at intervals until the result is stopped."""
        return Periodic(self.report, seconds).start()

    def health(self) -> str:
        return metrics.health(self.index.stats, self._request_rows()).first()["health"]

    # ---- upkeep ----

    def _replace(self, index: Index) -> None:
        old, self.index = self.index, stored(self.spark, index)
        self.cache.clear()
        if old.path:
            delete(self.spark, old.path)
        if self.index_path:
            save(self.index, self.index_path)

    def _saved(self, docs: DataFrame) -> None:
        if self.documents:
            save_documents(self.spark, self.documents, docs.select("path", "content", "size_bytes", "mtime"))

    def rebuild(self, docs: DataFrame) -> dict:
        """Indexes the documents anew, saves index and documents, and answers the most frequent queries again."""
        began = time.monotonic()
        self._replace(build(docs, self.index.analyzer, self.index.version + 1))
        self._saved(self.index.docs)
        self.prewarm()
        return {"status": "ok", "docs": self.index.stats.first()["n"], "elapsed_ms": self._indexed(began)}

    def update(self, snapshot: DataFrame) -> dict:
        """Brings index and document table up to a snapshot (path, size_bytes, mtime, content); returns how much was added, removed, modified."""
        began = time.monotonic()
        diff = written(incremental.sync_diff(self.index.docs, snapshot), "diff")
        counts = incremental.sync_counts(diff).first().asDict()
        if counts["added"] or counts["removed"]:
            self._replace(incremental.sync(self.index, snapshot, diff))
            self._saved(self.index.docs.join(diff.where("change <> 'removed'").select("path"), "path", "left_semi"))
            self._indexed(began)
        discard(diff)
        return counts

    def remove(self, doc_ids: list[int]) -> None:
        self._replace(incremental.remove(self.index, self.spark.createDataFrame([(i,) for i in doc_ids], "doc_id long")))

    def crawl(self, pages: DataFrame, seeds: list[str], max_pages: int = 20, max_depth: int = 2, robots: DataFrame | None = None) -> dict:
        """Crawls, and takes the pages into index and document table beside what they have."""
        got = C.crawled_documents(C.crawl(pages, seeds, max(1, min(100, max_pages)), max(1, min(5, max_depth)), robots))
        fresh = got.select("path", F.octet_length("content").cast("long").alias("size_bytes"), F.xxhash64("content").alias("mtime"), "content")
        LOG.info("Crawl done: %d pages from %s", fresh.count(), ", ".join(seeds))
        kept = self.index.docs.select("path", "size_bytes", "mtime", "content").join(fresh.select("path"), "path", "left_anti")
        return self.update(kept.unionByName(fresh))
