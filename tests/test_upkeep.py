"""Incremental upkeep, streams, crawling, sources, sinks and metrics."""

from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.caches import LRU
from tessera.operators import crawl as C
from tessera.operators import incremental as N
from tessera.operators import index as I
from tessera.operators import metrics as M
from tessera.sources import files, sinks
from tessera.streaming import operators as ST

DOC = "doc_id long, path string, size_bytes long, mtime long, content string"


def _index(spark, texts: dict[str, tuple[int, str]]):
    return I.build(spark.createDataFrame([(i, p, len(t), m, t) for i, (p, (m, t)) in enumerate(texts.items())], DOC))


def _snapshot(spark, texts: dict[str, tuple[int, str]]):
    return spark.createDataFrame([(p, len(t), m, t) for p, (m, t) in texts.items()], "path string, size_bytes long, mtime long, content string")


OLD = {"a": (1, "red fox"), "b": (2, "quick fox"), "c": (0, "old car"), "d": (4, "brown cow")}
NEW = {"a": (1, "red fox"), "b": (9, "slow fox"), "c": (7, "new car"), "e": (5, "blue bird")}


def test_sync(spark) -> None:
    index, snapshot = _index(spark, OLD), _snapshot(spark, NEW)
    diff = N.sync_diff(index.docs, snapshot)
    assert {tuple(r) for r in diff.collect()} == {("b", "modified"), ("d", "removed"), ("e", "added")}
    assert tuple(N.sync_counts(diff).first()) == (2, 1, 1)
    after = N.sync(index, snapshot)
    want = _index(spark, {k: v for k, v in NEW.items() if k != "c"} | {"c": OLD["c"]})
    terms = lambda i: {(r["term"], r["path"], tuple(r["positions"])) for r in i.postings.join(i.docs, "doc_id").collect()}
    assert terms(after) == terms(want)
    assert {tuple(r) for r in after.vocab.collect()} == {tuple(r) for r in want.vocab.collect()}
    assert N.sync_diff(after.docs, snapshot).count() == 0
    assert after.docs.groupBy("doc_id").count().where("count > 1").count() == 0


def test_remove(spark) -> None:
    index = _index(spark, OLD)
    gone = spark.createDataFrame([(0,)], "doc_id long")
    without, marked = N.remove(index, gone), N.remove(index, gone, count_tombstones=True)
    assert without.stats.first()["n"] == 3 and marked.stats.first()["n"] == 4
    assert "red" not in {r["term"] for r in without.vocab.collect()} | {r["term"] for r in marked.vocab.collect()}


def test_vanished(spark) -> None:
    index = _index(spark, {"/d/a": (1, "x1"), "/d/crawled/b": (1, "y1"), "/d/c": (1, "z1")})
    left = I.without_vanished(index, spark.createDataFrame([("/d/c",)], "path string"))
    assert {r["path"] for r in left.docs.collect()} == {"/d/crawled/b", "/d/c"} and left.stats.first()["n"] == 2


def test_wal(spark) -> None:
    log = [(1, "ADD", "a"), (2, "ADD", "b"), (3, "REINDEX", ""), (4, "ADD", "c"), (5, "REMOVE", "c"), (6, "ADD", "a"), (7, "REMOVE", "d")]
    fold = lambda rows: {tuple(r) for r in N.wal_fold(spark.createDataFrame(rows, "seq long, op string, path string")).collect()}
    assert fold(log) == {("c", "REMOVE"), ("a", "ADD"), ("d", "REMOVE")}
    assert fold(log[:2]) == {("a", "ADD"), ("b", "ADD")} and fold(log[:3]) == set()


def _windows(times: list[int], limit: int, window: int) -> list[bool]:
    out, start, n = [], None, 0
    for t in times:
        if start is None or t - start >= window:
            start, n = t, 0
        n += 1
        out.append(n <= limit)
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path) -> None:
    rng = random.Random(1)
    per = {k: sorted(rng.randrange(0, 200_000_000) for _ in range(150)) for k in ("x", "y")}
    rows = [(k, t, i) for k, ts in per.items() for i, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "key string, us long, event_id long").select("key", F.timestamp_micros("us").alias("ts"), "event_id")
    want = {(k, i): ok for k, ts in per.items() for i, ok in enumerate(_windows(ts, 40, 60_000_000))}
    got = {(r["key"], r["event_id"]): r["allowed"] for r in ST.rate_limit(table, 40).collect()}
    assert got == want and not all(want.values())
    odd = table.union(spark.createDataFrame([(None, 5, 1), (None, 5, 1)], "key string, us long, event_id long").select("key", F.timestamp_micros("us"), "event_id"))
    assert ST.rate_limit(odd, 40).where("key is null and allowed").count() == 2
    for n, (lo, hi) in enumerate([(0, 70), (70, 150)]):  # two files, two batches
        table.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ST.rate_limit_stream(stream, 40).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["key"], r["event_id"]): r["allowed"] for r in spark.table("limited").collect()} == want


def test_popularity_stream(spark, tmp_path) -> None:
    log = spark.createDataFrame([("a",), ("b",), ("a",)], "query string")
    log.write.parquet(str(tmp_path / "in"))
    q = ST.popularity(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("pop").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("pop").collect()} == {("a", 2), ("b", 1)}


def test_ingest_and_replay_streams(spark, tmp_path) -> None:
    target, seen = str(tmp_path / "docs"), []
    for n, rows in enumerate([[("p", "1"), ("q", "2")], [("q", "9"), ("r", "3"), ("r", "3")]]):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        source = spark.readStream.schema("path string, content string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        ST.ingest(source, target, str(tmp_path / "ck"), str(tmp_path / "added")).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(target).collect()} == {("p", "1"), ("q", "2"), ("r", "3")}
    added = spark.read.parquet(str(tmp_path / "added")).orderBy("seq").collect()
    assert {r["path"] for r in added[:2]} == {"p", "q"} and [(r["op"], r["path"]) for r in added[2:]] == [("ADD", "r")]
    sinks.append_wal(spark, str(tmp_path / "wal"), [(1, "ADD", "a"), (2, "REINDEX", ""), (3, "REMOVE", "b")])
    wal = spark.readStream.schema("seq long, op string, path string").parquet(str(tmp_path / "wal"))
    ST.replay(wal, lambda todo, anew: seen.append(({tuple(r) for r in todo.collect()}, anew)), str(tmp_path / "ck2")).awaitTermination(120)
    assert seen == [({("b", "REMOVE")}, True)]
    with pytest.raises(ValueError):
        sinks.append_wal(spark, str(tmp_path / "wal"), [(1, "DROP", "a")])


GRAPH = {
    "http://h/": '<p>home</p><a href="/a">a</a><a href="/b">b</a><a href="mailto:x">m</a><a href="rel">r</a>',
    "http://h/a": '<p>a</p><a href="/">home</a><a href="/c">c</a>',
    "http://h/b": '<p>b</p><a href="http://k/x">x</a><a href="/private/p">p</a>',
    "http://h/c": '<p>c</p><a href="/d">d</a>',
    "http://h/d": "<p>d</p>",
    "http://h/private/p": "<p>secret</p>",
    "http://k/x": "<br>",
}


def test_crawl(spark) -> None:
    pages = spark.createDataFrame(list(GRAPH.items()), "url string, html string")
    reach = lambda *x, **k: {(r["url"][7:], r["depth"]) for r in C.crawl(pages, *x, **k).collect()}
    assert reach(["http://h/"], 50, 3) == {("h/", 0), ("h/a", 1), ("h/b", 1), ("h/c", 2), ("h/private/p", 2), ("h/d", 3)}
    assert reach(["http://h/"], 50, 1) == {("h/", 0), ("h/a", 1), ("h/b", 1)}
    assert reach(["http://h/"], 2, 3) == {("h/", 0), ("h/a", 1)}
    assert reach(["no url"], 5, 3) == set()
    twice = pages.union(spark.createDataFrame([("http://h/", "<z>later</z>"), ("http://h/", None)], "url string, html string"))
    assert {r["url"][7:] for r in C.crawl(twice, ["http://h/"], 50, 3).collect()} == {r[0] for r in reach(["http://h/"], 50, 3)}
    robots = spark.createDataFrame([("h", "User-agent: other\nDisallow: /a\n\nUser-agent: *\n# all\nDisallow: /private\nDisallow:\n")], "host string, body string")
    assert ("h/private/p", 2) not in reach(["http://h/"], 50, 3, robots=robots) and ("h/a", 1) in reach(["http://h/"], 50, 3, robots=robots)


def test_sources(spark, tmp_path) -> None:
    for name, text in (("a.txt", "alpha"), ("sub/b.md", "beta"), ("sub/c.bin", "no"), ("d.TXT", "no"), ("e.txt", "")):
        p = tmp_path / "f" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    with zipfile.ZipFile(tmp_path / "f/w.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>gamma</w:t></w:p>")
    got = files.folder(spark, str(tmp_path / "f")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["path"].rpartition("/")[2], r["content"].strip(), r["size_bytes"] > 0) for r in got] == [(0, "a.txt", "alpha", True), (1, "e.txt", "", False), (2, "b.md", "beta", True), (3, "w.docx", "gamma", True)]
    assert all(r["mtime"] > 1_600_000_000 for r in got)
    plan = files.folder(spark, str(tmp_path / "f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("binaryFile") == 0  # numbered and written: no file is read again
    assert [r["content"] for r in files.folder(spark, str(tmp_path / "f"), recursive=False, only=".txt").orderBy("doc_id").collect()] == ["alpha", ""]
    assert files.file_list(spark, [str(tmp_path / "f/sub/b.md")]).first()["content"] == "beta"
    many = files.numbered(spark.range(5000).select(F.format_string("%05d", F.pmod(F.col("id") * 7919, F.lit(5000))).alias("path")))
    assert many.where("doc_id <> cast(path as long)").count() == 0
    (tmp_path / "log").write_text("red fox\n\nquick\n")
    assert [r[0] for r in files.query_log(spark, str(tmp_path / "log")).collect()] == ["red fox", "quick"]
    sinks.record_query(spark, str(tmp_path / "log2"), "red fox")
    assert files.query_log(spark, str(tmp_path / "log2")).count() == 1
    (tmp_path / "stop").write_text("The\n a\n\nof")
    assert files.stopwords(str(tmp_path / "stop")) == {"the", " a", "of"} and files.stopwords("/nowhere") == frozenset()


def test_settings() -> None:
    s = files.settings("; c\n# c\nSCORING = tfidf\nuseStemming=Yes\nmaxThreads=12x\nshardCount=3\nother=1\nnonsense")
    assert (s.scoring, s.use_stemming, s.max_threads, s.shard_count) == ("tfidf", True, 4, 3)


def test_document_table(spark, tmp_path) -> None:
    path = str(tmp_path / "t")
    row = lambda *r: spark.createDataFrame([r], "path string, content string, size_bytes long, mtime long")
    sinks.save_documents(spark, path, row("a", "one", 3, 1))
    sinks.save_documents(spark, path, row("b", "two", 3, 1))
    sinks.save_documents(spark, path, row("a", "three", 5, 2))
    stored = lambda: {(r["path"], r["content"]) for r in sinks.stored_documents(spark, path).collect()}
    assert stored() == {("a", "three"), ("b", "two")}
    for i in range(9):
        sinks.save_documents(spark, path, row("c", str(i), 1, i), most_versions=5)
        assert stored() == {("a", "three"), ("b", "two"), ("c", str(i))} and len(list((tmp_path / "t").glob("version=*"))) < 5


def test_documents_from_a_database(spark) -> None:
    """By one connection, and by several over ranges of the id."""
    url = "jdbc:derby:memory:docs;create=true"
    rows = [(i, f"p{9 - i}", f"text {i}", i, 1000 + i) for i in range(10)]
    spark.createDataFrame(rows, "id long, path string, content string, size_bytes long, mtime long").write.jdbc(url, "documents", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    for options in ({}, {"partitionColumn": "id", "lowerBound": "0", "upperBound": "10", "numPartitions": "3"}):
        got = files.jdbc_documents(spark, url, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", **options).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == [(i, p, s, m, t) for i, p, t, s, m in rows]


def test_metrics(spark) -> None:
    ms = [0, 1, 2, 3, 4, 5, 1023, 1024, 1025, 1 << 40]
    rows = spark.createDataFrame([(m, m % 2 == 0, "bad" if m == 5 else None) for m in ms], "latency_ms long, cache_hit boolean, error string")
    assert {r["bucket"]: r["n"] for r in M.latency_histogram(rows).collect()} == {0: 2, 1: 1, 2: 2, 3: 1, 10: 2, 11: 1, 31: 1}
    one = M.summary(rows).first()
    assert (one["queries"], one["cache_hits"], one["min_latency"], one["max_latency"], one["errors"]) == (10, 5, 1, 1 << 40, 1)
    assert M.summary(rows.limit(0)).first()["cache_hit_rate"] == 0
    n = spark.range(1).selectExpr("7L n")
    assert "query_latency_min_ms 1" in M.prometheus(rows, n).first()[0] and "docs_indexed_total 7\n" in M.prometheus(rows, n).first()[0]
    text = M.report(rows, n).first()[0]
    assert "[latency-buckets (ms): 1=2, 2=1, 4=2, 8=1, 16=0" in text and "2147483648=1]\n" in text and "ERRORS" not in text and "COUNTERS" not in text


def test_written_tables_can_be_cleared(spark) -> None:
    from pathlib import Path

    from tessera import workspace as W

    one, two = W.written(spark.range(5), "one"), W.written(spark.range(6), "two")
    at = lambda: {p.name.split("-")[-2] for p in Path(W.shared_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith(f"tessera-{spark.sparkContext.applicationId}-")}
    assert {"one", "two"} <= at() and one.count() == 5
    W.discard(W.passed_on(one.select("id"), one), one)
    assert "one" not in at() and two.count() == 6
    W.clear(spark)
    assert not at()


def test_lru() -> None:
    c: LRU[int] = LRU(2)
    c.put("a", 1), c.put("b", 2), c.get("a"), c.put("c", 3)
    assert "b" not in c and c.get("a") == 1 and len(c) == 2 and c.hits == 2


def test_page_files_of_repeated_urls(spark, tmp_path) -> None:
    """Pages with one URL, the same or fetched again, give one file, that of the smallest page_id."""
    from tessera import catalog

    rows = [(3, "http://a/", "<p>new</p>"), (1, "http://a/", "<p>old</p>"), (2, "http://b/", "<p>b</p>"), (2, "http://b/", "<p>b</p>"), (4, "http://c/", "<p>c</p>"), (None, "http://a/", "<p>0</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["url"]: r["content"].split() for r in catalog.page_files(spark, str(tmp_path)).collect()}
    assert got == {u: ["URL:", u, w] for u, w in [("http://a/", "old"), ("http://b/", "b"), ("http://c/", "c")]}
    assert catalog.page_files(spark, str(tmp_path)).count() == 3
