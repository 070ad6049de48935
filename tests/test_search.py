"""Parser, matching and ranking against direct evaluation of small corpora."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tessera.engine import SearchEngine
from tessera.functions.text import Analyzer
from tessera.operators import index as I
from tessera.operators import rank as R
from tessera.operators import suggest as S
from tessera.operators.snippet import snippets
from tessera.plans import query as Q
from tessera.plans.query import And, Not, Or, Phrase, Term
from tessera.sources import sinks

DOCS = {
    0: "red fox and the quick brown fox",
    1: "quick red car",
    2: "",
    3: "the of and",
    4: "fox of the red quick fox red fox",
    5: None,
    6: "caf\u00e9 red",
    7: "brown brown brown",
    8: "quick red car",
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, f"/docs/{i}.txt", len((t or "").encode()), 1000 + i % 3, t) for i, t in DOCS.items()]
    return I.build(spark.createDataFrame(rows, "doc_id long, path string, size_bytes long, mtime long, content string")).cache()


TOKENS = {i: Analyzer().split(t or "") for i, t in DOCS.items()}
N, AVG = len(DOCS), sum(map(len, TOKENS.values())) / len(DOCS)
DF = Counter(t for x in TOKENS.values() for t in set(x))


def bm25(doc: int, terms: list[str]) -> float:
    out = 0.0
    for t in terms:
        tf = TOKENS[doc].count(t)
        if tf:
            out += math.log(1 + (N - DF[t] + 0.5) / (DF[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(TOKENS[doc]) / AVG))
    return out


def tfidf(doc: int, terms: list[str]) -> float:
    idf = lambda t: math.log((N + 1) / (DF[t] + 1)) + 1
    counts = Counter(TOKENS[doc])
    norm = math.sqrt(sum(((1 + math.log(n)) * idf(t)) ** 2 for t, n in counts.items())) or 1.0
    return sum((1 + math.log(counts[t])) * idf(t) for t in terms if counts[t]) / norm


def holds(node, tokens: list[str]) -> bool:
    if isinstance(node, Term):
        return node.text in tokens
    if isinstance(node, Phrase):
        n = len(node.words)
        return n > 0 and any(tuple(tokens[i : i + n]) == node.words for i in range(len(tokens)))
    if isinstance(node, Not):
        return not holds(node.child, tokens)
    left, right = holds(node.left, tokens), holds(node.right, tokens)
    return left and right if isinstance(node, And) else left or right


a, b, c = Term("a1"), Term("b1"), Term("c1")


@pytest.mark.parametrize(
    "query, tree",
    [
        ("a1 b1", None), ("a1 NOT b1", None), ("a1 b1 AND c1", None), ("( a1", None), ("( a1 AND b1", None), ("a1 AND ( b1", None), ("a1 AND", None), ("", None),
        ("a1 AND (", And(a, Term("("))), ("NOT (", Not(Term("("))), ("a1 b1 AND", And(a, b)), ("AND a1 b1", And(a, b)), ("a1 NOT", Not(a)), ("a1 ) and b1", And(a, b)),
        ("NOT NOT a1", Not(Not(a))), ("NOT a1 AND b1", And(Not(a), b)), ("a1 OR b1 AND c1", Or(a, And(b, c))), ("(a1 OR b1) AND NOT c1", And(Or(a, b), Not(c))),
        ('"a1 b1"', Phrase(("a1", "b1"))), ('""', Phrase(())), ('"a1', Term("a1")), ("full-text", Term("full")), ("C++", Term("c")), ("the", Term("the")), ('x"y', Term("x")),
    ],
)
def test_parser(query: str, tree) -> None:
    assert Q.parse(query) == tree


def _random_tree(rng: random.Random, depth: int):
    words = ["red", "fox", "quick", "brown", "car", "caf", "nothere"]
    kind = rng.choice(["term", "phrase"] if depth == 0 else ["term", "phrase", "not", "and", "or"])
    if kind == "term":
        return Term(rng.choice(words))
    if kind == "phrase":
        return Phrase(tuple(rng.choice(words) for _ in range(rng.randint(0, 3))))
    if kind == "not":
        return Not(_random_tree(rng, depth - 1))
    return (And if kind == "and" else Or)(_random_tree(rng, depth - 1), _random_tree(rng, depth - 1))


def test_random_trees(index) -> None:
    rng = random.Random(3)
    for _ in range(25):
        tree = _random_tree(rng, 3)
        got = sorted(r[0] for r in Q.match(tree, index.postings, index.docs).collect())
        assert got == [i for i in DOCS if holds(tree, TOKENS[i])], tree


def test_phrases_pass_over_stopwords(index) -> None:
    assert [r[0] for r in Q.match(Q.parse('"fox quick brown"'), index.postings, index.docs).collect()] == [0]


def test_statistics(index) -> None:
    assert tuple(index.stats.first()) == (N, pytest.approx(AVG))
    assert {r["term"]: r["df"] for r in index.vocab.collect()} == DF


@pytest.mark.parametrize("terms", [["red"], ["red", "fox", "red"], ["brown", "missing"], ["missing"], []])
def test_scores(index, terms: list[str]) -> None:
    for ours, direct in ((R.score_bm25, bm25), (R.score_tfidf, tfidf)):
        got = {r[0]: r[1] for r in ours(index, terms).collect()}
        want = {i: direct(i, terms) for i in DOCS if set(terms) & set(TOKENS[i])}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_search_modes_and_ties(index) -> None:
    ids = lambda *x: [r["doc_id"] for r in R.search(index, *x).collect()]
    best = sorted((i for i in DOCS if {"red", "car"} & set(TOKENS[i])), key=lambda i: (-round(bm25(i, ["red", "car"]), 9), i))
    assert ids("red car", 10) == best  # 1 and 8 are equal
    assert ids("red car", 10, "date") == sorted(best, key=lambda i: (-(1000 + i % 3), i))
    assert ids("red car", 10, "size") == sorted(best, key=lambda i: (-len(DOCS[i].encode()), i))
    assert ids("NOT red", 100) == [i for i in DOCS if "red" not in TOKENS[i]]
    scored = R.score_bm25(index, ["red", "car"])
    assert [r["doc_id"] for r in R.page(scored, 2, len(best), 2).collect()] == best[2:4]
    assert [r["doc_id"] for r in R.page(scored, 99, len(best), 4).collect()] == best[4:]
    assert [r["doc_id"] for r in R.sharded_top(scored, index.docs, 3, 4).collect()] == best[:4]


def test_suggestions(index) -> None:
    assert [r["term"] for r in S.autocomplete(index.vocab, "c", 5).collect()] == ["car", "caf"]
    assert [(r["term"], r["distance"]) for r in S.spelling(index.vocab, "rad", 1).collect()] == [("red", 1)]
    assert {(r["kind"], r["term"]) for r in S.assistant(index.vocab, ["ca"]).collect()} == {("correction", "car"), ("correction", "caf"), ("completion", "car"), ("completion", "caf")}
    assert S.last_word("a bc") == "bc" and S.last_word("a b") is None


def test_gaps_round_trip(index) -> None:
    gapped = I.gaps(index.postings.select("term", "doc_id")).withColumnRenamed("doc_id", "o")
    back = I.ungapped(gapped, "o")
    assert back.where("doc_id <> o").count() == 0 and back.count() == index.postings.count()


def test_snippets(spark) -> None:
    long = "x " * 200 + "Needle and more needle " + "y " * 300 + "needle thread " + "z " * 300
    rows = spark.createDataFrame([(0, long), (1, ""), (2, None), (3, "no hit " * 60), (4, "needle")], "doc_id long, content string")
    got = {r[0]: r[1] for r in snippets(rows, ["needle", "thread"]).collect()}
    assert "needle thread" in got[0] and got[0].startswith("...") and got[0].endswith("...") and len(got[0]) < 450
    assert got[1] == "[empty document]" and got[2] == "[file no longer available]" and got[3] == ("no hit " * 60)[:200] + "..." and got[4] == "needle"


def test_save_and_load(spark, index, tmp_path) -> None:
    I.save(index, str(tmp_path / "i"), 2)
    again = I.load(spark, str(tmp_path / "i"))
    for t in ("docs", "postings", "vocab", "stats"):
        ours, theirs = getattr(index, t), getattr(again, t)
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.select(*ours.columns).collect()))
    plan = again.postings.where("term = 'red'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,red)]" in plan
    spark.range(1).selectExpr("1L n", "1D avgdl", "9 format_version").write.parquet(str(tmp_path / "j/stats"))
    with pytest.raises(ValueError):
        I.load(spark, str(tmp_path / "j"))


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(i, f"/docs/{i}.txt", len((t or "").encode()), 1000 + i % 3, t) for i, t in DOCS.items()]
    return SearchEngine.build(spark, spark.createDataFrame(rows, "doc_id long, path string, size_bytes long, mtime long, content string"))


def _scans(df) -> tuple[int, int]:
    """How often a plan reads the postings and the documents."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"Relation \[term#\d+,doc_id#", plan)), len(re.findall(r"Relation \[doc_id#", plan))


def test_ranking_reads_postings_once_and_no_documents(engine) -> None:
    i = engine.index
    for df in (R.score_bm25(i, ["red", "fox"]), R.score_tfidf(i, ["red", "fox"]), R.match_scored(i, Q.parse("red AND fox"), ["red", "fox"]), Q.match(Q.parse("red AND NOT fox"), i.postings, i.docs)):
        assert df.collect() and _scans(df) == (1, 0)
        assert "PushedFilters: [In(term, [fox,red])" in df._jdf.queryExecution().executedPlan().toString()


def test_scores_of_a_stored_index(engine, index) -> None:
    for ours, direct in ((R.score_bm25, bm25), (R.score_tfidf, tfidf)):
        got = {r[0]: r[1] for r in ours(engine.index, ["red", "fox", "red"]).collect()}
        assert all(got[i] == pytest.approx(direct(i, ["red", "fox", "red"])) for i in got) and len(got) == 5
    got = {r[0]: r[1] for r in R.match_scored(engine.index, Q.parse("red OR NOT brown"), ["red", "brown"]).collect()}
    want = {i: bm25(i, ["red", "brown"]) for i in DOCS if "red" in TOKENS[i] or "brown" not in TOKENS[i]}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert R.match_scored(engine.index, Q.parse('NOT "the"'), []).count() == len(DOCS)


def test_bm25_guards(spark) -> None:
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[R.bm25(F.lit(2), F.lit(3), F.lit(df), F.lit(10), F.lit(avg)) for df, avg in ((0, 1.0), (1, 0.0), (1, 2.0))]).first()
    assert row[0] == 0 and all(math.isfinite(x) for x in row) and row[1] < row[2]


def test_pages_go_over_all_matches(spark) -> None:
    rows = [(i, f"/docs/{i}.txt", i, 1000 + i, f"word{i} same") for i in range(230)]
    e = SearchEngine.build(spark, spark.createDataFrame(rows, "doc_id long, path string, size_bytes long, mtime long, content string"))
    ids = lambda *x, **k: [h.doc_id for h in e.page(*x, **k)]
    assert ids("NOT zzzz", 1) == list(range(10)) and ids("NOT zzzz", 15) == list(range(140, 150)) and ids("NOT zzzz", 99) == list(range(220, 230))
    assert ids("NOT zzzz", 1, 10, "date") == list(range(229, 219, -1))
    assert ids("same other", 20) == list(range(190, 200)) and ids("same other", 21) == ids("same other", 20)  # a ranked OR: 200
    assert e.page("NOT zzzz", 2)[0].snippet and ids("nowhere AND same", 3) == []


def test_facade(spark, engine, tmp_path, caplog) -> None:
    e = SearchEngine(spark, engine.index, documents=str(tmp_path / "d"), index_path=str(tmp_path / "i"))
    first, again = e.search("red car", 3), e.search("red car", 3)
    assert not first.cache_hit and again.cache_hit and [h.doc_id for h in first.results] == [h.doc_id for h in again.results]
    assert not e.search("red AND car", 3).cache_hit  # another tree, another entry
    assert '"docID"' in first.to_json() and first.results[0].snippet
    assert e.popular()[0] == ("red car", 2) and e.suggest("red A") == ["red AND car"]
    e.prewarm(k=3)
    assert len(e.log) == len(e.requests) == 3 and e.search("red car", 3).cache_hit
    assert e.document(1)["content"] == "quick red car" and e.document(99) is None
    assert e.autocomplete("CA", lower=True) == ["car", "caf"] and e.autocomplete("CA") == []
    e.count("uses", 2), e.count("uses"), e.gauge("load", 0.5), e.gauge("load", 0.25), e.error("disk", "full")
    assert e.stats()["queries"] == 4 and "query_total 4" in e.metrics() and "docs_indexed_total 9\ncounter_uses 3\ngauge_load 0.25\n" in e.metrics()
    assert e.health() == '{"status":"ok","docs":9,"queries":4,"errors":0}'
    assert "queries=4, cacheHits=2" in e.report() and "RECENT ERRORS:\n  [disk] full\nCOUNTERS: { uses=3 }\nGAUGES: { load=0.25 }\n" in e.report()
    with pytest.raises(ValueError):
        e.search("x" * 1001)
    broken = SearchEngine(spark, engine.index)
    broken.index = I.Index(None, None, None, None, Analyzer())
    with pytest.raises(AttributeError):
        broken.search("red")
    assert broken.requests[-1][2] == "search" and broken.events[-1][1] == "search"


def test_rebuild_update_and_remove(spark, tmp_path) -> None:
    rows = [(i, f"/docs/{i}.txt", 1, 1000, f"red word{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, size_bytes long, mtime long, content string")
    e = SearchEngine.build(spark, docs, documents=str(tmp_path / "d"), index_path=str(tmp_path / "i"))
    table = lambda: {r["path"]: r["content"] for r in sinks.stored_documents(spark, str(tmp_path / "d")).collect()}
    assert e.rebuild(docs)["docs"] == 6 and table() == {r[1]: r[4] for r in rows}
    lengths = []
    for n in range(5):  # however often it is updated, its plan stays what it was
        snapshot = docs.select("path", "size_bytes", "mtime", "content").where(f"path <> '/docs/{n}.txt'").union(spark.createDataFrame([("/docs/new.txt", 1, 2000 + n, f"red new{n}")], "path string, size_bytes long, mtime long, content string"))
        counts = e.update(snapshot)
        assert counts["removed"] == 1 and counts["added"] >= 1
        lengths.append(len(e.index.postings._jdf.queryExecution().analyzed().toString()))
        assert {h.doc_id for h in e.search(f"new{n}").results} and not e.search("new9").results
    assert max(lengths) == min(lengths)
    assert table()["/docs/new.txt"] == "red new4" and I.load(spark, str(tmp_path / "i")).docs.count() == 6
    assert e.update(snapshot) == {"added": 0, "removed": 0, "modified": 0}
    gone = e.search("word1").results[0].doc_id
    e.remove([gone])
    assert not e.search("word1").results and e.index.docs.count() == 5
    pages = spark.createDataFrame([("http://h/", '<p>crawled start</p><a href="/a">a</a>'), ("http://h/a", "<p>crawled next</p>")], "url string, html string")
    assert e.crawl(pages, ["http://h/"])["added"] == 2 and len(e.search("crawled").results) == 2 and "/crawled/http___h_.txt" in table()


def test_shards(spark, index, tmp_path) -> None:
    """Each document is in the shard of its path, with its postings; together they are the index, and so are merged results."""
    I.save_shards(index, str(tmp_path / "s"), 3)
    assert {p.name for p in (tmp_path / "s/postings").iterdir() if "=" in p.name} <= {"shard=0", "shard=1", "shard=2"}
    whole = I.load_shards(spark, str(tmp_path / "s"))
    rows = lambda t: sorted(map(str, t.collect()))
    assert rows(whole.postings) == rows(index.postings.select(*whole.postings.columns)) and rows(whole.docs.select("doc_id")) == rows(index.docs.select("doc_id"))
    parts = [I.load_shards(spark, str(tmp_path / "s"), only=[n]) for n in range(3)]
    merged = sorted((-r[1], r[0]) for p in parts for r in R.top(R.score_bm25(p, ["red", "fox"]), 2).collect())[:2]
    assert [d for _, d in merged] == [r[0] for r in R.top(R.score_bm25(index, ["red", "fox"]), 2).collect()]
    assert sum(p.docs.count() for p in parts) == len(DOCS)


def test_logs(tmp_path) -> None:
    import time

    from tessera import logs

    log = logs.set_up(str(tmp_path / "log"), "warn", console=False)
    log.info("not this"), log.warning("this")
    logs.set_up(str(tmp_path / "log"), "info", console=False)
    p = logs.Periodic(lambda: "a report", 0.05).start()
    time.sleep(0.3)
    p.stop()
    lines = (tmp_path / "log").read_text()
    assert "[WARNING] this" in lines and "not this" not in lines and lines.count("METRICS:\na report") >= 2
    logs.set_up("/nowhere/at/all", console=False)
    logs.set_up(console=False)
