from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import web as W
from tessera.functions.text import Analyzer

_words = st.lists(st.text(alphabet="aAbing edlys019é\u212a\u0130-_\n\"", max_size=40), min_size=1, max_size=30)


def _column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_words)
def test_column_and_driver_tokens_agree(spark, texts) -> None:
    for analyzer in (Analyzer(), Analyzer(stemming=True), Analyzer(stopwords=frozenset())):
        assert _column(spark, texts, analyzer.tokens) == [analyzer.split(t) for t in texts]


def test_tokens(spark) -> None:
    a = Analyzer()
    assert a.split("The Caf\u00e9's C++ full-text a1B2") == ["caf", "s", "c", "full", "text", "a1b2"]
    assert a.split("x\u212ay") == ["x", "y"]  # the Kelvin sign is no letter here
    assert _column(spark, [None, ""], a.tokens) == [[], []]


def test_stem(spark) -> None:
    pairs = {"running": "runn", "king": "king", "sing": "sing", "walked": "walk", "red": "red", "slowly": "slow", "boxes": "box", "yes": "yes", "cats": "cat", "gas": "gas", "ings": "ing"}
    assert {k: X.stem_word(k) for k in pairs} == pairs
    assert _column(spark, list(pairs), X.stem) == list(pairs.values())


def test_sanitize(spark) -> None:
    texts = ["a\tb\nc\u00e9d\x00", "x" * 600, ""]
    assert _column(spark, texts, X.sanitize) == [X.sanitize_text(t) for t in texts] == ["a b cd", "x" * 512, ""]
    assert _column(spark, ["\u00e9" * 500, "\u00e9" * 501], X.valid_query) == [True, False]


def test_display(spark) -> None:
    assert _column(spark, ["/a/b/https___x.org_p.txt", "plain.txt", "/a/.txt", "/a/b"], X.display_path) == ["https://x.org_p", "plain.txt", ".txt", "b"]
    assert _column(spark, ["a <b> & \"c\" 'd'"], X.html_escape) == ["a &lt;b&gt; &amp; &quot;c&quot; &#39;d&#39;"]
    assert _column(spark, ["ther and Than"], lambda c: X.highlight(c, "than OR ther")) == ["<mark>ther</mark> and <mark>Than</mark>"]
    assert _column(spark, ["a"], lambda c: X.highlight(c, "AND not")) == ["a"]


def test_base64url_round_trip(spark) -> None:
    values = [bytes(range(n)) for n in range(8)] + [b"\xff\xfe\xfd"]
    coded = _column(spark, values, X.base64url, "binary")
    assert not any(set(c) & set("+/=") for c in coded)
    assert [bytes(x) for x in _column(spark, coded, X.unbase64url)] == values


def test_html(spark) -> None:
    pages = ["<p>a&amp;b</p>", "x<script>var a = '<b>';</script>y", "a<style>p{}</style >b", "a  \n b>c", "cut <a href", "<script>never closed", None]
    assert _column(spark, pages, W.html_text) == [" a&amp;b ", "x y", "a b", "a b c", "cut ", " ", None]
    html = '<a href="/x">1</a><a href="">2</a><a href="#f">3</a><a href="mailto:q">4</a><a HREF="/no">5</a><a href="http://h/y">6</a>'
    assert _column(spark, [html], W.links) == [["/x", "http://h/y"]]


def test_urls(spark) -> None:
    urls = ["http://h.org/a?b", "https://h.org", "h.org/a", "http:///a", "ftp://u:1/x://y"]
    assert [None if r is None else tuple(r) for r in _column(spark, urls, W.url_parts)] == [("http", "h.org", "/a?b"), ("https", "h.org", "/"), None, None, ("ftp", "u:1", "/x://y")]
    links = ["", "#a", "http://z/q", "/r", "s/t"]
    assert _column(spark, links, lambda c: W.resolve(c, F.lit("https"), F.lit("h"))) == [None, None, "http://z/q", "https://h/r", None]
    assert _column(spark, ["http://h/a?b=c&d#e"], W.file_name) == ["http___h_a_b_c_d_e"]
    assert len(_column(spark, ["x" * 300], W.file_name)[0]) == 120
