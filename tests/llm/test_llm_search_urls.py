"""Bit-sliced top-k and the URL filter."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitsliced as B
from tessera.llm import urlfilter as U

VEC = "vec_id long, embedding array<float>"


def nearest(rows: list[tuple[int, list[float]]], k: int) -> set[tuple]:
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float32).astype(float)
    x = x / np.sqrt((x**2).sum(1))[:, None]
    s = np.round(x @ x.T, 9)
    out = set()
    for a, i in enumerate(ids):
        best = sorted(((-s[a, b], j) for b, j in enumerate(ids) if j != i))[:k]
        out |= {(i, r, j, round(float(-v), 7)) for r, (v, j) in enumerate(best, 1)}
    return out


def test_slice_arithmetic() -> None:
    rng = np.random.default_rng(0)
    v = rng.integers(0, 50, (130, 7))
    s = B._slices(v, 6)
    parts = [[] for _ in range(6)]
    for j in range(7):
        for b in range(6):
            parts[b].append(s[j, b])
    total = B.add_slices(parts)
    rows = B._slices(np.ones((130, 1), np.int64), 1)[0, 0]
    bits = np.array([np.unpackbits(t.view(np.uint8), bitorder="little")[:130] for t in total])
    assert ((bits * (1 << np.arange(len(bits)))[:, None]).sum(0) == v.sum(1)).all()
    for k in (1, 5, 130):
        assert B.kth_largest(total, rows, k) == np.sort(v.sum(1))[-k]
    for least in (0, 100, 170, 10_000):
        assert (np.unpackbits(B.at_least(total, rows, least).view(np.uint8), bitorder="little")[:130] == (v.sum(1) >= least)).all()


@pytest.mark.parametrize("params", [B.Params(), B.Params(k=3, bits=3, weight_bits=2, rows_per_block=40, queries_per_block=30)])
def test_against_all_pairs(spark, params) -> None:
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(y)) for y in rng.normal(size=12)]) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]  # ties
    got = {(*r[:3], round(r[3], 7)) for r in B.top_k(spark.createDataFrame(rows, VEC), params).collect()}
    assert got == nearest(rows, params.k)


def test_some_ask_all_answer(spark) -> None:
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(y)) for y in rng.normal(size=8)]) for i in range(120)]
    params = B.Params(k=4, rows_per_block=50, queries_per_block=3)
    got = {(*r[:3], round(r[3], 7)) for r in B.top_k(spark.createDataFrame(rows, VEC), params, F.col("vec_id") % 20 == 0).collect()}
    assert got == {r for r in nearest(rows, 4) if r[0] % 20 == 0}


def test_odd_vectors(spark) -> None:
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [0.5, 1.0, 0.0]), (10, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 dim", "2 b", "3 q", "4 v")
    assert {(r["vec_id"], r["neighbor_id"]) for r in B.top_k(df).collect()} == {(1, 2), (2, 1), (8, 9), (9, 8)}
    assert B.top_k(df.limit(0)).count() == 0


def _canonical(url: str) -> str:
    import re

    bare = re.sub("#.*$", "", url)
    bare = re.sub("^[A-Za-z][A-Za-z0-9+.-]*://", "", bare)
    host = re.match("[^/?]*", bare)[0]
    rest = bare[len(host) :]
    path, _, query = rest.partition("?")
    query = re.sub("^&+", "", re.sub("(^|&)(utm_[a-z]*|ref)=[^&]*", "", query))
    host = re.sub(":(80|443)$", "", re.sub("^(www|m)[.]", "", host.lower()))
    return host + re.sub("([.]html?|/)+$", "", path) + ("?" + query if query else "")


URLS = ["http://www.A.com:80/x/", "https://a.com/x.html#top", "A.com/x?utm_source=q&ref=1", "http://a.com/X", "http://b.org", "http://b.org/?a=1&utm_x=2&b=3", "m.b.org//", "", "???"]


def test_canonical(spark) -> None:
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, url string").orderBy("i")
    got = [r[0] for r in rows.select(U.canonical(F.col("url"))).collect()]
    assert got == [_canonical(u) for u in URLS] and got[0] == got[1] == got[2] == "a.com/x"


@pytest.mark.parametrize("params", [U.Params(), U.Params(bits_per_key=1), U.Params(broadcast_blocks=0)])
def test_listed_against_sets(spark, params) -> None:
    """Also with a filter so small that nearly everything passes it."""
    bad = [f"http://www.site{i}.com/p/{i}.html" for i in range(0, 900, 3)]
    pages = [(i, f"https://site{i % 1000}.com/p/{i % 1000}/") for i in range(2000)]
    want = {_canonical(u) for u in bad}
    got = U.listed(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(u,) for u in bad], "url string"), params)
    assert {r["page_id"] for r in got.collect()} == {i for i, u in pages if _canonical(u) in want}


def test_filter_has_no_false_negatives_and_few_false_positives(spark) -> None:
    keys = spark.range(5000).selectExpr("concat('k', id) key")
    assert U.possible(keys.withColumnRenamed("key", "k"), "k", keys).count() == 5000
    assert U.possible(spark.range(20_000).selectExpr("concat('other', id) k"), "k", keys).count() < 100


def test_odd_urls(spark) -> None:
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "http://a/x"), (3, "http://a/x"), (4, "http://a/" + "y" * 1_000_000)], "page_id long, url string").selectExpr("*", "1 key", "2 __key", "3 __block", "4 __w0", "5 canonical_url")
    lists = spark.createDataFrame([(None,), ("a/x.html",), ("a/x",), ("a/" + "y" * 1_000_000,)], "url string")
    got = U.listed(pages, lists)
    assert sorted(r["page_id"] for r in got.collect()) == [3, 3, 4]
    assert got.columns[: len(pages.columns)] == pages.columns and len(set(got.columns)) == len(got.columns)
    assert got.first()["__block"] == 3 and got.first()["canonical_url"] == 5
    assert U.listed(pages, lists.limit(0)).count() == 0 and U.listed(pages.limit(0), lists).count() == 0
