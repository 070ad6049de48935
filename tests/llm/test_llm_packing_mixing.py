"""Best-fit packing and entropy balancing."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import mixing, packing

DOC = "doc_id long, text string, lang string, source string"


def count(text: str | None) -> int:
    return text.replace("\n", " ").count(" ") + 1 if text else 0


def _best(lengths: list[int], room: int) -> int:
    return max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= room)


def test_fullest_against_all_subsets() -> None:
    rng = random.Random(0)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        counts, room = Counter(lengths), rng.randint(1, 60)
        used = packing.fullest(sorted(counts), counts, room)
        assert not Counter(used) - counts and sum(used) == _best(lengths, room)


def one_by_one(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins taken one after the other, by the definition."""
    counts, out = Counter(sizes), []
    while +counts:
        used = [max(+counts)]
        counts[used[0]] -= 1
        used += packing.fullest(sorted(+counts), counts, capacity - used[0]) if used[0] < capacity else []
        counts.subtract(used[1:])
        out.append(sorted(used, reverse=True))
    return out


def test_each_bin_has_least_slack() -> None:
    rng = random.Random(1)
    sizes = [rng.randint(1, 40) for _ in range(14)]
    left = list(sizes)
    bins = [lengths for lengths, times in packing.plan(Counter(sizes), 50) for _ in range(times)]
    for used in bins:
        assert used[0] == max(left)
        left.remove(used[0])
        assert sum(used[1:]) == _best(left, 50 - used[0])
        for s in used[1:]:
            left.remove(s)
    assert not left and packing.plan({}, 50) == []


def test_runs_of_equal_bins_against_one_by_one() -> None:
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.choice([rng.randint(1, 64), 7, 7, 33]) for _ in range(rng.randint(0, 900))]
        runs = packing.plan(Counter(sizes), 64)
        assert [lengths for lengths, times in runs for _ in range(times)] == one_by_one(sizes, 64)
    runs = packing.plan({s: 10**12 + s for s in range(1, 2048)}, 2048)  # of any number of documents
    assert sum(n * len(u) for u, n in runs) == sum(10**12 + s for s in range(1, 2048)) and len(runs) < 20_000


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 90)), "en", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (None, "a b c", None, None), (102, "w " * 5000 + "w", "en", "s"), (103, "a b", "en", "s"), (103, "a b", "en", "s"), (104, "a\nb", "en", "s")]
    return spark.createDataFrame(rows, DOC)


def _checked(docs: list[tuple], got: list, capacity: int) -> None:
    """Every token once, bins filled as taken one by one."""
    want, held, pieces = Counter(), Counter(), defaultdict(list)
    for d, t, *_ in docs:
        want[d] += count(t)
    bins, slack, slots = defaultdict(list), {}, defaultdict(list)
    for r in got:
        held[r["doc_id"]] += r["tokens"]
        pieces[r["doc_id"]].append((r["first_token"], r["tokens"]))
        bins[r["bin"]].append(r["tokens"])
        slots[r["bin"]].append(r["slot"])
        slack[r["bin"]] = r["slack"]
    assert +held == +want and all(sum(b) + slack[n] == capacity for n, b in bins.items())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    rest = [count(t) % capacity for _, t, *_ in docs]
    assert Counter(tuple(sorted(b)) for n, b in bins.items() if n[0] == "b") == Counter(tuple(sorted(b)) for b in one_by_one([r for r in rest if r], capacity))
    ids = Counter(d for d, *_ in docs)
    for d, x in pieces.items():
        at = 0
        for first, n in sorted(x) if ids[d] == 1 else []:
            assert first == at
            at += n


def test_bins_against_one_by_one(spark, odd) -> None:
    got = packing.bins(odd, packing.Params(capacity=64)).collect()
    _checked([tuple(r) for r in odd.collect()], got, 64)
    assert not {100, 101} & {r["doc_id"] for r in got} and sum(r["doc_id"] == 103 for r in got) == 2


def test_ties_by_doc_id_of_equal_remainders(spark) -> None:
    df = spark.createDataFrame([(9, "w " * 9 + "w", "e", "s"), (1, "w " * 73 + "w", "e", "s"), (5, "v " * 59 + "v", "e", "s"), (None, "w " * 9 + "w", "e", "s")], DOC)
    rows = {r["doc_id"]: int(r["bin"][1:]) for r in packing.bins(df, packing.Params(capacity=64)).collect() if r["tokens"] == 10}
    first = [d for d, _ in sorted(rows.items(), key=lambda x: (x[1], x[0] is not None, x[0] or 0))]
    assert set(rows) == {9, 1, None} and first[0] is None and rows[1] <= rows[9]


@pytest.mark.parametrize("ids", [None, 4])
def test_bins_of_rows_without_an_id_of_their_own(spark, ids) -> None:
    rng = random.Random(9)
    rows = [(ids, " ".join(["w"] * rng.choice([5, rng.randint(1, 200)])), "e", "s") for _ in range(500)] + [(ids, "same text here", "e", "s")] * 300
    _checked(rows, packing.bins(spark.createDataFrame(rows, DOC).repartition(5), packing.Params(capacity=64)).collect(), 64)


def test_bins_of_an_empty_table(spark, odd) -> None:
    assert packing.bins(odd.limit(0)).count() == 0
    clash = odd.selectExpr("*", "1 rest", "2 tokens", "3 bin", "4 slack", "5 hash", "6 place")
    assert packing.bins(clash, packing.Params(capacity=64)).count() == packing.bins(odd, packing.Params(capacity=64)).count()


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        s, l = rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "de", None])
        rows.append((i, " ".join(["w"] * rng.randint(1, 60)), l, s))
    rows += [(900, None, "en", "a"), (901, "", "en", "zero"), (None, "x y", "en", "b"), (902, "x y", "en", "b"), (902, "x y", "en", "b")]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("targets", [{}, {"a": 0.2, "b": 0.5, "nowhere": 0.3}])
def test_rates_meet_the_constraints_and_tilt_exponentially(mixed, targets) -> None:
    """Both conditions together hold for the one solution of the convex problem only."""
    params = mixing.Params(targets=targets, tolerance=1e-9)
    langs = {r["doc_id"]: r["lang"] for r in mixed.collect()}
    rows = [(r["source"], langs[r["doc_id"]], r["tokens"], r["rate"], r["copies"]) for r in mixing.rates(mixed, params).collect()]
    assert len(rows) == mixed.count()
    now, got, by_lang, got_lang = Counter(), Counter(), Counter(), Counter()
    for s, l, t, w, _ in rows:
        now[s] += t
        got[s] += t * w
        by_lang[l] += t
        got_lang[l] += t * w
    total = sum(now.values())
    share = mixing.target_shares({s: float(x) for s, x in now.items() if x}, params)
    for s, x in share.items():
        assert got[s] / total == pytest.approx(x, abs=2e-5)
    for l in by_lang:
        assert got_lang[l] == pytest.approx(by_lang[l], rel=2e-4)
    slope = defaultdict(set)
    for s, l, t, w, _ in rows:
        if t > 20:
            slope[s, l].add(round(math.log(w) / t, 4))
    level = {k: np.mean(list(v)) for k, v in slope.items()}
    assert all(max(v) - min(v) < 2e-4 for v in slope.values())
    for (s, l), x in level.items():
        for (s2, l2), y in level.items():
            if s != s2 and l != l2 and (s, l2) in level and (s2, l) in level:
                assert x + y == pytest.approx(level[s, l2] + level[s2, l], abs=3e-4)


def test_copies(mixed) -> None:
    rows = {(r["doc_id"], r["source"]): (r["rate"], r["copies"]) for r in mixing.rates(mixed).collect()}
    assert all(math.floor(w) <= c <= math.ceil(w) for w, c in rows.values())
    assert rows[900, "a"] == (1.0, 1) and rows[901, "zero"] == (1.0, 1)
    again = Counter(r["doc_id"] for r in mixing.apply_copies(mixed).collect())
    n = Counter(r["doc_id"] for r in mixed.collect())
    assert all(again[d] == c * n[d] for (d, _), (_, c) in rows.items())
    w, c = sum(x for x, _ in rows.values()), sum(x for _, x in rows.values())
    assert c == pytest.approx(w, rel=0.05)


@pytest.mark.parametrize("ids", ["null", "one", "repeated rows"])
def test_totals_without_an_id_of_their_own(spark, ids: str) -> None:
    """Rows are drawn for one by one, so that tokens come out as asked for."""
    text = lambda i: "same words in all of them" if ids == "repeated rows" else f"{i} " + "w " * (i % 40) + "w"
    rows = [({"null": None}.get(ids, 7), text(i), "e", "ab"[i % 2]) for i in range(6000)]
    params = mixing.Params(targets={"a": 0.31, "b": 0.69})
    got, total = Counter(), sum(count(r[1]) for r in rows)
    for r in mixing.apply_copies(spark.createDataFrame(rows, DOC), params).collect():
        got[r["source"]] += count(r["text"])
    assert got["a"] / total == pytest.approx(0.31, rel=0.03) and got["b"] / total == pytest.approx(0.69, rel=0.02)


def test_newton_with_many_sources() -> None:
    """Sources are eliminated: thousands of them make no large matrix, and the constraints hold."""
    rng = np.random.default_rng(3)
    cells = [(f"s{i}", f"l{l}", float(rng.integers(50, 5000))) for i in range(3000) for l in range(3) if rng.random() < 0.9]
    t, n = np.array([c[2] for c in cells]) / 100, 1.0
    mean = 10.0
    evaluate = lambda x: np.stack([(w := t * np.exp(x * n)), w * n, w * n * n], 1)
    _, found = mixing.solve([(s, l, float(v) * mean) for (s, l, _), v in zip(cells, t)], evaluate, mean, mixing.Params(tolerance=1e-10))
    w = t * np.exp(np.array([x[2] for x in found]) * mean)
    now, got, by_l, was = Counter(), Counter(), Counter(), Counter()
    for (s, l, _), a, b in zip(cells, w, t):
        now[s] += b
        got[s] += a
        by_l[l] += a
        was[l] += b
    share = mixing.target_shares(dict(now), mixing.Params())
    assert all(by_l[l] == pytest.approx(was[l], rel=1e-5) for l in was)
    assert all(got[s] / sum(got.values()) == pytest.approx(share[s], rel=1e-3) for s in now)


def test_clashing_and_empty(spark, mixed) -> None:
    clash = mixed.selectExpr("*", "1 __rate", "2 __copy", "3 m_source", "4 __exponent", "5 __s", "6 __l", "7 m_exponent", "8 __draw")
    got = mixing.apply_copies(clash)
    assert got.columns == clash.columns and got.count() == mixing.apply_copies(mixed).count()
    assert {tuple(r)[4:] for r in got.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}
    assert mixing.rates(mixed.limit(0)).count() == 0 and mixing.apply_copies(mixed.limit(0)).count() == 0
