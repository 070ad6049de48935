"""The n-gram model against direct counting."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import perplexity as P

DOC = "doc_id long, text string, lang string"


def model(texts: list[str]) -> tuple[dict, dict, dict]:
    """Interpolated modified Kneser-Ney over bytes: probabilities of seen n-grams, back-off weights of contexts, by order."""
    counts: dict[int, Counter] = {P.ORDER: Counter()}
    for t in texts:
        b = b"\n" * (P.ORDER - 1) + t.lower().encode()
        for i in range(P.ORDER, len(b) + 1):
            counts[P.ORDER][b[i - P.ORDER : i]] += 1
    for n in range(P.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    prob: dict[bytes, float] = {}
    back: dict[tuple[int, bytes], float] = {}
    for n in range(1, P.ORDER + 1):
        d = P.discounts(Counter(counts[n].values()))
        cut = lambda c: d[min(c, 3) - 1]  # noqa: B023, E731
        total, mass = Counter(), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            mass[g[:-1]] += min(cut(c), c)
        for h in total:
            back[n, h] = mass[h] / total[h]
        for g, c in counts[n].items():
            below = 1 / 256 if n == 1 else prob[g[1:]]
            prob[g] = max(c - cut(c), 0) / total[g[:-1]] + back[n, g[:-1]] * below
    return prob, back, counts


def log_p(prob: dict, back: dict, g: bytes) -> float:
    if g in prob:
        return math.log(prob[g])
    w = back.get((len(g), g[:-1]))
    below = log_p(prob, back, g[1:]) if len(g) > 1 else -math.log(256)
    return below + (math.log(w) if w else 0.0)


def _texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["ther", "and", "été", "ing", "the", "Stone"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "a" if i % 3 else None) for i, t in enumerate(_texts(60, 1))]


@pytest.mark.parametrize("most", [16_000_000, 400])
def test_perplexity_against_direct_model(spark, rows, most: int) -> None:
    """In one pass, and cut into many."""
    got = {r["doc_id"]: r["perplexity"] for r in P.rated(spark.createDataFrame(rows, DOC), P.Params(part_entries=most)).collect()}
    assert len(got) == len(rows)
    for lang in ("a", None):
        own = [(i, t) for i, t, l in rows if l == lang]
        prob, back, _ = model([t for _, t in own])
        for i, t in own:
            b = b"\n" * (P.ORDER - 1) + t.lower().encode()
            s = sum(log_p(prob, back, b[k - P.ORDER : k]) for k in range(P.ORDER, len(b) + 1))
            assert got[i] == pytest.approx(math.exp(-s / (len(b) - P.ORDER + 1)), rel=1e-3)


def test_parts_are_bounded(spark, rows) -> None:
    """One group of a language and byte is cut further; what every position may back off to is in each part."""
    docs = spark.createDataFrame(rows, DOC)
    table = P.model_table(docs, [None, "a"])
    parts = P._parts(table, 40)
    top = table.where(f"kind = {P.ORDER}")
    assert len(parts) > 5 and sum(p.where(f"kind = {P.ORDER}").count() for p, _ in parts) == top.count()
    largest = max(r["count"] for r in table.where("kind >= 3 and kind < 10").groupBy("l", (table.g / 256).cast("long") % 65536).count().collect())
    assert all(p.where("kind >= 3 and kind <> 10 and kind <> 11").count() <= max(40, 3 * largest) for p, _ in parts)


def test_probabilities_add_up_to_one() -> None:
    prob, back, counts = model(_texts(20, 2))
    for h in list({g[:-1] for g in counts[P.ORDER]})[:20]:
        assert sum(math.exp(log_p(prob, back, h + bytes([x]))) for x in range(256)) == pytest.approx(1, abs=1e-6)


def test_bands_reject_the_odd_ones(spark) -> None:
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["river", "stone", "winter", "garden", "letter", "window"]) for _ in range(400)), "a") for i in range(120)]
    junk = "".join(chr(rng.randint(33, 126)) for _ in range(2500))
    df = spark.createDataFrame([*rows, (900, junk, "a"), (901, "la " * 800, "a")], DOC)
    kept = {r["doc_id"] for r in P.kept(df).collect()}
    assert 900 not in kept and 901 not in kept and len(kept) >= 117


def test_bands_from_clean_documents(spark) -> None:
    """Junk too near to the others for the loose bands goes by those of labelled documents, at the upper end too."""
    rng = random.Random(5)
    prose = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    words = ["river", "stone", "winter", "garden", "letter", "window"]
    rows = [(i, prose(words, 300), "a" if i % 2 else "b") for i in range(500)]
    rows += [(1000 + i, " | ".join(rng.choice(words).upper() + rng.choice("xyz") for _ in range(200)), "a" if i % 2 else "b") for i in range(100)]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([*((i, 1) for i in range(0, 500)), (0, 1), (None, 1), (1000, 0)], "doc_id long, quality int")
    params = P.Params(lower=1000.0, upper=1000.0)
    assert P.kept(df, params).count() == 600
    got = {r["doc_id"] for r in P.kept(df, params, labels).collect()}
    assert not [i for i in got if i >= 1000] and len(got) >= 490
    few = P.kept(df, params, labels.where("doc_id < 150"))  # too few labels: lower and upper stand
    assert few.count() == 600


def test_odd_rows(spark) -> None:
    rows = [(1, None, "a"), (2, "", "a"), (3, "one text", "a"), (None, "no id", "b"), (4, "no language", None), (5, "x" * 3_000_000, "c"), (6, "twice", "d"), (6, "twice", "d")]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 l", "2 s", "3 n", "4 g")
    assert sorted((r["doc_id"] or -1) for r in P.kept(df).collect()) == [-1, 3, 4, 5, 6, 6]
    assert P.kept(df.limit(0)).count() == 0
