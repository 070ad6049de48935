"""Maximum-scoring segments and toxic documents."""

from __future__ import annotations

import itertools
import math
import random

import pyarrow as pa
import pytest

from tessera.llm import toxicity as T


def direct(scores: list[float]) -> list[tuple[int, int]]:
    """The maximal scoring subsequences by their recursive definition: the best segment, then left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    sums = [0.0, *itertools.accumulate(scores)]
    best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = -best[2], -best[2] - best[1]
    return [*direct(scores[:i]), (i, j - 1), *[(a + j, b + j) for a, b in direct(scores[j:])]]


def test_segments_against_definition() -> None:
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 30)
        at = sorted(rng.sample(range(60), min(n, 12)))
        gain = [rng.uniform(0.3, 4) for _ in at]
        drift = rng.uniform(0.05, 1.2)
        line = [-drift] * 60
        for p, x in zip(at, gain):
            line[p] = x
        got = [(at[a], at[b], round(s, 6)) for a, b, s in T.maximal_segments(gain, at, drift)]
        assert got == [(a, b, round(sum(line[a : b + 1]), 6)) for a, b in direct(line)]


def test_segments_in_linear_time() -> None:
    """Of tokens far apart, close together, and in long climbs: ten times the tokens, about ten times the time."""
    import time

    def took(n: int, gap: int, gain: list[float]) -> float:
        began = time.process_time()
        found = T.maximal_segments(gain * (n // len(gain)), list(range(0, n * gap, gap)), 0.5)
        assert found
        return time.process_time() - began

    for gap, gain in ((50, [3.0]), (2, [3.0]), (7, [3.0]), (7, [3.0, 2.9, 3.2, 2.5]), (8, [1.0, 9.0])):
        small = min(took(100_000, gap, gain) for _ in range(2))
        assert took(1_000_000, gap, gain) < 25 * small


def test_log_odds_with_dirichlet_prior() -> None:
    """Of presence in documents, less the standard error, from counts made with sets."""
    toxic = [f"vrenk skoll word{i} other{i}" for i in range(30)] + [f"quiet word{i} lines{i}" for i in range(10)]
    clean = [f"quiet harmless skoll word{i} lines{i} more{i}" for i in range(5)] + [f"calm harmless water{i} lines{i} more{i}" for i in range(85)]
    p = T.Params(prior_documents=10.0, z=1.0, least_score=-100.0)
    model = T.fit_texts(toxic, clean, p)
    hasher = T.Hasher()
    toxic, clean = T._distinct(toxic, hasher), T._distinct(clean, hasher)
    n_t, n_c = len(toxic), len(clean)
    for word in ("vrenk", "skoll", "quiet", "harmless"):
        raw = T.np.frombuffer(word.encode(), T.np.uint8)
        key = T._tokens(raw, T.np.array([0, len(raw)]), hasher)[0][0]
        y_t, y_c = (sum(word in t.split() for t in x) for x in (toxic, clean))
        found = model.scores[model.keys == key]
        if not y_t:
            assert not len(found)
            continue
        prior = 10 * (y_t + y_c) / (n_t + n_c)
        odds = lambda y, n: math.log((y + prior) / (n + 10 - y - prior))  # noqa: E731, B023
        assert found[0] == pytest.approx(odds(y_t, n_t) - odds(y_c, n_c) - math.sqrt(1 / (y_t + prior) + 1 / (y_c + prior)))


def test_beginnings_are_letters() -> None:
    hasher = T.Hasher()
    of = lambda t: T._tokens(T.np.frombuffer(t.encode(), T.np.uint8), T.np.array([0, len(t.encode())]), hasher)[1].tolist()
    assert of("éééa ééé éééaxx éééb") == [of("éééa")[0], 0, of("éééa")[0], of("éééb")[0]] and of("éééa")[0] != of("éééb")[0]
    assert of("straßen")[0] == of("strahl")[0] and of("漢字漢字漢")[0] == of("漢字漢字")[0] != 0


def test_lambda_and_k() -> None:
    """lambda: the characteristic equation; K: with it, the law fits the best segments of simulated clean texts."""
    import numpy as np

    rng = np.random.default_rng(3)
    values, rate, drift = np.array([2.0, 3.0, 5.0]), 0.01, 0.08
    lam = T._root(values, rate, drift)
    assert rate * np.exp(lam * values).mean() + (1 - rate) * math.exp(-lam * drift) == pytest.approx(1, abs=1e-9) and lam > 0
    k = T._scale(values, rate, drift, lam, 5)
    tops, n = [], 20_000
    for _ in range(150):
        line = np.where(rng.random(n) < rate, rng.choice(values, n), -drift)
        sums = np.concatenate([[0], np.cumsum(line)])
        tops.append((sums - np.minimum.accumulate(sums)).max())
    level = float(np.median(tops))
    assert 1 - math.exp(-k * n * math.exp(-lam * level)) == pytest.approx(0.5, abs=0.15)


def test_sum_statistics() -> None:
    """The r best segments' sum against simulation of their law, halved for every r tried."""
    import numpy as np

    rng = np.random.default_rng(4)
    lam, k, words = 0.7, 0.2, 1000
    base = math.log(k * words)
    assert T.sum_p([], words, lam, k) == 1
    for x in (2.0, 5.0):
        assert T.sum_p([(x + base) / lam], words, lam, k) == pytest.approx(2 * (1 - math.exp(-math.exp(-x))))
    arrivals = -np.log(np.cumsum(rng.exponential(size=(200_000, 2)), axis=1))  # the two best of a text, in normal form
    t = 7.0
    share = (arrivals.sum(1) >= t).mean()
    assert T.sum_p([(t / 2 + base) / lam] * 2, words, lam, k) == pytest.approx(min(4 * share, 2 * (1 - math.exp(-math.exp(-t / 2)))), rel=0.35)


CLEAN = "river stone winter garden letter window table candle morning harbour silver forest bridge market paper yellow".split()
TOXIC = "vrenk skoll grubnar zlatch mordug".split()


def _text(rng: random.Random, toxic: bool) -> str:
    words = [rng.choice(CLEAN) for _ in range(rng.randint(30, 300))]
    if toxic:
        at = rng.randrange(len(words))
        words[at:at] = [rng.choice(TOXIC) for _ in range(rng.randint(6, 15))]
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    rows = [(i, _text(rng, i % 5 == 0)) for i in range(1600)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1200)], "doc_id long, toxic int")


def test_held_out(tables) -> None:
    docs, labels = tables
    model = T.fit(docs, labels)
    found = T.passages(docs, model).collect()
    caught = {r["doc_id"] for r in found}
    toxic = {i for i in range(1600) if i % 5 == 0}
    held = lambda s: {i for i in s if i >= 1200}
    assert len(held(caught & toxic)) >= 0.95 * len(held(toxic)) and len(caught - toxic) <= 5
    assert {r["doc_id"] for r in T.keep_clean(docs, model).collect()} == set(range(1600)) - caught
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for r in found:
        inside = texts[r["doc_id"]][r["first_word"] : r["last_word"] + 1]
        assert inside[0] in TOXIC and inside[-1] in TOXIC


def test_batches_and_single_rows_agree(tables) -> None:
    docs, labels = tables
    scorer = T.Scorer(T.fit(docs, labels))
    texts = [r["text"] for r in docs.limit(80).collect()] + [None, ""]
    whole = {row: (p, x) for row, p, x in scorer.documents(pa.array(texts, pa.string()))}
    for i, t in enumerate(texts):
        alone = {row: (p, x) for row, p, x in scorer.documents(pa.array([t], pa.string()))}
        assert alone.get(0) == whole.get(i)


def test_odd_rows(spark, tables) -> None:
    docs, labels = tables
    model = T.fit(docs, labels.union(spark.createDataFrame([(None, 1), (3, None), (9999, 1), (5, 0), (5, 1)], "doc_id long, toxic int")))
    rows = [(None, "vrenk skoll grubnar zlatch mordug vrenk vrenk skoll"), (1, None), (2, ""), (3, "..."), (4, "stone " * 400_000 + "vrenk skoll " * 30), (5, "vrenk skoll " * 20), (5, "vrenk skoll " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 toxic", "2 o", "3 passage")
    found = T.passages(df, model).collect()
    assert [r["doc_id"] for r in found].count(5) == 2 and {r["doc_id"] for r in found} >= {4, 5}
    kept = T.keep_clean(df, model)
    assert kept.columns == df.columns and {1, 2, 3} <= {r["doc_id"] for r in kept.collect()} and 5 not in {r["doc_id"] for r in kept.collect()}
    assert T.passages(df.limit(0), model).count() == 0
    many = docs.unionByName(docs.where("doc_id = 0").crossJoin(spark.range(3000)).selectExpr("doc_id", "concat(text, ' vrenk ', id) text"))
    again = T.fit(many, labels)  # one labelled doc_id, thousands of texts: one of them is fitted on
    assert len(again.keys) and abs(len(again.keys) - len(T.fit(docs, labels).keys)) < 20
    none = T.fit(docs, labels.where("toxic = 0"))
    assert T.passages(docs, none).count() == 0 and T.keep_clean(docs, none).count() == 1600
    assert T.passages(docs, T.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_fit_takes_every_labelled_document(spark) -> None:
    """Against a fit on lists of all labelled texts, more than 2,500 toxic and 5,000 clean ones, near copies among them."""
    from pyspark.sql import functions as F

    rng = random.Random(14)
    rare = [f"rare{chr(97 + i)}x" for i in range(20)]
    rows = []
    for i in range(9000):
        words = [rng.choice(CLEAN) + str(rng.randrange(50)) for _ in range(rng.randint(8, 14))]
        words += [rng.choice(TOXIC + rare)] * (i % 3 == 0) + [rng.choice(TOXIC)] * (i % 200 == 1)
        rows.append((i, " ".join(words)))
    rows += [(9000 + i, f"{rows[3 * i][1]} vrenk") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i >= 9000 or i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    order = {r[0]: r[1] for r in docs.select("doc_id", T.unit_hash(F.col("doc_id"), T.Params().seed)).collect()}
    rows.sort(key=lambda r: order[r[0]])
    kinds = [[t for i, t in rows if (i >= 9000 or i % 3 == 0) == kind] for kind in (True, False)]
    want = T.fit_texts(*kinds)
    for p in (T.Params(), T.Params(held_labels=5000)):  # held by each worker, and joined
        got = T.fit(docs, labels, p)
        assert len(got.keys) and got.keys.tolist() == want.keys.tolist()
        assert got.scores == pytest.approx(want.scores) and (got.drift, got.lam, got.k) == pytest.approx((want.drift, want.lam, want.k))
