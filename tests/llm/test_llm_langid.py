"""String kernels: against sets of n-grams, and on held-out texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF

from tessera.llm import langid as L

WORDS = {
    "aa": "the and thing water where house river stone with other".split(),
    "bb": "der und wasser haus schnell zwischen straße über nicht ein".split(),
    "cc": "el agua casa río piedra con otro señor mañana donde".split(),
}


def _rows(n: int, seed: int) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((lang, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 60)))))
    return out


def spectrum(text: str) -> set[bytes]:
    b = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode())
    return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def test_presence_against_sets() -> None:
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé 1\n") for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, ""]
    codes, size = L.texts_presence(texts)
    for t, c in zip(texts, codes):
        want = {(len(g) << 24) | int.from_bytes(g, "big") for g in spectrum(t or "")}
        assert set(c.tolist()) == want and len(c) == len(want)


def test_scores_against_kernel_ridge_regression() -> None:
    """The folded matrix gives what Nyström features and ridge regression give step by step."""
    rows = _rows(60, 2)
    p = L.Params(landmarks_per_language=8)
    model = L.fit_rows(rows, p)
    seen: dict[str, int] = {}
    marks = []
    for lang, t in rows:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= p.landmarks_per_language:
            marks.append(t)
    k = lambda a, b: len(spectrum(a) & spectrum(b)) / np.sqrt(len(spectrum(a)) * len(spectrum(b)))
    kmm = np.array([[k(a, b) for b in marks] for a in marks])
    u, s, _ = np.linalg.svd(kmm)
    keep = s > 1e-8 * s.max()
    feature = lambda t: np.array([k(t, m) for m in marks]) @ u[:, keep] / np.sqrt(s[keep])
    phi = np.array([feature(t) for _, t in rows])
    y = np.array([[1.0 if lang == own else -1.0 for lang in sorted(WORDS)] for own, _ in rows])
    mean, bias = phi.mean(0), y.mean(0)
    w = np.linalg.solve((phi - mean).T @ (phi - mean) + p.ridge * len(rows) / phi.shape[1] * np.eye(phi.shape[1]), (phi - mean).T @ (y - bias))
    for _, t in _rows(20, 3):
        want = (feature(t) - mean) @ w + bias
        best, top, _ = L.score_column(model, pa.array([t]))
        assert top[0] == pytest.approx(want.max(), abs=2e-3) and best[0] == want.argmax()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(_rows(500, 4))], "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, docs) -> None:
    model = L.fit(docs.where("doc_id < 300"))
    got = {r["doc_id"]: r["language"] for r in L.identify(docs.where("doc_id >= 300"), model).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.where("doc_id >= 300").collect()}
    assert sum(got.get(i) == lang for i, lang in want.items()) >= 0.97 * len(want)


def test_other_scripts_and_junk_are_rejected(spark, docs) -> None:
    model = L.fit(docs)
    rows = [(1, "это совсем другой язык и другая письменность"), (2, "漢字漢字漢字漢字"), (3, "12345 +++ ---"), (4, None), (5, ""), (6, "qzx xqz jqk zzqx kkqj vvxq"), (7, "the water and the house"), (None, "the river")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 language", "2 score")
    assert {r["doc_id"] for r in L.identify(df, model).collect()} == {7, None}
    kept = L.keep_accepted(df, model)
    assert kept.columns == df.columns and kept.count() == 2


FOREIGN = {
    "it": "La città era piena di gente che camminava lungo le strade strette mentre il sole scendeva dietro le colline e i bambini giocavano davanti alla chiesa",
    "pt": "O homem que vive naquela casa não gosta de falar com os vizinhos porque eles fazem muito barulho durante a noite e não respeitam ninguém",
    "nl": "De kinderen speelden buiten in de tuin toen het plotseling begon te regenen en hun moeder riep dat ze naar binnen moesten komen",
    "id": "Pemerintah mengumumkan bahwa mereka akan membangun jalan baru di daerah pedesaan untuk membantu para petani membawa hasil panen mereka",
    "fi": "Kaupungin laidalla oli vanha talo jossa asui yksinäinen mies joka ei koskaan puhunut kenellekään mutta ruokki joka aamu lintuja",
    "pl": "Wczoraj wieczorem poszedłem do sklepu, żeby kupić chleb i mleko, ale okazało się, że wszystko było już zamknięte",
    "code": "for (int i = 0; i < n; i++) { if (values[i] > best) { best = values[i]; index = i; } } return index; def main(args): import sys print(len(args))",
}


def test_other_latin_languages_are_rejected(spark) -> None:
    """With the documents' four languages, and with two."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 0")
    for some in (docs, docs.where("lang in ('en', 'de')")):
        model = L.fit(some)
        assert not L.score_column(model, pa.array(list(FOREIGN.values())))[2].any()
        assert L.keep_accepted(some, model).count() >= 0.98 * some.count()
        assert model.min_score > 2 / len(model.languages) - 1


@pytest.mark.parametrize("ids", ["null", "one", "repeated rows"])
def test_rows_without_an_id_of_their_own(spark, ids: str) -> None:
    """Thousands of rows with null or constant doc_id, or of one text: the sample is neither empty nor flooded."""
    rows = [(None if ids == "null" else 7, t, lang) for lang, t in _rows(3000, 6)]
    if ids == "repeated rows":
        rows += [(7, "the water and the house where the river", "aa")] * 5000 + [(7, "", "bb"), (7, None, "cc")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert model.languages == ("aa", "bb", "cc")
    texts = sum(1 for r in rows if r[1])
    assert L.keep_accepted(df, model).count() >= 0.95 * texts


def test_model_and_limits_come_from_every_row(spark) -> None:
    """Against weighted regressions over all rows, many more than a language's weight, with and without each part; one language is ten times the others."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(1, 12))), k) for i, k in enumerate(rng.choices(list(WORDS), (10, 1, 1), k=900))]
    rows = [(i, t + " zqx" * (i % 97 == 0), k) for i, t, k in rows]  # odd ones, most of them beyond any sample
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = L.Params(train_per_language=60, landmarks_per_language=8, least_held=20, tail=0.02, min_score=-0.9, min_known=0.1)
    row = L.row_hash("doc_id", "text")
    told = sorted(df.select(L.unit_hash(row, p.seed), F.pmod(row, F.lit(5)), "lang", "text").collect())
    sets, langs = [spectrum(r[3]) for r in told], sorted(WORDS)
    n = {k: sum(r[2] == k for r in told) for k in langs}
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))

    def fitted(fold: int):
        rest = [i for i, r in enumerate(told) if r[1] != fold]
        marks = [i for lang in langs for i in [i for i in rest if told[i][2] == lang][: p.landmarks_per_language]]
        u, s, _ = np.linalg.svd(np.array([[k(sets[a], sets[b]) for b in marks] for a in marks]))
        keep = s > 1e-8 * s.max()
        feature = lambda x: np.array([k(x, sets[m]) for m in marks]) @ u[:, keep] / np.sqrt(s[keep])
        phi = np.array([feature(sets[i]) for i in rest])
        y = np.array([[1.0 if lang == told[i][2] else -1.0 for lang in langs] for i in rest])
        w = np.array([min(1, p.train_per_language / n[told[i][2]]) for i in rest])
        mean, bias = w @ phi / w.sum(), w @ y / w.sum()
        c = phi - mean
        weights = np.linalg.solve((c.T * w) @ c + p.ridge * w.sum() / phi.shape[1] * np.eye(phi.shape[1]), (c.T * w) @ (y - bias))
        grams = set().union(*(sets[m] for m in marks))
        return (lambda x: (feature(x) - mean) @ weights + bias), (lambda x: len(x & grams) / len(x))

    model = L.fit(df, p)
    score, _ = fitted(-1)
    for r, x in zip(told[::20], sets[::20]):
        assert L.score_column(model, pa.array([r[3]]))[1][0] == pytest.approx(score(x).max(), abs=2e-3)
    top, known = np.zeros(len(told)), np.zeros(len(told))
    for fold in range(5):
        score, share = fitted(fold)
        for i, r in enumerate(told):
            if r[1] == fold:
                top[i], known[i] = score(sets[i]).max(), share(sets[i])
    least = lambda x, floor: 0.9 * np.quantile(x, p.tail) + 0.1 * floor
    assert model.min_score == pytest.approx(least(top, -1 / 3), abs=2e-3)
    assert model.min_known == pytest.approx(least(known, p.min_known), abs=1e-9)


def test_quantile_is_exact(spark) -> None:
    rng = random.Random(13)
    for n in (1, 2, 7, 3000):
        x = [rng.choice((rng.uniform(-2, 2), rng.uniform(0.5, 0.5004), 0.25)) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in x], "x double")
        for q in (0.0, 0.002, 0.4, 1.0):
            assert L.quantile(df, "x", q) == pytest.approx(np.quantile(x, q), abs=1e-12)
    assert L.quantile(df.limit(0), "x", 0.5) is None


def test_scoring_needs_no_dense_matrix() -> None:
    """Ten thousand short texts against 200,000 n-grams in less memory than a matrix of them would take (8 GB)."""
    import tracemalloc

    grams = np.arange(200_000, dtype=np.uint64) + np.uint64(3 << 24)
    rng = np.random.default_rng(0)
    model = L.Model(("aa", "bb", "cc"), grams, rng.normal(size=(len(grams), 3)).astype(np.float32), np.zeros(3), -9.0, 0.0)
    tracemalloc.start()
    L.score_column(model, pa.array(["the river and stone"] * 10_000))
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_odd_tables(spark, docs) -> None:
    empty = L.fit(docs.limit(0))
    assert L.identify(docs, empty).count() == 0
    assert L.identify(docs.limit(0), L.fit(docs)).count() == 0
    assert L.identify(docs, L.fit(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))).count() == 0
    one = L.fit(docs.where("lang = 'aa'"))
    assert {r["language"] for r in L.identify(docs.where("lang = 'aa'"), one).collect()} == {"aa"}
    long = spark.createDataFrame([(1, "the water and the house " * 150_000), (1, "the river"), (1, "the river")], "doc_id long, text string")
    assert [r["language"] for r in L.identify(long, L.fit(docs)).collect()] == ["aa"] * 3
