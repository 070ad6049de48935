"""The registered queries against their SQL, and the pipeline against a direct version."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from oracle import SF, difference

import corpus_pipeline
from tessera.llm import langid, mixing, neardup, queries, toxicity
from tessera.llm.workspace import table


def test_all_ten_are_registered() -> None:
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_id", "toxic", "near_duplicates", "mix_sources", "pack_bins"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name: str) -> None:
    assert difference(queries.queries()[name](spark, SF), queries.oracle_sql()[name]) == ""


def test_pipeline_against_direct_version(spark) -> None:
    """Each stage's decisions made row by row, from the stage before."""
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    model = langid.fit(docs)
    import pyarrow as pa

    rows = [r for r in rows if langid.score_column(model, pa.array([r["text"]], pa.string()))[2][0]]
    left = spark.createDataFrame(rows, docs.schema)
    scorer = toxicity.Scorer(toxicity.fit(left, table(spark, SF, "labels")))
    rows = [r for r in rows if not list(scorer.documents(pa.array([r["text"]], pa.string())))]
    left = spark.createDataFrame(rows, docs.schema)
    gone = {r["doc_id"] for r in neardup.groups(left).collect()}
    rows = [r for r in rows if r["doc_id"] not in gone]
    left = spark.createDataFrame(rows, docs.schema)
    copies = {r["doc_id"]: (r["tokens"], r["copies"]) for r in mixing.rates(left).collect()}
    want = Counter({d: t * c for d, (t, c) in copies.items()})
    got, fill = Counter(), defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["tokens"]
        fill[r["bin"]] += r["tokens"]
    assert +got == +want and max(fill.values()) <= 2048
    assert sum(v == 2048 for v in fill.values()) >= 0.9 * len(fill)


WORDS = {
    "en": "the and thing water where house river stone with other every little under summer".split(),
    "de": "der und wasser haus schnell zwischen strasse nicht ein immer unter sommer baum".split(),
}
BAD = "vrenk skoll grubnar zlatch mordug".split()


def _documents(n: int, ids) -> list[tuple]:
    """(doc_id, text, lang, source): prose in two languages, toxic ones, copies, near copies, a hot source, odd texts."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(60, 160))]
        if i % 10 == 0:
            words[20:20] = [rng.choice(BAD) for _ in range(12)]
        rows.append((" ".join(words), lang, "hot" if i % 3 else f"s{i % 5}"))
    rows += [rows[7]] * 40 + [(rows[8][0] + " " + rng.choice(WORDS["en"]), "en", "s1") for _ in range(20)]
    rows += [(None, "en", "s1"), ("", "en", "s1"), ("", "en", "s1"), ("?! 12", "de", None), (" ".join(rng.choice(WORDS["en"]) for _ in range(3_000)), "en", None), (rows[9][0] + " the river", None, "s2")]
    return [(ids(i), *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("ids", ["own", "null", "one", "twice"])
def test_pipeline_of_odd_tables(spark, tmp_path, ids: str) -> None:
    """Null, constant and repeated doc_ids, odd texts and further columns with clashing names, through all stages."""
    at = str(tmp_path)
    name = {"own": lambda i: i, "null": lambda i: None, "one": lambda i: 5, "twice": lambda i: i // 2}[ids]
    rows = _documents(400, name)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1L n_chars", "2 sig", "3 root", "4 __gone", "5 bin", "6 tokens", "7 o", "8 __odd")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(name(i), int(i % 10 == 0)) for i in range(400)] + [(None, 1)] if ids == "own" else [(900_000, 1), (None, 0)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    now, left = spark.read.parquet(f"{at}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, at)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{at}/{i}.parquet")
        now = spark.read.parquet(f"{at}/{i}.parquet")
        left.append(Counter(r["text"] for r in now.select("text").collect()) if i < 4 else None)
    texts = Counter(r[1] for r in rows)
    assert sum(left[0].values()) >= 0.97 * (len(rows) - 4) and not {None, "", "?! 12"} & set(left[0])
    toxic = {t for t in texts if t and set(BAD) & set(t.split())}
    assert ids != "own" or len(toxic & set(left[1])) <= 0.1 * len(toxic)
    assert len(set(left[1]) - toxic) >= 0.97 * len(set(left[0]) - toxic)
    assert max(left[2].values()) == 1 and left[2][rows[7][1]] == (rows[7][1] in left[1])  # of forty copies one
    assert len(left[2]) >= len(left[1]) - 25
    held = sum(len(t.split(" ")) * n for t, n in left[3].items())
    assert held == pytest.approx(sum(len(t.split(" ")) for t in left[2]), rel=0.3)
    assert now.agg({"tokens": "sum"}).first()[0] == held


def test_pipeline_of_an_empty_table(spark, tmp_path) -> None:
    for t in ("documents", "labels"):
        table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
