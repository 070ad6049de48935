"""The inverted join against comparing all signatures, and against true overlap."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import neardup as N
from tessera.llm.shingles import signatures
from tessera.llm.textbytes import Hasher, lower_words

DOC = "doc_id long, text string"


def _corpus(seed: int, n: int = 60) -> list[tuple]:
    """Texts with copies, near copies at many distances, and a passage shared by many."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows, i = [], 0
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 150))]
        texts = [words]
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            other = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts.append(other)
        for t in texts:
            text = " ".join(t)
            if rng.random() < 0.3:
                text += " " + passage
            rows.append((i, text))
            i += 1
    return rows


def all_pairs(rows: list[tuple], p: N.Params) -> dict[tuple[int, int], int]:
    rows = [r for r in rows if r[0] is not None and r[1]]
    sig, filled = signatures(pa.array([t for _, t in rows]), p.k, p.width, p.seed, Hasher())
    out = {}
    for a, b in itertools.combinations(np.flatnonzero(filled), 2):
        n = int((sig[a] == sig[b]).sum())
        if n >= p.matches and rows[a][0] != rows[b][0]:
            out[tuple(sorted((rows[a][0], rows[b][0])))] = n
    return out


def connected(pairs) -> set[frozenset[int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    sets: dict[int, set[int]] = {}
    for x in root:
        sets.setdefault(find(x), set()).add(x)
    return {frozenset(s) for s in sets.values()}


def counted(rows: list[tuple], p: N.Params) -> list[tuple]:
    """(doc_id, class_id, links) of every row, from all pairs of signatures."""
    sig, filled = signatures(pa.array([t for _, t in rows], pa.large_string()), p.k, p.width, p.seed, Hasher())
    same = [np.flatnonzero(((sig == sig[i]).sum(1) >= p.matches) & filled) if filled[i] else np.array([i]) for i in range(len(rows))]
    root = {i: i for i in range(len(rows))}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, near in enumerate(same):
        for j in near:
            root[find(int(j))] = find(i)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least.get(find(i)), len(same[i]) - 1) for i, (d, _) in enumerate(rows)]


order = lambda rows: sorted(rows, key=str)


@pytest.mark.parametrize(
    "seed, params",
    [(1, N.Params(block=3)), (4, N.Params(k=16, matches=16)), (5, N.Params(k=32, matches=1, width=2)), (7, N.Params(k=32, matches=24, width=1, block=4))],
)
def test_links_against_all_signatures(spark, seed: int, params: N.Params) -> None:
    """Also with lists cut into tiny blocks, and thresholds so low that distances tell little."""
    rows = _corpus(seed, 40 if params.matches > 6 else 12)
    rows += [(None, rows[3][1]), (None, "nothing like it at all here"), (rows[5][0], rows[5][1]), (rows[6][0], rows[9][1])]
    got = [tuple(r) for r in N.linked(spark.createDataFrame(rows, DOC), params).collect()]
    assert order(got) == order(counted(rows, params))


def test_a_hot_group_of_near_copies(spark) -> None:
    """Hundreds of different texts that are all near each other, in blocks of 20, beside copies and others."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([1, 2, 6, 14])):
            words[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[7][1]) for i in range(100)] + [(2000 + i, " ".join(f"o{rng.randrange(9999)}" for _ in range(80))) for i in range(50)]
    p = N.Params(block=20)
    got = [tuple(r) for r in N.linked(spark.createDataFrame(rows, DOC), p).collect()]
    assert order(got) == order(counted(rows, p)) and len(got) == len(rows)


def test_groups_against_all_signatures(spark) -> None:
    rows = _corpus(5)
    docs = spark.createDataFrame(rows, DOC)
    want = connected(all_pairs(rows, N.Params()))
    got = {r["doc_id"]: r["group_id"] for r in N.groups(docs).collect()}
    assert got == {x: min(s) for s in want for x in s if x != min(s)}
    assert {r["doc_id"] for r in N.keep_one(docs).collect()} == {i for i, _ in rows} - set(got)


def test_recall_and_precision_against_true_overlap(spark) -> None:
    rows = _corpus(6)
    sets = {}
    for i, t in rows:
        w = lower_words(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    overlap = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    groups = connected(all_pairs(rows, N.Params()))
    together = lambda a, b: any(a in g and b in g for g in groups)
    got = {r["doc_id"]: r["class_id"] for r in N.linked(spark.createDataFrame(rows, DOC)).collect()}
    assert all((got[a] == got[b]) == together(a, b) for a, b in overlap)
    near = [p for p, j in overlap.items() if j >= 0.7]
    assert sum(together(*p) for p in near) >= 0.95 * len(near)
    assert all(overlap[p] > 0.3 for p in all_pairs(rows, N.Params()))


def test_a_chain_is_one_group(spark) -> None:
    """A group may be far longer across than any of its links."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201)], "a long, b long")
    assert {r["node"]: r["root"] for r in N.components(edges).collect()} == {i: 0 for i in range(1, 71)} | {201: 200}
    assert N.components(edges.limit(0)).count() == 0


def test_odd_rows(spark) -> None:
    long = " ".join(f"z{i}" for i in range(300_000))
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, None), (2, ""), (3, ""), (3, ""), (4, "?!"), (5, text), (6, text), (6, text), (6, "quite another text of a few words here"), (None, text), (7, "one"), (8, "One"), (9, long), (10, long + " end")]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 class_id", "2 sig", "3 __gone", "4 pair", "5 root", "6 __odd", "7 __sig")
    got = order(tuple(r) for r in N.linked(df).collect())
    assert got == order([(1, 1, 0), (2, 2, 0), (3, 3, 0), (3, 3, 0), (4, 4, 0), (5, 5, 3), (6, 5, 3), (6, 5, 3), (6, 6, 0), (None, 5, 3), (7, 7, 1), (8, 7, 1), (9, 9, 1), (10, 9, 1)])
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, ""), (2, ""), (3, ""), (3, ""), (4, "?!"), (5, text), (6, rows[8][1]), (7, "one"), (9, long)])
    for t in (N.linked(df.limit(0)), N.groups(df.limit(0)), N.keep_one(df.limit(0))):
        assert t.count() == 0


@pytest.mark.parametrize("ids", ["null", "one", "twice"])
def test_rows_without_an_id_of_their_own(spark, ids: str) -> None:
    """Null, constant and repeated doc_ids: one row of each group stays, whatever it is called."""
    texts = [f"group {i} of words that no other has {i * 7} {i * 11}" for i in range(30)]
    rows = [({"null": None, "one": 4, "twice": i // 2}[ids], t) for i, t in enumerate(t for t in texts for _ in range(4))]
    kept = N.keep_one(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r["text"] for r in kept) == sorted(texts)
