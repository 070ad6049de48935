"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams of length 1 to 3 that both
contain (presence, not frequency: a blended spectrum), divided by the root of
the product of their numbers of distinct n-grams.  Landmark texts give a
Nyström map; a ridge regression for each language against the rest is fitted
in that space.  Because the kernel is linear in the presence vector, landmarks,
Nyström factor and ridge weights fold into one matrix, and a batch of
documents is scored by one product: presence x folded, scaled by row.  The presence
matrix is sparse and never made: its product is a sum of ``folded``'s rows by document.

The regression and its limits come from every labelled row.  Only the landmarks, the
basis of the Nyström map, are some of them: those of each language with the least hash.
The regression needs no more than sums over the rows of products of their kernel values, which each
task adds up for the rows that it reads.

``fit`` sets what a text must reach.  The scores of L languages add up to 2 - L,
so that the best is never below 2 / L - 1.  The rows are in ``FOLDS`` parts by hash, and each is
scored by a model of the other parts' rows and landmarks; the quantile ``tail`` of all these held-out
best scores, moved by ``slack`` of the way to that floor, is the least score (with one language there is
none), and that of their known shares, moved as much to ``min_known``, the least known share.

A text's letters are lower-cased; every other ASCII byte counts as a space.

Results in odd cases
  * null or empty text, or a text without letters: rejected (no language).
  * a text that no language's regression claims (every score below the
    least), or of whose distinct n-grams the landmarks have less than
    the least known share (another script or language): rejected.
  * fewer than ``least_held`` labelled rows a part: ``min_score`` and ``min_known`` are the limits.
  * two languages with equal scores: the first in alphabetical order.
  * null ``doc_id``: classified like any other row.  Repeated rows: each row, in the fit too.  Landmarks
    are drawn by a hash of doc_id and text, equal rows once, so that neither leaves them out or floods them.
  * ``lang`` null in the labelled rows: such rows are not used for the fit.
  * no labelled row at all (an empty table): every text is rejected.
  * further columns, whatever their names, pass through ``keep_accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import runs
from .workspace import discard, row_hash, unit_hash, written

FOLDS = 5

_FOLD = np.arange(256, dtype=np.uint8)
for _i in range(128):
    if not chr(_i).isalpha():
        _FOLD[_i] = 32
_B = np.uint64(24)


@dataclass(frozen=True)
class Params:
    #: All labelled rows of a language count, alike, and together as no more than this many: no language outweighs others.
    train_per_language: int = 400
    landmarks_per_language: int = 60
    ridge: float = 1e-2
    min_score: float = -0.5
    min_known: float = 0.5
    tail: float = 0.002
    slack: float = 0.1
    least_held: int = 20
    seed: int = 10


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    grams: np.ndarray  # sorted codes of the landmarks' n-grams
    folded: np.ndarray  # grams x languages
    bias: np.ndarray
    min_score: float
    min_known: float = 0.5


def presence(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and n-gram code of each distinct n-gram of each document, in order.

    A code holds the length in its upper bits: 1, 2 or 3 bytes of n-gram below ``length << 24``.
    """
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = _FOLD[raw].astype(np.uint64)
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    kinds = []
    for n in (3, 2, 1):
        if len(x) < n:
            continue
        m = len(x) - n + 1
        code = np.zeros(m, np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | x[j : j + m]
        key = (of[:m] << np.uint64(26)) | np.uint64(n << 24) | code
        key = key[of[:m] == of[n - 1 :]]
        if n < 3:  # most are prefixes of a longer one: the distinct longer ones are few
            longer = kinds[-1] if kinds else np.zeros(0, np.uint64)
            code = (longer & np.uint64((1 << 24) - 1)) >> np.uint64(8)
            short = ((longer >> np.uint64(26)) << np.uint64(26)) | np.uint64(n << 24) | code
            last = offsets[1:][np.diff(offsets) >= n] - n
            tail = np.zeros(len(last), np.uint64)
            for j in range(n):
                tail = (tail << np.uint64(8)) | x[last + j]
            key = np.concatenate([short, (of[last] << np.uint64(26)) | np.uint64(n << 24) | tail])
        key.sort()
        kinds.append(key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key)
    keys = np.concatenate(kinds)
    keys.sort()
    return (keys >> np.uint64(26)).astype(np.int64), keys & np.uint64((1 << 26) - 1)


def has_letters(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_FOLD[raw] != 32)])
    return seen[offsets[1:]] > seen[offsets[:-1]]


class Landmarks:
    """The landmarks' presence vectors by n-gram, so that only what a text shares with them is touched."""

    def __init__(self, codes: list[np.ndarray]) -> None:
        self.n = len(codes)
        mark, code = np.repeat(np.arange(self.n), [len(c) for c in codes]), np.concatenate(codes)
        self.grams, self.gram = np.unique(code, return_inverse=True)
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.mark = self.gram[order], mark[order]
        self.start = np.searchsorted(self.gram, np.arange(len(self.grams) + 1))

    def shared(self, codes: list[np.ndarray]) -> np.ndarray:
        """(texts x landmarks): how many n-grams both have."""
        out = np.zeros((len(codes), self.n))
        for i, code in enumerate(codes):
            at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
            at = at[self.grams[at] == code]
            size = self.start[at + 1] - self.start[at]
            flat = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out[i] = np.bincount(self.mark[flat], minlength=self.n)
        return out

    def folded(self, by_mark: np.ndarray) -> np.ndarray:
        """(n-grams x columns): sums over the landmarks that have the n-gram."""
        return np.stack([np.bincount(self.gram, c[self.mark], len(self.grams)) for c in by_mark.T], 1)


def texts_presence(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of each text's distinct n-grams, and their numbers."""
    out: list[np.ndarray] = []
    for first, after, raw, offsets in runs(pa.array(texts, pa.large_string())):
        of, code = presence(raw, offsets)
        cuts = np.searchsorted(of, np.arange(after - first + 1))
        out += [code[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return out, np.array([max(1, len(x)) for x in out], float)


def chosen(languages: list[str], params: Params) -> list[int]:
    """The first rows of each language, of rows given by their languages."""
    taken: dict[str, int] = {}
    out = []
    for i, lang in enumerate(languages):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= params.landmarks_per_language:
            out.append(i)
    return out


def moments(kernel: np.ndarray, lang: np.ndarray, weight: np.ndarray, languages: int) -> np.ndarray:
    """Weighted sums over rows: of products of kernel values, and below, by language, of kernel values and (last column) of ones."""
    own = (lang[:, None] == np.arange(languages)) * weight[:, None]
    return np.hstack([kernel * weight[:, None], own]).T @ np.hstack([kernel, np.ones((len(kernel), 1))])


def solved(languages: tuple[str, ...], codes: list[np.ndarray], size: np.ndarray, sums: np.ndarray, params: Params) -> Model:
    """The model of landmarks (their n-grams' codes and numbers) and of the rows' moments with them."""
    marks, m = Landmarks(codes), len(codes)
    products, by_lang, rows = sums[:m, :m], sums[m:, :m], sums[m:, m]
    n, total = rows.sum(), by_lang.sum(0)
    values, vectors = np.linalg.eigh(marks.shared(codes) / np.sqrt(size[:, None] * size))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2), up to a rotation
    mean, bias = total @ root / n, 2 * rows / n - 1  # of features, and of targets: 1 for the own language, -1 for others
    centred = root.T @ (products - np.outer(total, total) / n) @ root
    targets = root.T @ (2 * by_lang.T - total[:, None]) - n * np.outer(mean, bias)
    weights = np.linalg.solve(centred + params.ridge * n * np.eye(len(mean)) / len(mean), targets)
    folded = marks.folded((root @ weights) / np.sqrt(size)[:, None])
    return Model(languages, marks.grams, folded.astype(np.float32), bias - mean @ weights, params.min_score, params.min_known)


def fit_rows(rows: list[tuple[str, str]], params: Params = Params()) -> Model:
    """Fit on (language, text) rows that weigh alike; the first of each language are the landmarks."""
    rows = [(lang, text) for lang, text in rows if lang is not None and text]
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not languages:
        return Model((), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros(0), params.min_score)
    codes, size = texts_presence([text for _, text in rows])
    own = chosen([lang for lang, _ in rows], params)
    kernel = Landmarks([codes[i] for i in own]).shared(codes) / np.sqrt(size[:, None] * size[own])
    sums = moments(kernel, np.array([languages.index(lang) for lang, _ in rows]), np.ones(len(rows)), len(languages))
    return solved(languages, [codes[i] for i in own], size[own], sums, params)


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """Fit on every labelled row."""
    row = row_hash("doc_id", "text")
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    labelled = labelled.select("lang", "text", unit_hash(row, params.seed).alias("o"), F.pmod(row, F.lit(FOLDS)).cast("int").alias("fold"))
    counts, cut = drawn(labelled, params)
    if not counts:
        return fit_rows([], params)
    languages = tuple(sorted(counts))
    within = F.coalesce(*[F.when(F.col("lang") == k, F.lit(cut[k])) for k in languages])
    marks = labelled.where(F.col("o") <= within).groupBy("lang", "fold", "o").agg(F.min("text").alias("text")).toArrow().to_pylist()
    marks.sort(key=lambda r: (r["o"], r["text"]))
    codes, size = texts_presence([r["text"] for r in marks])
    sums = summed(labelled, languages, np.array([min(1.0, params.train_per_language / counts[k]) for k in languages]), codes, size)

    def without(fold: int) -> Model | None:
        """The model of the other parts' rows and landmarks."""
        rest = [i for i, r in enumerate(marks) if r["fold"] != fold]
        own = [rest[i] for i in chosen([marks[i]["lang"] for i in rest], params)]
        total = sum(s for f, s in sums.items() if f != fold)
        if not own:
            return None
        there = [j for j in range(len(languages)) if total[len(marks) + j, -1] > 0]
        total = total[np.ix_([*own, *(len(marks) + j for j in there)], [*own, len(marks)])]
        return solved(tuple(languages[j] for j in there), [codes[i] for i in own], size[own], total, params)

    model = without(-1)
    if sum(counts.values()) < FOLDS * params.least_held:
        return model
    return limited(model, [without(f) for f in range(FOLDS)], labelled, params)


def drawn(labelled: DataFrame, params: Params) -> tuple[dict[str, int], dict[str, float]]:
    """Number of rows of each language, and the hash up to which its landmarks lie, those of the models without a part included."""
    most = params.landmarks_per_language

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], tuple[int, np.ndarray]] = {}
        for b in batches:
            names = b.column("lang").dictionary_encode()
            key = names.indices.to_numpy().astype(np.int64) * FOLDS + b.column("fold").to_numpy()
            o = b.column("o").to_numpy()
            for k in np.unique(key):
                at = names.dictionary[int(k) // FOLDS].as_py(), int(k) % FOLDS
                n, had = kept.get(at, (0, o[:0]))
                mine = o[key == k]
                kept[at] = n + len(mine), np.unique(np.concatenate([had, mine]))[:most]
        if kept:
            lang, fold = zip(*kept)
            n, o = zip(*kept.values())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(fold, pa.int32()), pa.array(n, pa.int64()), pa.array([x.tolist() for x in o], pa.list_(pa.float64()))], ["lang", "fold", "n", "o"])

    parts = labelled.select("lang", "fold", "o").mapInArrow(least, "lang string, fold int, n long, o array<double>")
    parts = parts.groupBy("lang", "fold").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("o")))), 1, most).alias("o"))
    counts: dict[str, int] = {}
    first: dict[str, list[tuple[float, int]]] = {}
    for r in parts.collect():
        counts[r["lang"]] = counts.get(r["lang"], 0) + r["n"]
        first.setdefault(r["lang"], []).extend((o, r["fold"]) for o in r["o"])
    cut = {k: max(o for f in range(-1, FOLDS) for o, _ in sorted(x for x in v if x[1] != f)[:most]) for k, v in first.items()}
    return counts, cut


def summed(labelled: DataFrame, languages: tuple[str, ...], weight: np.ndarray, codes: list[np.ndarray], size: np.ndarray) -> dict[int, np.ndarray]:
    """The moments of each part's rows with the landmarks."""
    shared = labelled.sparkSession.sparkContext.broadcast((Landmarks(codes), np.sqrt(size)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, root = shared.value
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            lang = pc.index_in(b.column("lang"), pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
            fold = b.column("fold").to_numpy()
            for first, after, raw, offsets in runs(b.column("text")):
                of, code = presence(raw, offsets)
                cuts = np.searchsorted(of, np.arange(after - first + 1))
                kernel = marks.shared([code[x:y] for x, y in zip(cuts[:-1], cuts[1:])]) / np.sqrt(np.maximum(np.diff(cuts), 1))[:, None] / root
                for f in np.unique(fold[first:after]):
                    at = np.flatnonzero(fold[first:after] == f)
                    own = lang[first:after][at]
                    sums[f] = sums.get(f, 0.0) + moments(kernel[at], own, weight[own], len(languages))
        for f, s in sums.items():
            for at in range(0, len(s), 1000):
                part = s[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(part), pa.int32()), pa.array(range(at, at + len(part)), pa.int32()), pa.array([x.tobytes() for x in part], pa.binary())], ["fold", "i", "v"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for f, i, v in zip(*(c.to_pylist() for c in b.columns)):
                sums[f, i] = sums.get((f, i), 0.0) + np.frombuffer(v)
        if sums:
            fold, i = zip(*sums)
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(i, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["fold", "i", "v"])

    kind = "fold int, i int, v binary"
    # by the matrices' rows, so that no task and no batch holds many matrices
    rows = labelled.select("lang", "text", "fold").mapInArrow(add_up, kind).repartition("fold", "i").mapInArrow(total, kind).toArrow()
    out: dict[int, np.ndarray] = {}
    for f, i, v in zip(*(c.to_pylist() for c in rows.columns)):
        out.setdefault(f, np.zeros((len(codes) + len(languages), len(codes) + 1)))[i] = np.frombuffer(v)
    return out


def limited(model: Model, others: list[Model | None], labelled: DataFrame, params: Params) -> Model:
    """The model with the limits that all rows set, each scored by the model (of ``others``) that was fitted without its part."""
    shared = labelled.sparkSession.sparkContext.broadcast(others)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column("fold").to_numpy()
            for f, other in enumerate(shared.value):
                if other is not None and (fold == f).any():
                    _, top, known, letters = measured(other, b.column("text").filter(pa.array(fold == f)))
                    yield pa.RecordBatch.from_arrays([pa.array(top[letters]), pa.array(known[letters])], ["top", "known"])

    held = written(labelled.select("text", "fold").mapInArrow(score, "top double, known double"), "held-out")
    lowest = {c: quantile(held, c, params.tail) for c in ("top", "known")}
    discard(held)
    if lowest["top"] is None:
        return model
    least = lambda c, floor: max(floor, (1 - params.slack) * lowest[c] + params.slack * floor)
    score_ = least("top", 2 / len(model.languages) - 1) if len(model.languages) > 1 else params.min_score
    return replace(model, min_score=max(params.min_score, score_), min_known=least("known", params.min_known))


def quantile(values: DataFrame, name: str, q: float) -> float | None:
    """A column's quantile, exactly (interpolated as numpy does): bins are counted, and the values read of those that it lies in."""
    in_bin = F.floor(F.col(name) * 1000)
    bins = sorted((r[0], r[1]) for r in values.groupBy(in_bin).count().collect())
    if not bins:
        return None
    ends = np.cumsum([n for _, n in bins])
    place = q * (int(ends[-1]) - 1)

    def at(k: int) -> float:
        j = int(np.searchsorted(ends, k, side="right"))
        of = sorted((r[0], r[1]) for r in values.where(in_bin == bins[j][0]).groupBy(name).count().collect())
        inside = np.cumsum([n for _, n in of])
        return of[int(np.searchsorted(inside, k - int(ends[j]) + bins[j][1], side="right"))][0]

    low = int(place)
    below, above = at(low), at(min(low + 1, int(ends[-1]) - 1))
    return below + (above - below) * (place - low)


def measured(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its score, the share of known n-grams, and whether the text has letters."""
    n = len(column)
    best, top, known, letters = np.zeros(n, np.int64), np.full(n, -1.0), np.zeros(n), np.zeros(n, bool)
    for first, after, raw, offsets in runs(column):
        of, code = presence(raw, offsets)
        size = np.maximum(np.bincount(of, minlength=after - first), 1)
        at = np.minimum(np.searchsorted(model.grams, code), len(model.grams) - 1)
        hit = model.grams[at] == code
        of, at = of[hit], at[hit]
        score = np.stack([np.bincount(of, column_[at], after - first) for column_ in model.folded.T], 1) / np.sqrt(size)[:, None] + model.bias
        best[first:after] = score.argmax(1)
        top[first:after] = score.max(1)
        known[first:after] = np.bincount(of, minlength=after - first) / size
        letters[first:after] = has_letters(raw, offsets)
    return best, top, known, letters


def score_column(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its score, and whether the text is accepted."""
    if not model.languages:
        return np.zeros(len(column), np.int64), np.full(len(column), -1.0), np.zeros(len(column), bool)
    best, top, known, letters = measured(model, column)
    return best, top, letters & (top >= model.min_score) & (known >= model.min_known)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, score) of the documents that are accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: landmarks, not documents

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            best, top, ok = score_column(m, b.column("text"))
            ids = b.column("doc_id").filter(pa.array(ok))
            names = pa.array([m.languages[i] for i in best[ok]], pa.string())
            yield pa.RecordBatch.from_arrays([ids, names, pa.array(np.round(top[ok], 4))], ["doc_id", "language", "score"])

    return docs.select("doc_id", "text").mapInArrow(label, "doc_id long, language string, score double")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is identified, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score_column(shared.value, b.column("text"))[2]))

    return docs.mapInArrow(keep, docs.schema)
