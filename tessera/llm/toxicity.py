"""Toxic passages as maximum-scoring segments of token log-odds.

Fit, on all labelled documents: for each word, and for each
four-letter word beginning, the log-odds of occurring in a toxic rather than a
clean document, with a Dirichlet prior whose mean is the pooled rate; a token
scores its log-odds less ``z`` standard errors, from ``least_score`` up (of its own
score and its beginning's, a word takes the larger).  Every other token costs
the log-likelihood ratio of not being a toxic one.  Near copies among the toxic, and
among the clean, count once, so that a copied document does not make its words toxic.

Score: one linear scan finds all maximal-scoring segments of a document.
Under the null model of toxic-scoring tokens in clean text, segment scores
follow an extreme-value law; lambda is the root of its characteristic
equation, K is fitted to simulated null sequences.  A document's segments are
aggregated by Karlin-Altschul sum statistics; it is toxic if that p-value is
below ``alpha``.

Results in odd cases
  * null or empty text, or text without words: not toxic, no passage.
  * labels that are null, or that belong to no document: not used; a document
    with several label rows is toxic if one of them says so.
  * no toxic or no clean labelled document: no token scores, nothing is toxic.
  * equal segments: reported in order of position.  Null doc_id: scored like any.
  * repeated rows: each row's passages.  Further columns pass through ``keep_clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import signatures
from .textbytes import Hasher, HashTable, runs, word_spans
from .workspace import discard, unit_hash, written

_STEM = 4  # letters of a word's beginning
_COORDINATES, _WIDTH, _SEED = 4, 3, 11  # of the signatures that tell near copies


@dataclass(frozen=True)
class Params:
    #: Labels (of 9 bytes) up to which a worker holds them all; more are joined, which shuffles every text.
    held_labels: int = 10_000_000
    prior_documents: float = 10.0
    z: float = 1.0
    least_score: float = 2.0
    #: Least rate of toxic-scoring tokens in clean text, as the null model has it.
    null_rate: float = 1e-5
    alpha: float = 1e-3
    seed: int = 5


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # hashes of scoring words and beginnings
    scores: np.ndarray
    drift: float = 0.02
    lam: float = 1.0
    k: float = 0.1
    alpha: float = 1e-3


def _tokens(raw: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of each word's beginning (0 for shorter words), and each document's first word."""
    start, end, first = word_spans(raw, offsets)
    sums = hasher.prefix(raw)
    words = hasher.spans(sums, start, end)
    begins = (raw & 0xC0) != 0x80  # a letter's first byte
    letter = np.concatenate([[0], np.cumsum(begins)])  # letters before each place
    place = np.append(np.flatnonzero(begins), np.full(_STEM + 1, len(raw)))
    stems = np.where(letter[end] - letter[start] >= _STEM, ~hasher.spans(sums, start, place[letter[start] + _STEM]), np.uint64(0))
    return words, stems, first


def _presence(texts: list[str] | pa.Array, hasher: Hasher) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, raw, offsets in runs(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())):
        words, stems, first = _tokens(raw, offsets, hasher)
        out += [np.unique(np.concatenate([words[a:b], stems[a:b]])) for a, b in zip(first[:-1], first[1:])]
    return out


def _distinct(texts: list[str], hasher: Hasher) -> list[str]:
    """Without texts that share a coordinate of a short MinHash signature with an earlier one."""
    if not texts:
        return texts
    sig, filled = signatures(pa.array(texts, pa.large_string()), _COORDINATES, _WIDTH, _SEED, hasher)
    fresh = filled.copy()
    for j in range(sig.shape[1]):
        first = np.zeros(len(texts), bool)
        first[np.unique(sig[:, j], return_index=True)[1]] = True
        fresh &= first
    return [t for t, f in zip(texts, fresh) if f]


def fit_texts(toxic: list[str], clean: list[str], params: Params = Params()) -> Model:
    hasher = Hasher()
    toxic, clean = _distinct(toxic, hasher), _distinct(clean, hasher)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), alpha=params.alpha)
    if not toxic or not clean:
        return none
    in_toxic, in_clean = _presence(toxic, hasher), _presence(clean, hasher)
    keys, y_t = np.unique(np.concatenate(in_toxic), return_counts=True)
    other, y_o = np.unique(np.concatenate(in_clean), return_counts=True)
    at = np.minimum(np.searchsorted(other, keys), max(0, len(other) - 1))
    y_c = np.where(other[at] == keys, y_o[at], 0) if len(other) else np.zeros(len(keys))
    score, good = _log_odds(keys, y_t, y_c, len(toxic), len(clean), params)
    if not good.any():
        return none
    keys, score = keys[good], score[good]
    scorer = Scorer(Model(keys, score))
    values, times, hits_t, words_t = scorer.tally(toxic)
    _, _, hits_c, words_c = scorer.tally(clean)
    return _with_law(keys, score, values, times, hits_t / max(1, words_t), hits_c / max(1, words_c), params)


def _log_odds(keys: np.ndarray, y_t: np.ndarray, y_c: np.ndarray, n_t: int, n_c: int, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Scores of tokens that y_t of n_t toxic and y_c of n_c clean documents have, and which of them count."""
    prior = params.prior_documents * (y_t + y_c) / (n_t + n_c)
    p_t, p_c = (y_t + prior) / (n_t + params.prior_documents), (y_c + prior) / (n_c + params.prior_documents)
    error = np.sqrt(1 / (y_t + prior) + 1 / (y_c + prior))
    p_t, p_c = np.minimum(p_t, 1 - 1e-9), np.minimum(p_c, 1 - 1e-9)
    score = np.log(p_t / (1 - p_t)) - np.log(p_c / (1 - p_c)) - params.z * error
    return score, (score >= params.least_score) & (keys != 0)


def _with_law(keys: np.ndarray, score: np.ndarray, values: np.ndarray, times: np.ndarray, rate_t: float, rate_c: float, params: Params) -> Model:
    """The model with the law of its segments, from the scores in toxic documents (values and how often each occurs) and the rates of scoring words."""
    rate_t, rate_c = max(rate_t, 1e-4), max(rate_c, params.null_rate)
    rate_t = max(rate_t, 2 * rate_c)
    drift = math.log((1 - min(rate_c, 0.3)) / (1 - min(rate_t, 0.6)))
    lam = _root(values, rate_c, drift, times)
    return Model(keys, score, drift, lam, _scale(values, rate_c, drift, lam, params.seed, times), params.alpha)


def _root(values: np.ndarray, rate: float, drift: float, times: np.ndarray | None = None) -> float:
    """Positive root of E exp(lambda x) = 1 for a clean text's token scores; the mean score must be below zero."""
    mean = lambda x: np.average(x, weights=times)
    if rate * mean(values) >= drift * (1 - rate):
        return 1e-3
    low, high = 1e-6, 1.0
    f = lambda x: math.log(rate) + math.log(mean(np.exp(x * (values - values.max())))) + x * values.max() - math.log(-math.expm1(math.log(1 - rate) - x * drift))
    while f(high) < 0 and high < 1e4:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _scale(values: np.ndarray, rate: float, drift: float, lam: float, seed: int, times: np.ndarray | None = None) -> float:
    """K from the mean of the largest segments of simulated null sequences (only their scoring tokens are drawn)."""
    rng = np.random.default_rng(seed)
    length = int(200 / rate)
    share = None if times is None else times / times.sum()
    best = []
    for _ in range(200):
        n = max(1, rng.poisson(200))
        gaps, draws = rng.geometric(min(0.999, rate), n) * drift, rng.choice(values, n, p=share)
        run, top = 0.0, 0.0
        for g, x in zip(gaps, draws):
            run = max(0.0, run - g) + x
            top = max(top, run)
        best.append(top)
    return max(1e-12, math.exp(lam * float(np.mean(best)) - 0.5772156649 - math.log(length)))


def maximal_segments(score: list[float], at: list[int], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, in linear time.  Tokens between the scoring ones (at positions ``at``) cost ``drift`` each.

    Candidates are kept with a pointer to the nearest one before them that begins lower, so that
    the search for it never looks at a candidate twice; where there is none, all before are final.
    Returns (first scoring token, last scoring token, segment score) in order of position.
    """
    out: list[tuple[int, int, float]] = []
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, pointer
    total = 0.0
    previous = None
    for i, x in enumerate(score):
        if previous is not None:
            total -= drift * (at[i] - previous - 1)
        previous = at[i]
        first, before, total = i, total, total + x
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0:
                out += [(a, b, r - l) for a, b, l, r, _ in kept]
                kept.clear()
                break
            if kept[j][3] >= total:
                break
            first, _, before, _, back = kept[j]
            del kept[j:]
            j = back
        kept.append((first, i, before, total, j))
    return out + [(a, b, r - l) for a, b, l, r, _ in kept]


def sum_p(segments: list[float], words: int, lam: float, k: float) -> float:
    """p-value of a document's segment scores by sum statistics over its r best, for the best r."""
    x = sorted((lam * s - math.log(max(1e-12, k * words)) for s in segments), reverse=True)
    best, t = 1.0, 0.0
    for r, v in enumerate(x, 1):
        t += v
        if t <= 0:
            break
        p = 1 - math.exp(-math.exp(-t)) if r == 1 else math.exp(-t + (r - 1) * math.log(t) - math.lgamma(r + 1) - math.lgamma(r))
        best = min(best, p * 2.0**r)
    return min(1.0, max(0.0, best))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.hasher = model, Hasher()
        self.table = HashTable(model.keys, spread=5)
        self.scores = np.append(model.scores, -np.inf)  # the last for tokens that aren't found

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, rows, scores of scoring words, their places among all words of the run, first word of each row)."""
        for start, after, raw, offsets in runs(column):
            words, stems, first = _tokens(raw, offsets, self.hasher)
            own, stem = self.table.find(words), self.table.find(stems)
            at = np.flatnonzero((own >= 0) | (stem >= 0))
            yield start, after - start, np.maximum(self.scores[own[at]], self.scores[stem[at]]), at, first

    def tally(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Scores that occur and how often, and the numbers of scoring words and of all words."""
        found = [(s, int(f[-1])) for _, _, s, _, f in self.hits(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))]
        values, times = np.unique(np.concatenate([np.zeros(0), *(s for s, _ in found)]), return_counts=True)
        return values, times, int(times.sum()), sum(n for _, n in found)

    def documents(self, column: pa.Array) -> Iterator[tuple[int, float, list[tuple[int, int, float, float]]]]:
        """(row, p-value, [(first word, last word, score, e-value)]) of the toxic rows."""
        m = self.model
        if not len(m.keys):
            return
        for start, n, score, at, first in self.hits(column):
            cut = np.searchsorted(at, first)
            for d in np.flatnonzero(np.diff(cut) > 0):
                places = (at[cut[d] : cut[d + 1]] - first[d]).tolist()
                words = int(first[d + 1] - first[d])
                found = maximal_segments(score[cut[d] : cut[d + 1]].tolist(), places, m.drift)
                p = sum_p([s for _, _, s in found], words, m.lam, m.k)
                if p < m.alpha:
                    yield start + int(d), p, [(places[a], places[b], s, m.k * words * math.exp(-m.lam * s)) for a, b, s in found]


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Fit on every labelled document."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    # one text for each doc_id, however often it is repeated
    texts = _joined(docs.where("text is not null"), known, params)
    labelled = written(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    fresh = written(_fresh(labelled, params), "fresh")
    n = {r["toxic"]: r["count"] for r in fresh.groupBy("toxic").count().collect()}
    if not n.get(True) or not n.get(False):
        discard(labelled, fresh)
        return Model(np.zeros(0, np.uint64), np.zeros(0), alpha=params.alpha)
    told = written(_joined(labelled, fresh, params).select("toxic", "text"), "told")
    discard(labelled, fresh)
    keys, score = _token_scores(told, n[True], n[False], params)
    if not len(keys):
        discard(told)
        return Model(keys, score, alpha=params.alpha)
    tally = _tallied(told, Model(keys, score))
    discard(told)
    hits, words = ({kind: sum(r[what] for r in tally if r["toxic"] == kind) for kind in (True, False)} for what in ("n", "words"))
    values, times = np.array(sorted((r["value"], r["n"]) for r in tally if r["toxic"] and r["n"])).reshape(-1, 2).T
    return _with_law(keys, score, values, times, hits[True] / max(1, words[True]), hits[False] / max(1, words[False]), params)


def _joined(docs: DataFrame, known: DataFrame, params: Params) -> DataFrame:
    """(doc_id, text, toxic) of the documents in ``known`` (doc_id, toxic)."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not 0 < known.count() <= params.held_labels:
        return docs.join(known, "doc_id")
    rows = known.toArrow()
    ids, toxic = rows["doc_id"].to_numpy().astype(np.int64), rows["toxic"].to_numpy()
    order = np.argsort(ids)
    shared = docs.sparkSession.sparkContext.broadcast((ids[order], toxic[order].astype(bool)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = shared.value
        for b in batches:
            own = b.column("doc_id").to_numpy()
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            hit = ids[at] == own
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(hit)) for c in b.columns), pa.array(toxic[at][hit])], ["doc_id", "text", "toxic"])

    return docs.mapInArrow(pick, "doc_id long, text string, toxic boolean")


def _fresh(labelled: DataFrame, params: Params) -> DataFrame:
    """(doc_id, toxic) of the documents that share no coordinate with an earlier one of their kind, in an order by hash; ``_distinct`` for a table."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            sig, filled = signatures(b.column("text"), _COORDINATES, _WIDTH, _SEED, hasher)
            rows = np.repeat(np.flatnonzero(filled), _COORDINATES)
            place = np.tile(np.arange(_COORDINATES, dtype=np.int32), int(filled.sum()))
            taken = [b.column(c).take(pa.array(rows)) for c in ("doc_id", "toxic")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(place), pa.array(sig[filled].ravel().astype(np.int64))], ["doc_id", "toxic", "j", "v"])

    signed = labelled.mapInArrow(sign, "doc_id long, toxic boolean, j int, v long")
    first = signed.groupBy("toxic", "j", "v").agg(F.min(F.struct(unit_hash(F.col("doc_id"), params.seed).alias("o"), "doc_id")).alias("first"))
    return first.groupBy(F.col("first.doc_id").alias("doc_id"), "toxic").count().where(F.col("count") == _COORDINATES).select("doc_id", "toxic")


def _token_scores(told: DataFrame, n_t: int, n_c: int, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and scores of the words and beginnings that count, by the documents of each kind that have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for kind in (True, False):
                if (toxic == kind).any():
                    key, y = np.unique(np.concatenate(_presence(b.column("text").filter(pa.array(toxic == kind)), hasher)), return_counts=True)
                    none = np.zeros(len(key), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(y if kind else none), pa.array(none if kind else y)], ["key", "t", "c"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, t, c = (x.to_numpy() for x in b.columns)
            value, good = _log_odds(key, t, c, n_t, n_c, params)
            yield pa.RecordBatch.from_arrays([pa.array(key[good]), pa.array(value[good])], ["key", "score"])

    counts = told.mapInArrow(count, "key long, t long, c long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # a token counts if a share of the documents has it that does not fall with their number: these are few
    found = counts.where("t > 0").mapInArrow(score, "key long, score double").toArrow()
    keys, scores = found["key"].to_numpy().view(np.uint64), found["score"].to_numpy()
    order = np.argsort(keys)
    return keys[order], scores[order]


def _tallied(told: DataFrame, model: Model) -> list:
    """(toxic, value, n, words): how often each score occurs in documents of a kind, and their number of words (at value 0)."""
    shared = told.sparkSession.sparkContext.broadcast(model)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for kind in (True, False):
                values, times, _, words = scorer.tally(b.column("text").filter(pa.array(toxic == kind)))
                size = len(values) + 1
                yield pa.RecordBatch.from_arrays([pa.array([kind] * size), pa.array(np.append(values, 0.0)), pa.array(np.append(times, 0)), pa.array([0] * (size - 1) + [words])], ["toxic", "value", "n", "words"])

    rows = told.mapInArrow(tally, "toxic boolean, value double, n long, words long")
    return rows.groupBy("toxic", "value").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every passage of every toxic document: (doc_id, passage, first_word, last_word, score, e_value, p_value)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: tokens that a share of the labelled documents has

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = [(row, i, x[0], x[1], round(x[2], 4), x[3], p) for row, p, found in scorer.documents(b.column("text")) for i, x in enumerate(found)]
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            ids = b.column("doc_id").take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], ["doc_id", "passage", "first_word", "last_word", "score", "e_value", "p_value"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, passage int, first_word int, last_word int, score double, e_value double, p_value double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            clean[[row for row, _, _ in scorer.documents(b.column("text"))]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
