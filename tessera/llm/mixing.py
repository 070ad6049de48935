"""Mixing sources to target weights by entropy balancing.

Each document i gets a rate w_i, as near to 1 as the constraints let it in the
sense of Kullback and Leibler, such that the tokens of every source add up to
the source's target and those of every language to what they are without
mixing.  The solution tilts exponentially, w = exp(t (a[source] + b[language])) for a
document of t mean lengths; the dual variables a, b minimise the convex

    sum_i w_i - sum_s a[s] target[s] - sum_l b[l] target[l].

Newton's method solves it.  The documents enter by the table of (source,
language, tokens, count) alone, which is aggregated once and written; every
Newton evaluation is one distributed aggregation of it by (source, language),
from which the driver assembles gradient and Hessian.  The Hessian's part for sources
is diagonal, so that they are eliminated and only a system of the size of the
languages is solved: the driver holds a row for each (source, language) that occurs
and a square of languages, nothing that depends on the number of documents.  Rates become copies by
rounding up with the fraction's probability, drawn from a hash of the row (doc_id and
text), so that no shuffle and no order of rows is involved; only where equal rows
occur is the row's place in the table drawn from too.

A token is a piece of text between single spaces or line breaks: their number plus one.

Results in odd cases
  * null or empty text: no tokens, rate 1, one copy.
  * null source or language: a source or language of its own.
  * a source with no tokens: nothing to be weighted, its documents keep rate 1.
  * targets for sources that don't occur: left out, the others scaled up; sources
    without a given target: keep their share of the rest.
  * equal documents: equal rates.  Null or repeated doc_id: each row is drawn for by itself, also where its text is repeated.
  * targets that no rates reach (a language that occurs in one source only may
    contradict it): the damped iteration stops at the nearest it found.
  * an empty table: an empty result.  Further columns pass through ``apply_copies``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import discard, fresh, row_hash, unit_hash, written

#: Rows up to which the table of exponents is sent to every executor.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Params:
    #: Target share of tokens by source; where empty, shares are tempered: (share ** temper), scaled to 1.
    targets: dict[str, float] = field(default_factory=dict)
    temper: float = 0.5
    tolerance: float = 1e-6
    most_iterations: int = 60
    seed: int = 2


def tokens(text: str = "text") -> Column:
    bare = F.replace(F.replace(F.col(text), F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(F.col(text).isNull() | (F.col(text) == ""), F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(bare) + 1).cast("long")


def target_shares(now: dict[str | None, float], params: Params) -> dict[str | None, float]:
    total = sum(now.values())
    if not params.targets:
        raw = {s: (x / total) ** params.temper for s, x in now.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}
    given = {s: float(x) for s, x in params.targets.items() if s in now}
    rest = {s: x / total for s, x in now.items() if s not in given}
    left = max(0.0, 1.0 - sum(given.values())) if rest else 0.0
    got = sum(given.values())
    out = {s: x / got * (1 - left) if got else 0.0 for s, x in given.items()}
    return out | {s: x / sum(rest.values()) * left for s, x in rest.items()}


def solve(cells: list[tuple], evaluate, mean: float, params: Params) -> tuple[np.ndarray, list]:
    """Dual variables by damped Newton steps.

    cells: (source, language, tokens) with tokens above zero.  evaluate(exponents): for each cell, sums of w, w t and w t^2.
    """
    index = lambda at: {x: i for i, x in enumerate(sorted({c[at] for c in cells}, key=lambda x: (x is not None, x)))}
    sources, langs = index(0), index(1)
    own_s, own_l = np.array([sources[c[0]] for c in cells]), np.array([langs[c[1]] for c in cells])
    n_s, n_l = len(sources), len(langs)
    up = lambda x: np.concatenate([np.bincount(own_s, x, n_s), np.bincount(own_l, x, n_l)])
    down = lambda x: x[own_s] + x[n_s + own_l]
    amount = np.array([c[2] for c in cells]) / mean
    by_source = np.bincount(own_s, amount, n_s)
    share = target_shares({s: float(by_source[j]) for s, j in sources.items()}, params)
    goal = np.concatenate([[share[s] * amount.sum() for s in sources], np.bincount(own_l, amount, n_l)])

    def newton(curve: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """The step, with the sources eliminated.  Adding to all sources what is taken from all languages changes nothing: of all solutions the least."""
        d = np.bincount(own_s, curve, n_s)
        d = d + 1e-12 * d.sum()
        cross = np.zeros((n_l, n_s))
        np.add.at(cross, (own_l, own_s), curve)
        square = np.diag(np.bincount(own_l, curve, n_l)) - (cross / d) @ cross.T
        at_l = np.linalg.lstsq(square, slope[n_s:] - cross @ (slope[:n_s] / d), rcond=1e-10)[0]
        return -np.concatenate([(slope[:n_s] - cross.T @ at_l) / d, at_l])

    dual = np.zeros(n_s + n_l)
    value = lambda sums, x: sums[:, 0].sum() - x @ goal
    sums = evaluate(down(dual))
    now = value(sums, dual)
    for _ in range(params.most_iterations):
        slope = up(sums[:, 1]) - goal
        if np.abs(slope).max() <= params.tolerance * amount.sum():
            break
        step = newton(sums[:, 2], slope)
        size, moved = min(1.0, 2.0 / max(1e-9, np.abs(down(step)).max())), False
        while size > 1e-6:
            trial = dual + size * step
            got = evaluate(down(trial))
            if np.isfinite(got).all() and value(got, trial) <= now + 1e-4 * size * (slope @ step):
                dual, sums, now, moved = trial, got, value(got, trial), True
                break
            size /= 2
        if not moved:
            break
    return dual, [(c[0], c[1], float(x) / mean) for c, x in zip(cells, down(dual))]


def exponents(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(source, lang, exponent per token) for every pair that occurs with tokens."""
    spark = docs.sparkSession
    kind = T.StructType([T.StructField("m_source", T.StringType()), T.StructField("m_lang", T.StringType()), T.StructField("m_exponent", T.DoubleType())])
    histogram = written(docs.select(F.col("source").cast("string").alias("m_source"), F.col("lang").cast("string").alias("m_lang"), tokens().alias("m_tokens")).where("m_tokens > 0").groupBy("m_source", "m_lang", "m_tokens").agg(F.count("*").alias("m_n")), "lengths")
    cells = [tuple(r) for r in histogram.groupBy("m_source", "m_lang").agg(F.sum(F.col("m_tokens") * F.col("m_n")).cast("double"), F.sum("m_n")).collect()]
    if not cells:
        return spark.createDataFrame([], kind)
    mean = sum(c[2] for c in cells) / sum(c[3] for c in cells)
    order = {(c[0], c[1]): i for i, c in enumerate(cells)}

    def evaluate(exponent: np.ndarray) -> np.ndarray:
        rows = [(c[0], c[1], float(x)) for c, x in zip(cells, exponent)]
        t = F.col("m_tokens") / F.lit(mean)
        w = F.col("m_n") * F.exp(F.col("m_exponent") * t)
        got = with_exponent(histogram, spark.createDataFrame(rows, kind), len(rows), "m_source", "m_lang").groupBy("m_source", "m_lang").agg(F.sum(w), F.sum(w * t), F.sum(w * t * t)).collect()
        out = np.zeros((len(cells), 3))
        for r in got:
            out[order[r[0], r[1]]] = r[2:]
        return out

    _, found = solve([c[:3] for c in cells], evaluate, mean, params)
    discard(histogram)
    return spark.createDataFrame(found, kind)


def with_exponent(rows: DataFrame, exponent: DataFrame, n: int, source: str, lang: str, name: str = "m_exponent") -> DataFrame:
    """Adds the exponent by that name; sent to every executor if it is small, else joined by key."""
    s, l = fresh([*rows.columns, name], "__s", "__l")
    side = exponent.select(F.col("m_source").alias(s), F.col("m_lang").alias(l), F.col("m_exponent").alias(name))
    if n <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return rows.join(side, rows[source].cast("string").eqNullSafe(side[s]) & rows[lang].cast("string").eqNullSafe(side[l]), "left").drop(s, l)


def _copies(rate: Column, draw: Column) -> Column:
    return F.floor(rate + draw).cast("int")


def _rated(docs: DataFrame, params: Params) -> tuple[DataFrame, Column, str]:
    """The documents with their exponent and a column of draws, the rate, and the draws' name."""
    found = exponents(docs, params)
    name, draw = fresh(docs.columns, "__exponent", "__draw")
    key = row_hash("doc_id", "text")
    repeated = not docs.groupBy(key).count().where("count > 1").isEmpty()
    drawn = docs.withColumn(draw, unit_hash(F.struct(key, F.monotonically_increasing_id()) if repeated else key, params.seed))
    return with_exponent(drawn, found, found.count(), "source", "lang", name), F.exp(F.coalesce(name, F.lit(0.0)) * tokens()), draw


def rates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) of every document."""
    rated, rate, draw = _rated(docs.select("doc_id", "source", "lang", "text"), params)
    return rated.select("doc_id", "source", tokens().alias("tokens"), F.round(rate, 6).alias("rate"), _copies(rate, F.col(draw)).alias("copies"))


def apply_copies(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Every document as many times as it has copies, with all its columns."""
    rated, rate, draw = _rated(docs, params)
    repeated = rated.withColumn(fresh(rated.columns, "__copy")[0], F.explode(F.array_repeat(F.lit(0), _copies(rate, F.col(draw)))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
