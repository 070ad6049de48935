"""Exact top-k search with bit-sliced indexes.

Rows that ask are queries: each one's k nearest others, among all rows, by cosine similarity.  The unit
vectors are quantised, and an attribute's bits are kept as slices: bitmaps over
the rows of a block.  A query's weights are quantised too; its scores are the
sum, by bitmap arithmetic (carry-save full adders over whole slices), of the
attribute slices shifted by the weights' bits, with a slice complemented where
the weight is negative.  From the most significant slice of the sum downward,
the k-th largest quantised score is found.  Quantisation is off by at most a
bound that is known from the rounding residuals, so all rows within it of the
k-th are boundary rows: they, and only they, are resolved by exact scores.

Rows and queries are cut into blocks by hash, of bounded size and at least as many as
keep all cores busy; each pair of blocks is a task of its own, and the blocks' bests are
merged by query.  How they are cut does not change the result.

Results in odd cases
  * null vector, vector with a null or non-finite number, or of length zero: neither query nor neighbour.
  * vectors of different dimension: never neighbours.  Null vec_id: takes no part.
  * ties (scores equal to 9 decimals): the smaller vec_id first.
  * repeated rows: rows with one vec_id are one vector (the smallest).
  * fewer than k others: all of them.  An empty table: an empty result.
  * further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

_SCHEMA = "vec_id long, neighbor_id long, score double"


@dataclass(frozen=True)
class Params:
    k: int = 10
    bits: int = 6
    weight_bits: int = 4
    #: Most rows and queries of a block.
    rows_per_block: int = 65_536
    queries_per_block: int = 16_384


def _slices(values: np.ndarray, bits: int) -> np.ndarray:
    """(columns, bits, words): bitmaps over the rows of each column's bits."""
    n = -(-len(values) // 64) * 64
    out = np.zeros((values.shape[1], bits, n // 64), np.uint64)
    for b in range(bits):
        plane = np.zeros((values.shape[1], n), bool)
        plane[:, : len(values)] = (values.T >> b) & 1
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return out


def add_slices(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Slices of the row-wise sum; parts[i]: bitmaps that each count 2 ** i."""
    parts = [list(p) for p in parts]
    out, i = [], 0
    while i < len(parts):
        held = parts[i]
        if i + 1 == len(parts) and len(held) > 1:
            parts.append([])
        while len(held) > 2:
            a, b, c = held.pop(), held.pop(), held.pop()
            x = a ^ b
            held.insert(0, x ^ c)
            parts[i + 1].append((a & b) | (x & c))
        if len(held) == 2:
            a, b = held
            parts[i + 1].append(a & b)
            held = [a ^ b]
        out.append(held[0] if held else None)
        i += 1
    return out


def kth_largest(total: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest row sum, from the most significant slice downward (rows: bitmap of the rows that take part)."""
    above, tied, value = np.zeros_like(rows), rows.copy(), 0
    for i in range(len(total) - 1, -1, -1):
        ones = tied & total[i]
        n = int(np.bitwise_count(above).sum() + np.bitwise_count(ones).sum())
        if n >= k:
            tied = ones
            value |= 1 << i
        else:
            above |= ones
            tied &= ~total[i]
    return value


def at_least(total: list[np.ndarray], rows: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of the rows whose sum is least or more."""
    if least >> len(total):
        return np.zeros_like(rows)
    above, tied = np.zeros_like(rows), rows.copy()
    for i in range(len(total) - 1, -1, -1):
        if least >> i & 1:
            tied &= total[i]
        else:
            above |= tied & total[i]
            tied &= ~total[i]
    return above | tied


class Index:
    def __init__(self, ids: np.ndarray, units: np.ndarray, params: Params) -> None:
        self.params, self.ids, self.units = params, ids, units
        self.low = units.min(0)
        self.step = float(max(1e-12, (units.max(0) - self.low).max() / ((1 << params.bits) - 1)))
        self.codes = np.rint((units - self.low) / self.step).astype(np.int64)
        near = self.low + self.codes * self.step
        self.residual = float(np.sqrt(((units - near) ** 2).sum(1)).max())
        self.norm = float(np.sqrt((near**2).sum(1)).max())
        self.slices = _slices(self.codes, params.bits)
        self.everyone = _slices(np.ones((len(ids), 1), np.int64), 1)[0, 0]

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows among which the k best are, whatever the quantisation did."""
        if len(self.ids) <= k:
            return np.arange(len(self.ids))
        most = (1 << self.params.weight_bits) - 1
        unit = max(1e-12, float(np.abs(query).max()) / most)
        weight = np.rint(query / unit).astype(np.int64)
        error = float(np.sqrt(((query - weight * unit) ** 2).sum())) * self.norm + float(np.sqrt((query**2).sum())) * self.residual
        parts: list[list[np.ndarray]] = [[] for _ in range(self.params.bits + self.params.weight_bits)]
        for j, w in enumerate(weight.tolist()):
            if not w:
                continue
            for b in range(self.params.bits):
                s = self.slices[j, b]
                s = s if w > 0 else ~s
                for e in range(self.params.weight_bits):
                    if abs(w) >> e & 1:
                        parts[b + e].append(s)
        zero = np.zeros_like(self.everyone)
        total = [zero if t is None else t for t in add_slices(parts)]
        cut = kth_largest(total, self.everyone, k) - int(np.ceil(2 * error / (self.step * unit))) - 1
        found = at_least(total, self.everyone, max(0, cut))
        return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: len(self.ids)])

    def search(self, own_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best others."""
        rows = self.candidates(query, self.params.k + 1)
        score = np.round((self.units[rows] * query).sum(1), 9)
        ids = self.ids[rows]
        ok = ids != own_id
        ids, score = ids[ok], score[ok]
        best = np.lexsort((ids, -score))[: self.params.k]
        return ids[best], score[best]


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    flat = t[column].combine_chunks()
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)


def top_k(vectors: DataFrame, params: Params = Params(), asking: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): of every vector that asks (a condition over vec_id; all if it isn't given), the k most similar of all others."""
    x = F.col("embedding").cast("array<double>")
    good = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
    good = good.where(~F.exists("v", lambda e: F.coalesce(F.isnan(e) | (F.abs(e) == float("inf")), F.lit(True))))
    good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    unit = good.withColumn("norm", norm).where("norm > 0").select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda e: e / F.col("norm")).alias("u"))
    unit = written(unit, "vectors")
    queries = unit if asking is None else unit.where(asking)
    n, q = unit.count(), queries.count()
    blocks = max(1, -(-n // params.rows_per_block))
    askers = max(1, -(-q // params.queries_per_block), min(-(-q // 64), -(-unit.sparkSession.sparkContext.defaultParallelism // blocks)))
    row_block, query_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(askers))
    rows = unit.select("dim", row_block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(askers - 1))).alias("q"), "vec_id", "u")
    asks = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), query_block.alias("q"), "vec_id", "u")
    rows, asks = (t.select("dim", F.col("b").cast("long").alias("b"), F.col("q").cast("long").alias("q"), "vec_id", "u") for t in (rows, asks))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            order = np.argsort(right["vec_id"].to_numpy())
            index = Index(right["vec_id"].to_numpy()[order], _matrix(right, "u")[order], params)
            for own, query in zip(left["vec_id"].to_numpy().tolist(), _matrix(left, "u")):
                ids, score = index.search(own, query)
                out.append((np.full(len(ids), own), ids, score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("vec_id", "neighbor_id", "score"), columns)))

    found = asks.groupBy("dim", "b", "q").cogroup(rows.groupBy("dim", "b", "q")).applyInArrow(search, _SCHEMA)
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= params.k).select("vec_id", "rank", "neighbor_id", "score")


SQL = """
WITH u AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
s AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_inner_product(a.v, b.v) / a.n / b.n, 9) AS sim
  FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0 AND a.n > 0 AND b.n > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbor_id) AS INTEGER) AS rank FROM s)
SELECT vec_id, rank, neighbor_id, sim AS score FROM r WHERE rank <= 10
"""
