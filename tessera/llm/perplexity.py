"""Quality by n-gram perplexity.

A modified Kneser-Ney model over the bytes of lower-cased text, one for each
language, counted by Spark over all documents: every task counts the n-grams of
highest order of its texts in arrays, a shuffle adds them up, and the lower
orders' continuation counts, the discounts (from counts of counts) and the
interpolated probabilities are aggregations and joins of those tables.  For
scoring, the model is a sorted array of hashed n-grams with an index by leading
bits, looked up for whole arrays of text positions.

The arrays are made where the counts are: sorted by hash over ranges and written to the
shared folder, from where every executor fetches the files; the driver never holds
them.  A model of more than ``part_entries`` is cut by (language, last two bytes of the
context).  All that a position needs, back-off included, is in one part, and
log-probabilities add up, so each part scores its positions in a pass of its own and
the sums are added.  The result is the same.

Bands: for each language, a document's log-perplexity is compared with the
median of the long documents; its spread is their median deviation, widened
for short texts by the within-document variance of a byte's log-probability over
the length.  With labels, a language's band is that which leaves out the share
``tail`` of its documents of quality 1 at either end; one with less than
``least_clean`` of them takes the band of all languages' together.  Without labels,
or without that many, documents below ``lower`` or above ``upper`` spreads are rejected.

Results in odd cases
  * null or empty text: nothing to score, rejected.
  * null language: a language of its own, with its own model and bands.
  * every row is a document, whether its doc_id is null or repeated or not.
  * a language without a document of ``long_bytes``: its median is that of all.
  * a language with no spread at all (one document): nothing is rejected.
  * labels with null or repeated doc_id: left out, and counted once.
  * a text longer than any buffer: scored whole.  An empty table: an empty result.
  * further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textbytes import mix64, runs
from .workspace import discard, new_path, written

#: Of 6, which was tried, fewer of the labelled junk documents are told apart: a model of the texts that it scores remembers them.
ORDER = 5
_PAD = 10


@dataclass(frozen=True)
class Params:
    lower: float = 4.0
    upper: float = 6.0
    widening: float = 2.0
    long_bytes: int = 1500
    #: Entries (of 12 bytes, and 4 to 8 of index) of the model that a Python worker holds at a time.
    part_entries: int = 12_000_000
    tail: float = 0.002
    least_clean: int = 200


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and packed n-gram (context in the higher bytes) that ends at each byte; line breaks stand before a text."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded = np.full(len(raw) + (ORDER - 1) * (len(offsets) - 1), _PAD, np.uint8)
    at = np.arange(len(raw)) + (of + 1) * (ORDER - 1)
    padded[at] = raw
    code = np.zeros(len(raw), np.uint64)
    for j in range(ORDER - 1, -1, -1):
        code = (code << np.uint64(8)) | padded[at - j]
    return of, code


def _languages(docs: DataFrame) -> list[str | None]:
    return sorted((r[0] for r in docs.select(F.col("lang").cast("string")).distinct().collect()), key=lambda x: (x is not None, x))


def _language_ids(column: pa.Array, languages: list[str | None]) -> np.ndarray:
    return pc.index_in(column.cast(pa.string()), pa.array(languages, pa.string()), skip_nulls=False).to_numpy(zero_copy_only=False).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def counts(docs: DataFrame, languages: list[str | None]) -> DataFrame:
    """(l, g, c): how often each n-gram of highest order occurs in a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            lang = _language_ids(b.column("lang"), languages).astype(np.uint64)
            for first, _, raw, offsets in runs(b.column("text")):
                of, code = grams(raw, offsets)
                if len(code):
                    key, n = np.unique((lang[first + of] << np.uint64(8 * ORDER)) | code, return_counts=True)
                    parts.append((key, n))
            if sum(len(k) for k, _ in parts) > 4_000_000:
                parts = [_merged(parts)]
        if parts:
            key, n = _merged(parts)
            for at in range(0, len(key), 100_000):
                k = key[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(8 * ORDER)).astype(np.int32)), pa.array((k & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)), pa.array(n[at : at + 100_000].astype(np.int64))], ["l", "g", "n"])

    told = docs.where("length(text) > 0").select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(count, "l int, g long, n long")
    return told.groupBy("l", "g").agg(F.sum("n").alias("c"))


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from numbers of n-grams that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(float(i + 1), max(0.0, x)) for i, x in enumerate(d))  # type: ignore[return-value]


def model_table(docs: DataFrame, languages: list[str | None]) -> DataFrame:
    """(kind, l, g, v): kind n < 10: log-probability of the n-gram g; kind 10 + n: log-weight of backing off from the context g of n bytes."""
    spark = docs.sparkSession
    orders = {ORDER: written(counts(docs, languages), "ngrams")}
    for n in range(ORDER - 1, 0, -1):
        orders[n] = orders[n + 1].groupBy("l", F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("g")).agg(F.count("*").alias("c"))
        orders[n] = written(orders[n], "ngrams")
    lower, out, done = None, [], [*orders.values()]
    for n in range(1, ORDER + 1):
        t = orders[n]
        seen: dict[int, dict[int, int]] = {}
        for l, c, m in t.where("c <= 4").groupBy("l", "c").count().collect():
            seen.setdefault(l, {})[c] = m
        d = spark.createDataFrame([(l, *discounts(seen.get(l, {}))) for l in range(len(languages))], "l int, d1 double, d2 double, d3 double")
        t = t.join(F.broadcast(d), "l")
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftright("g", 8).alias("h")
        left = t.groupBy("l", context).agg(F.sum("c").alias("total"), F.sum(F.least(cut, F.col("c").cast("double"))).alias("mass")).withColumn("back", F.col("mass") / F.col("total"))
        t = t.withColumn("h", context).join(left, ["l", "h"])
        if lower is None:
            below = t.withColumn("q", F.lit(1 / 256))
        else:
            below = t.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(lower.select("l", F.col("g").alias("s"), F.col("p").alias("q")), ["l", "s"])
        lower = written(below.select("l", "g", (F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total") + F.col("back") * F.col("q")).alias("p")), "probabilities")
        done.append(lower)
        out.append(lower.select(F.lit(n).alias("kind"), "l", "g", F.log("p").alias("v")))
        out.append(left.where("back > 0").select(F.lit(10 + n - 1).alias("kind"), "l", F.col("h").alias("g"), F.log("back").alias("v")))
    table = out[0]
    for t in out[1:]:
        table = table.unionByName(t)
    table = written(table, "model")
    discard(*done)
    return table


def _key(kind: int, l: np.ndarray, g: np.ndarray) -> np.ndarray:
    return mix64((np.uint64(kind) << np.uint64(59)) | (l << np.uint64(8 * ORDER)) | g)


class SortedHashes:
    """Values by hash: a sorted array, entered by an index of the hashes' leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length()))
        self.start = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)
        self.start = np.append(self.start, len(keys)).astype(np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """NaN for keys that aren't there."""
        out = np.full(len(keys), np.nan, np.float32)
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        rest = np.flatnonzero(at < end)
        at, end, keys = at[rest], end[rest], keys[rest]
        while len(rest):
            hit = self.keys[at] == keys
            out[rest[hit]] = self.values[at[hit]]
            on = ~hit & (at + 1 < end)
            rest, at, end, keys = rest[on], at[on] + 1, end[on], keys[on]
        return out


def _kind_code(kind: int) -> int:
    return kind if kind < 10 else kind - 10 + 8 + 6  # up to 13, and 14 and more for contexts: five bits, above those of the language


_FLIP = np.uint64(1 << 63)  # signed numbers in the order of unsigned ones


def stored(spark: SparkSession, rows: DataFrame) -> list[str]:
    """Writes (kind, l, g, v) as arrays sorted by hash; the names of the files, in order, as every executor can fetch them."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, l, g = (b.column(c).to_numpy() for c in ("kind", "l", "g"))
            keys = np.zeros(len(kind), np.uint64)
            for k in np.unique(kind):
                own = kind == k
                keys[own] = _key(_kind_code(int(k)), l[own].astype(np.uint64), g[own].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((keys ^ _FLIP).view(np.int64)), b.column("v").cast(pa.float32())], ["k", "v"])

    path = new_path(spark, "arrays")
    n = max(1, -(-rows.count() // 1_000_000))
    rows.select("kind", "l", "g", "v").mapInArrow(keyed, "k long, v float").repartitionByRange(n, "k").sortWithinPartitions("k").write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = sorted(f.getPath().toString() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.getPath().getName().endswith(".parquet"))
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rpartition("/")[2] for f in files]


_held: dict[tuple[str, ...], SortedHashes] = {}


def fetched(names: list[str]) -> SortedHashes:
    """The arrays of a part, in a Python worker; one part at a time stays for the worker's next tasks."""
    key = tuple(names)
    if key not in _held:
        _held.clear()
        files = [pq.ParquetFile(SparkFiles.get(n)) for n in names]
        n = sum(f.metadata.num_rows for f in files)
        keys, values, at = np.empty(n, np.uint64), np.empty(n, np.float32), 0
        for f in files:
            for b in f.iter_batches(1 << 18):
                end = at + b.num_rows
                keys[at:end] = b.column("k").to_numpy().view(np.uint64) ^ _FLIP
                values[at:end] = b.column("v").to_numpy()
                at = end
        _held[key] = SortedHashes(keys, values)
    return _held[key]


def log_probabilities(model: SortedHashes, l: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Of each position's byte after the bytes before it, backing off where an n-gram wasn't seen."""
    out = model.get(_key(ORDER, l, code)).astype(float)
    rest, weight = np.flatnonzero(np.isnan(out)), np.zeros(len(code))
    for n in range(ORDER - 1, 0, -1):
        if not len(rest):
            break
        context = (code[rest] >> np.uint64(8)) & np.uint64((1 << 8 * n) - 1)
        back = model.get(_key(_kind_code(10 + n), l[rest], context))
        weight[rest] += np.where(np.isnan(back), 0, back)
        got = model.get(_key(n, l[rest], code[rest] & np.uint64((1 << 8 * n) - 1)))
        ok = ~np.isnan(got)
        out[rest[ok]] = got[ok] + weight[rest[ok]]
        rest = rest[~ok]
    if len(rest):
        back = model.get(_key(_kind_code(10), l[rest], np.zeros(len(rest), np.uint64)))
        out[rest] = weight[rest] + np.where(np.isnan(back), 0, back) - np.log(256)
    return out


def _parts(model: DataFrame, most: int) -> list[tuple[DataFrame, list[tuple[int, int, int]]]]:
    """The model's rows part by part, with the (language, last, last but one byte of the context) whose positions it can score; all in one part if that is not too much."""
    if model.count() <= most:
        return [(model, [])]
    context = F.when(F.col("kind") < 10, F.shiftright("g", 8)).otherwise(F.col("g"))
    size = F.when(F.col("kind") < 10, F.col("kind") - 1).otherwise(F.col("kind") - 10)  # bytes of context
    cut = model.withColumn("b1", F.when(size >= 1, context.bitwiseAND(F.lit(255))).otherwise(-1).cast("int"))
    cut = cut.withColumn("b2", F.when(size >= 2, F.shiftright(context, 8).bitwiseAND(F.lit(255))).otherwise(-1).cast("int"))
    parts: list[list[tuple[int, int, int]]] = [[]]
    held = 0
    for l, b1, b2, n in sorted(tuple(r) for r in cut.where("b2 >= 0").groupBy("l", "b1", "b2").count().collect()):  # 65,536 a language at most
        if held and held + n > most:
            parts.append([])
            held = 0
        held += n
        parts[-1].append((l, b1, b2))
    out = []
    for places in parts:
        own = model.sparkSession.createDataFrame([*places, *{(l, b1, -1) for l, b1, _ in places}, *{(l, -1, -1) for l, _, _ in places}] or [(-1, -1, -1)], "l int, b1 int, b2 int")
        shared = cut.where("b2 < 0") if not out else cut.join(F.broadcast(own), ["l", "b1", "b2"]).where("b2 < 0")  # the first also scores what the model doesn't know
        out.append((cut.join(F.broadcast(own), ["l", "b1", "b2"]).where("b2 >= 0").select(*model.columns).unionByName(shared.select(*model.columns)), places))
    return out


def scores(docs: DataFrame, params: Params, languages: list[str | None]) -> DataFrame:
    """(doc_id, l, s, s2, n): sums of log-probabilities and of their squares, and bytes."""
    spark = docs.sparkSession
    model = model_table(docs, languages)
    parts = _parts(model, params.part_entries)
    passes = []
    texts = docs.where("length(text) > 0").select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), "text", F.monotonically_increasing_id().alias("place"))
    for number, (rows, places) in enumerate(parts):
        names, here = stored(spark, rows), None
        if len(parts) > 1:
            here = np.zeros((max(1, len(languages)), 1 << 16), bool)
            of = lambda x: ([l for l, _, _ in x], [b1 << 8 | b2 for _, b1, b2 in x])
            here[of(places)] = True
            if not number:  # also what the model doesn't know
                here[:] = True
                here[of([p for _, x in parts[1:] for p in x])] = False
        shared = spark.sparkContext.broadcast((names, here))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, here = shared.value
            m = fetched(names)
            for b in batches:
                lang = _language_ids(b.column("lang"), languages)
                sums = np.zeros((3, b.num_rows))
                for first, after, raw, offsets in runs(b.column("text")):
                    of, code = grams(raw, offsets)
                    of += first
                    if here is not None:
                        context = (code >> np.uint64(8)).astype(np.int64)
                        mine = here[lang[of], (context & 255) << 8 | context >> 8 & 255]
                        of, code = of[mine], code[mine]
                    v = log_probabilities(m, lang[of].astype(np.uint64), code)
                    at, n = of - first, after - first
                    sums[:, first:after] += [np.bincount(at, v, n), np.bincount(at, v * v, n), np.bincount(at, minlength=n)]
                yield pa.RecordBatch.from_arrays([b.column("place"), b.column("doc_id"), pa.array(lang.astype(np.int32)), *(pa.array(x) for x in sums)], ["place", "doc_id", "l", "s", "s2", "n"])

        passes.append(texts.mapInArrow(score, "place long, doc_id long, l int, s double, s2 double, n double"))
    discard(model)
    if len(passes) == 1:
        return passes[0].drop("place")
    table = passes[0]
    for t in passes[1:]:
        table = table.unionByName(t)
    return table.groupBy("place", "doc_id", "l").agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum("n").alias("n")).drop("place")


def _median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values)
    at = np.searchsorted(np.cumsum(n[order]), n.sum() / 2)
    return float(values[order][min(at, len(order) - 1)])


def bands(scored: DataFrame, params: Params) -> list[tuple[int, float, float, float]]:
    """(l, median, spread, byte variance), from histograms of log-perplexity in steps of a thousandth."""
    long = Window.partitionBy("l")
    steps = scored.groupBy("l", F.round(-F.col("s") / F.col("n") * 1000).cast("int").alias("step")).agg(F.count("*").alias("every"), F.count_if(F.col("n") >= params.long_bytes).alias("long"), F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("var"), F.sum("n").alias("bytes"))
    rows = steps.withColumn("any", F.sum("long").over(long)).collect()
    out = []
    for l in sorted({r["l"] for r in rows}):
        own = [r for r in rows if r["l"] == l]
        value = np.array([r["step"] / 1000 for r in own])
        n = np.array([r["long"] if r["any"] else r["every"] for r in own], float)
        median = _median(value, n)
        out.append((l, median, 1.4826 * _median(np.abs(value - median), n), sum(r["var"] for r in own) / sum(r["bytes"] for r in own)))
    return out


def rated(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, lang, perplexity, deviation): deviation in spreads of its language, of every document with text."""
    spark = docs.sparkSession
    languages = _languages(docs)
    scored = written(scores(docs, params, languages), "scores")
    limits = spark.createDataFrame([(*x, languages[x[0]]) for x in bands(scored, params)], "l int, median double, spread double, var double, lang string")
    value = -F.col("s") / F.col("n")
    spread = F.sqrt(F.col("spread") * F.col("spread") + params.widening * F.col("var") / F.col("n"))
    return scored.join(F.broadcast(limits), "l").select("doc_id", "lang", F.round(F.exp(value), 4).alias("perplexity"), F.round(F.when(spread > 0, (value - F.col("median")) / spread).otherwise(0.0), 4).alias("deviation"))


def clean_bands(rates: DataFrame, labels: DataFrame, params: Params) -> tuple[tuple[float, float], dict[str | None, tuple[float, float]]]:
    """(least, most) deviation for languages without a band of their own, and by language, from all documents of quality 1."""
    clean = rates.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id")
    ends = [F.count("*").alias("n"), F.percentile("deviation", F.array(F.lit(params.tail), F.lit(1 - params.tail))).alias("ends")]
    enough = lambda t: t.where(F.col("n") >= params.least_clean).collect()
    every = enough(clean.agg(*ends))
    own = {r["lang"]: tuple(r["ends"]) for r in enough(clean.groupBy("lang").agg(*ends))}
    return tuple(every[0]["ends"]) if every else (-params.lower, params.upper), own


def kept(docs: DataFrame, params: Params = Params(), labels: DataFrame | None = None) -> DataFrame:
    """The documents within their language's bands."""
    rates = rated(docs, params)
    every, own = clean_bands(rates, labels, params) if labels is not None else ((-params.lower, params.upper), {})
    within = F.col("deviation").between(*every)
    for lang, ends in own.items():
        within = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.col("deviation").between(*ends)).otherwise(within)
    return rates.where(within)
