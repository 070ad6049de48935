"""Near-duplicate documents by a signature-coordinate inverted join.

Each document's MinHash signature (``k`` minima of hashed word shingles) is
posted under every (coordinate, value) pair.  Documents whose signatures agree
in at least ``matches`` coordinates are near duplicates.

  1. Documents with equal signatures are one class: they agree with everything
     the class agrees with.
  2. Prefix: with the coordinate-value pairs of a class ordered by how many
     classes hold them, two classes that agree in ``matches`` of ``k``
     coordinates share one of each one's ``k - matches + 1`` rarest pairs.  Pairs
     held by one class only are the rarest of all, so that a document unlike
     any other has no postings left, and pairs made popular by a passage that
     many documents share stay out of nearly every prefix.
  3. Skip: the short (prefix) lists are merged, the long ones are not; whether
     two classes of a short list agree under the others is read from their
     signatures.

Lists are merged for links first: within a list a class is compared until it is
linked, so that a list of n copies costs about n comparisons.  A list of more than
``block`` classes is cut into blocks, each a group of its own; where blocks that the
links of other lists have not joined remain, every pair of blocks is merged.  The
links' connected components are the classes of the result.

``linked`` also counts each document's links.  Signatures are points of a Hamming
space, so with the component's most frequent value of every coordinate as its
centre, two classes at distances x and y from it agree if x + y <= k - matches:
those are counted from a histogram of distances.  Only pairs beyond that are
compared, in the list of the lowest coordinate in which both agree and that both
have in their prefixes.  No pair is ever a row.

Nothing is capped: the search is exact for the signatures.  The one
approximation is that agreement estimates the Jaccard similarity of shingles.

Results in odd cases
  * null or empty text, or text without words: no near duplicate of anything; a class of its own.
  * rows with null or repeated doc_id: each is a document.  A class without any doc_id has class_id null.
  * text shorter than the shingle: one shingle of all its words.
  * of a group of near duplicates ``keep_one`` keeps one row: that of the smallest doc_id (null after all
    others), of several such rows (repeated ones) one of the text with the least hash.
  * an empty table: an empty result.  ``keep_one`` passes further columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import signatures
from .textbytes import Hasher
from .workspace import discard, fresh, passed_on, row_hash, written


@dataclass(frozen=True)
class Params:
    k: int = 64
    matches: int = 36
    width: int = 3
    seed: int = 7
    #: Classes up to which a list is one task's group; a longer one is cut into blocks.
    block: int = 4096


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _binary(rows: np.ndarray) -> pa.Array:
    """One fixed-size row of a 2-d array for each binary value."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _rows(column: pa.Array, k: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, k), np.uint32)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32).reshape(-1, k)


def _signed(column: pa.Array, params: Params, hasher: Hasher) -> pa.Array:
    """Signatures as binary values, null for texts without words."""
    sig, filled = signatures(column, params.k, params.width, params.seed, hasher)
    return pc.if_else(pa.array(filled), _binary(sig), pa.scalar(None, pa.binary()))


def signature_table(docs: DataFrame, params: Params) -> DataFrame:
    """(doc_id, sig) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            yield _batch({"doc_id": b.column("doc_id"), "sig": _signed(b.column("text"), params, hasher)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, sig binary")


def signature_classes(docs: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sig) of every row; classes of equal signatures: (sig, first doc_id, n rows, class)."""
    signed = written(signature_table(docs, params), "signatures")
    once = signed.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return signed, written(once.withColumn("class", F.monotonically_increasing_id()), "classes")


def _cuts(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        x = t[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, with their borders: the last group of what is held waits for more."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        if sum(x.num_rows for x in held) < 20_000:
            continue
        t = pa.concat_tables(held).combine_chunks()
        cut = _cuts(t, keys)
        held = [t.slice(cut[-2])]
        if cut[-2]:
            yield t.slice(0, cut[-2]).combine_chunks(), cut[:-1]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, _cuts(t, keys)


def _posted(classes: DataFrame, params: Params) -> DataFrame:
    """(class, pair, root where there is one): each signature's coordinate-value pairs."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(params.k, dtype=np.int64) << 32
        for b in batches:
            sig = _rows(b.column("sig"), params.k)
            others = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != "sig"}
            for at in range(0, len(sig), 1024):
                part = sig[at : at + 1024].astype(np.int64) | place
                yield _batch({**{c: pa.array(np.repeat(x[at : at + 1024], params.k)) for c, x in others.items()}, "pair": pa.array(part.ravel())})

    kept = [f"{c} long" for c in classes.columns if c != "sig"]
    return classes.mapInArrow(post, ", ".join([*kept, "pair long"]))


def _prefixes(classes: DataFrame, params: Params) -> DataFrame:
    """(class, pair, held, prefix): the pairs of each class's prefix that others hold too, by how many, and as bits the prefix's coordinates."""
    most = params.k - params.matches + 1
    posted = _posted(classes.select("class", "sig"), params)
    held = written(posted.groupBy("pair").agg(F.count("*").alias("held")).where("held > 1"), "held")  # counted before the shuffle, so that popular pairs are few rows

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _grouped(batches, ("class",)):
            ids, pair, n = (t[c].to_numpy() for c in ("class", "pair", "held"))
            size = np.diff(cut)
            rank = np.arange(len(ids)) - np.repeat(cut[:-1], size)
            chosen = (rank + np.repeat(params.k - size, size) < most) & np.repeat(size >= params.matches, size)  # pairs that no other class holds come first
            bits = np.where(chosen, np.uint64(1) << (pair >> 32).astype(np.uint64), np.uint64(0))
            mask = np.repeat(np.bitwise_or.reduceat(bits, cut[:-1]), size).view(np.int64)
            yield _batch({"class": pa.array(ids[chosen]), "pair": pa.array(pair[chosen]), "held": pa.array(n[chosen]), "prefix": pa.array(mask[chosen])})

    live = posted.join(held, "pair").repartition("class").sortWithinPartitions("class", "held", "pair")
    prefixes = written(live.select("class", "pair", "held").mapInArrow(choose, "class long, pair long, held long, prefix long"), "prefixes")
    discard(held)
    return prefixes


def _blocked(lists: DataFrame, params: Params, across: bool) -> DataFrame:
    """With the group of blocks (i, j) and the row's own block; with ``across`` a row meets every block of its list, else its own."""
    blocks = F.greatest(F.ceil(F.col("held") / params.block), F.lit(1)).cast("int")
    own = lists.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class", "pair"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if across else F.col("own")
    return own.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other", "held")


def _low_bit(bits: np.ndarray) -> np.ndarray:
    return bits & (~bits + np.uint64(1))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(1)


def _list_links(sig: np.ndarray, matches: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join exactly what the list's pairs join: each class is compared until it is linked."""
    rest = np.arange(len(sig))
    while len(rest) > 1:
        group, outside = [rest[0]], rest[1:]
        at = 0
        while at < len(group) and len(outside):
            near = _agree(sig[outside], sig[group[at]]) >= matches
            if near.any():
                j = outside[near]
                yield np.full(len(j), group[at]), j
                group += j.tolist()
                outside = outside[~near]
            at += 1
        rest = outside


def _merged_links(blocked: DataFrame, params: Params) -> DataFrame:
    """(a, b) links of the groups of (pair, i, j)."""
    keys = ("pair", "i", "j")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _grouped(batches, keys):
            sig, ids = _rows(t["sig"], params.k), t["class"].to_numpy()
            found = [(ids[i + cut[x]], ids[j + cut[x]]) for x in np.flatnonzero(np.diff(cut) > 1) for i, j in _list_links(sig[cut[x] : cut[x + 1]], params.matches)]
            if found:
                i, j = (np.concatenate(x) for x in zip(*found))
                yield _batch({"a": pa.array(np.minimum(i, j)), "b": pa.array(np.maximum(i, j))})

    rows = blocked.select(*keys, "class", "sig").repartition(*keys).sortWithinPartitions(*keys, "class")
    return rows.mapInArrow(merge, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) edges is connected with, by alternating stars.

    Every round joins and groups by node; the edges are written to the shared folder between rounds.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
        large = both.where("b > a").join(least, "a").select(F.col("root").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("root"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("root").alias("a"), "b"), F.struct(F.col("root").alias("a"), F.col("a").alias("b")))).alias("e"))
        last, now = now, written(small.select("e.a", "e.b").where("a < b").distinct(), "edges")
        discard(last)
        stand = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stand == before or not stand[0]:
            return passed_on(now.select(F.col("b").alias("node"), F.col("a").alias("root")), now)
        before = stand


def _rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """With each class's root, its own number where it has no link."""
    return classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def class_components(classes: DataFrame, prefixes: DataFrame, params: Params) -> DataFrame:
    """(node, root) of the classes that links connect with a smaller one."""
    signed = classes.select("class", "sig")
    links = written(_merged_links(_blocked(prefixes.join(signed, "class"), params, across=False), params), "links")
    roots = components(links)
    long = prefixes.where(F.col("held") > params.block)
    if not long.isEmpty():
        apart = _rooted(long, roots).groupBy("pair").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("pair")
        more = _merged_links(_blocked(long.join(apart, "pair").join(signed, "class"), params, across=True), params)
        first, roots = roots, components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))
        discard(first)
    discard(links)
    return roots


def _centred(members: DataFrame, params: Params) -> DataFrame:
    """members (class, root, n, sig) with ``d``, the distance from the component's most frequent value of every coordinate."""
    votes = _posted(members.select("root", "n", "sig"), params).groupBy("root", "pair").agg(F.sum("n").alias("n"))
    modes = votes.groupBy("root", F.shiftright("pair", 32).alias("coordinate")).agg(F.max_by("pair", F.struct("n", "pair")).alias("pair"))
    centres = modes.groupBy("root").agg(F.array_sort(F.collect_list("pair")).alias("centre"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                centre = b.column("centre").flatten().to_numpy().astype(np.uint32).reshape(-1, params.k)
                d = params.k - _agree(_rows(b.column("sig"), params.k), centre)
                yield _batch({**{c: b.column(c) for c in ("class", "root", "n", "sig")}, "d": pa.array(d.astype(np.int32))})

    return members.join(centres, "root").select("class", "root", "n", "sig", "centre").mapInArrow(measure, "class long, root long, n long, sig binary, d int")


def _compared(lists: DataFrame, params: Params) -> DataFrame:
    """(class, n): the rows of other classes that each class agrees with, among pairs whose distances don't tell."""
    keys, far = ("pair", "root", "i", "j"), params.k - params.matches

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.uint64(1) << np.arange(params.k, dtype=np.uint64)
        for t, cut in _grouped(batches, keys):
            ids, n, d, own, pair, i_, j_ = (t[c].to_numpy() for c in ("class", "n", "d", "own", "pair", "i", "j"))
            sig, prefix, links = _rows(t["sig"], params.k), t["prefix"].to_numpy().view(np.uint64), np.zeros(t.num_rows, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                bit = np.uint64(1) << np.uint64(int(pair[a]) >> 32)
                for x in range(a, b - 1):  # d descends: those beyond reach by distance alone come first
                    end = a + int(np.searchsorted(-d[a:b], d[x] - far))
                    if end <= x + 1:
                        break
                    y = np.arange(x + 1, end)
                    if i_[a] != j_[a]:
                        y = y[own[y] != own[x]]
                    same = sig[y] == sig[x]
                    y, same = (v[same.sum(1) >= params.matches] for v in (y, same))
                    y = y[_low_bit((same.astype(np.uint64) @ place) & prefix[y] & prefix[x]) == bit]
                    links[x] += n[y].sum()
                    links[y] += n[x]
            some = links > 0
            yield _batch({"class": pa.array(ids[some]), "n": pa.array(links[some])})

    rows = _blocked(lists, params, across=True).select(*keys, "own", "class", "n", "d", "prefix", "sig")
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("d"), "class").mapInArrow(merge, "class long, n long").groupBy("class").agg(F.sum("n").alias("links"))


def class_links(classes: DataFrame, roots: DataFrame, prefixes: DataFrame, params: Params) -> DataFrame:
    """(class, links): how many rows of other classes each class agrees with; only of classes that have links."""
    far = params.k - params.matches
    linked = roots.select(F.col("node").alias("class"), "root").union(roots.select("root", "root").distinct().toDF("class", "root"))
    members = written(_centred(linked.join(classes.select("class", "n", "sig"), "class"), params), "members")
    by_distance = members.groupBy("root", "d").agg(F.sum("n").alias("n"))
    histogram = by_distance.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("rows"), F.max("d").alias("most"))
    known = members.join(histogram, "root")
    near = F.aggregate(F.map_values(F.map_filter("rows", lambda d, n: d + F.col("d") <= far)), F.lit(0).cast("long"), lambda a, n: a + n)
    sure = known.select("class", (near - F.when(F.col("d") * 2 <= far, F.col("n")).otherwise(0)).alias("links"))
    unsure = known.where(F.col("d") + F.col("most") > far).select("class", "root", "n", "sig", "d")
    counted = sure if unsure.isEmpty() else sure.union(_compared(prefixes.join(unsure, "class"), params))
    return passed_on(counted.groupBy("class").agg(F.sum("links").alias("links")), members)


def linked(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, class_id, links) of every row.

    class_id: the smallest doc_id that near duplicates of near duplicates lead to; links: the number of rows that the row itself is a near duplicate of.
    """
    signed, classes = signature_classes(docs, params)
    prefixes = _prefixes(classes, params)
    roots = class_components(classes, prefixes, params)
    links = class_links(classes, roots, prefixes, params)
    known = _rooted(classes.select("class", "first", "n"), roots).join(links, "class", "left")
    labels = known.groupBy("root").agg(F.min("first").alias("class_id"))
    known = written(known.join(labels, "root").select("class", "first", "n", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "known")
    discard(prefixes, roots, links)
    single = known.where("n = 1").select(F.col("first").alias("doc_id"), "class_id", "links")
    several = signed.join(classes.where("n > 1").select("sig", "class"), "sig").select("doc_id", "class").join(known.where("n > 1").select("class", "class_id", "links"), "class").drop("class")
    bare = signed.where("sig is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return single.unionByName(several).unionByName(bare)


def _by_class(docs: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sig) of every row; (sig, root, class_id, first, n) of the classes."""
    signed, classes = signature_classes(docs, params)
    prefixes = _prefixes(classes, params)
    roots = class_components(classes, prefixes, params)
    rooted = _rooted(classes, roots)
    labels = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    known = written(rooted.join(labels, "root").select("sig", "root", "class_id", "first", "n"), "known")
    discard(prefixes, roots, classes)
    return signed, known


def groups(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, group_id) of the documents that have near duplicates and aren't the one that stays, the group's smallest doc_id."""
    return _gone(*_by_class(docs, params))


def _gone(signed: DataFrame, known: DataFrame) -> DataFrame:
    single = known.where("n = 1").select(F.col("first").alias("doc_id"), F.col("class_id").alias("group_id"))
    several = signed.join(known.where("n > 1").select("sig", F.col("class_id").alias("group_id")), "sig").select("doc_id", "group_id")
    return single.unionByName(several).where("doc_id <> group_id")


def keep_one(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row of each group of near duplicates, and all rows without words, with all their columns."""
    signed, known = _by_class(docs, params)
    gone, sig, odd = fresh(docs.columns, "__gone", "__sig", "__odd")
    away = _gone(signed, known).select(F.col("doc_id").alias(gone)).distinct()
    repeated = written(signed.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(odd)), "repeated")
    key = docs["doc_id"].cast("long")
    if repeated.isEmpty():
        return docs.join(away, key == away[gone], "left_anti")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            yield b.append_column(sig, _signed(b.column("text"), params, hasher))

    regular = docs.join(repeated, key.eqNullSafe(repeated[odd]), "left_anti").join(away, key == away[gone], "left_anti")
    others = docs.join(repeated, key.eqNullSafe(repeated[odd]), "left_semi")
    signs = others.mapInArrow(sign, T.StructType([*docs.schema.fields, T.StructField(sig, T.BinaryType())]))
    open_ = known.join(repeated, known["class_id"].eqNullSafe(repeated[odd]), "left_semi").select(F.col("sig").alias(gone), F.col("root").alias(odd))
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), row_hash("text"))
    chosen = signs.join(open_, signs[sig] == open_[gone]).groupBy(odd).agg(F.min_by(every, first).alias(sig))
    bare = signs.where(F.col(sig).isNull()).select(every.alias(sig))
    inner = lambda t: t.select(*[F.col(sig).getField(c).alias(c) for c in docs.columns])
    return regular.unionByName(inner(bare)).unionByName(inner(chosen.select(sig)))
