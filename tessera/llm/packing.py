"""Best-fit packing by minimum bin slack.

A bin takes the longest document left; then a subset-sum program over the
lengths still available, held as one bit set (bit s: some combination adds up to
s), finds the combination that leaves the least slack, which is taken out.  The
program ends early only when the slack is zero.

The lengths available are those of the whole table: below the capacity there are no
more different ones than its tokens, so that their histogram is all the program
needs, whatever the number of documents.  It sees a length by its count up to what
fits in a bin; as long as no such count changes the next bin comes out like the last,
and a whole run of equal bins is taken at once.  The plan that results says which
bins the n-th document of a length goes to; documents are numbered within
their length over sorted ranges, of which (doc_id, tokens) alone is shuffled.

A document longer than a bin is cut: its full pieces are bins of their own (f...), its
remainder is packed like a document (b...).  Tokens are as in mixing.

Results in odd cases
  * null or empty text: no tokens, so in no bin and not in the result.
  * null doc_id: packed like any other.  Repeated rows: packed each.
  * equal remainders: the one of the smaller doc_id (null first) is taken first, then by hash of text.
  * an empty table: an empty result.  Further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import tokens
from .workspace import discard, row_hash, written


@dataclass(frozen=True)
class Params:
    capacity: int = 2048


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Of the available lengths (ascending, with counts), the combination that fills most of the room."""
    reach, goal = 1, 1 << room
    mask = (goal << 1) - 1
    steps: list[tuple[int, int]] = []  # reach before, length
    for at in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        size = lengths[at]
        for _ in range(min(counts[size], room // size)):
            wider = (reach | reach << size) & mask
            if wider == reach:
                break
            steps.append((reach, size))
            reach = wider
        if reach & goal:
            break
    best, used = reach.bit_length() - 1, []
    for before, size in reversed(steps):
        if not before >> best & 1:
            used.append(size)
            best -= size
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Runs of equal bins: their lengths, longest first, and how many bins.  Every length is at most the capacity and at least 1."""
    counts = {s: n for s, n in counts.items() if n}
    lengths = sorted(counts)
    out = []
    while lengths:
        longest = lengths[-1]
        room, times = capacity - longest, counts[longest]
        counts[longest] -= 1
        used = Counter(fullest(lengths, counts, room) if room else [])
        used[longest] += 1
        for s, n in used.items():
            times = min(times, (counts[s] + (s == longest)) // n)
            if s <= room:  # the program sees as many as fit
                times = min(times, max(0, counts[s] - room // s) // n + 1)
        counts[longest] += 1
        for s, n in used.items():
            counts[s] -= n * times
            if not counts[s]:
                del lengths[bisect_left(lengths, s)]
        out.append((sorted(used.elements(), reverse=True), times))
    return out


class Places:
    """Bin, slot and slack of the n-th document of a length."""

    def __init__(self, runs: list[tuple[list[int], int]], capacity: int) -> None:
        seen: Counter = Counter()
        rows, bins = [], 0
        for lengths, times in runs:
            slack = capacity - sum(lengths)
            for s, n in Counter(lengths).items():
                rows.append((s << 50 | seen[s], bins, n, lengths.index(s), slack))
                seen[s] += n * times
            bins += times
        self.first, self.bin, self.each, self.slot, self.slack = np.array(sorted(rows), np.int64).reshape(-1, 5).T

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = length << 50 | number
        at = np.searchsorted(self.first, key, side="right") - 1
        on = key - self.first[at]
        return self.bin[at] + on // self.each[at], self.slot[at] + on % self.each[at], self.slack[at]


def _numbered(sized: DataFrame) -> DataFrame:
    """(doc_id, tokens, rest, number): each row's place, from 0, among those of its remainder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            rest = b.column("rest").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
            size = np.diff(np.append(first, len(rest)))
            number = np.arange(len(rest)) - np.repeat(first, size)
            if rest[0] == last:
                number[: size[0]] += held
            last, held = int(rest[-1]), int(number[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tokens"), b.column("rest"), pa.array(number), pa.array(np.full(len(rest), part))], ["doc_id", "tokens", "rest", "within", "part"])

    order = ("rest", "doc_id", "hash", "place")
    ranges = sized.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "tokens", "rest")
    # written, since the ranges' borders come from a sample and need not be the same when they are made again
    counted = written(ranges.mapInArrow(count, "doc_id long, tokens long, rest long, within long, part long"), "ranges")
    sizes = counted.groupBy("rest", "part").agg(F.count("*").alias("n"))  # a remainder more or less for each range
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.join(sizes.select("rest", "part", before.alias("before")), ["rest", "part"]).select("doc_id", "tokens", "rest", (F.col("before") + F.col("within")).alias("number"))


def bins(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row for each piece: (bin, slot, doc_id, piece, first_token, tokens, slack of the bin)."""
    capacity = params.capacity
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens().alias("tokens"), row_hash("text").alias("hash")).where("tokens > 0")
    sized = written(sized.withColumn("rest", F.col("tokens") % capacity).withColumn("place", F.monotonically_increasing_id()), "sized")
    counts = {r[0]: r[1] for r in sized.where("rest > 0").groupBy("rest").count().collect()}  # fewer rows than a bin has tokens
    shared = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity), capacity))
    numbered = _numbered(sized)
    discard(sized)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, size = b.column("rest").to_numpy(), b.column("tokens").to_numpy()
            at, slot, slack = shared.value.of(rest, b.column("number").to_numpy()) if len(rest) else (rest, rest, rest)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(slot.astype(np.int32)), b.column("doc_id"), pa.array((size // capacity).astype(np.int32)), pa.array(size - rest), pa.array(rest), pa.array(slack)], ["bin", "slot", "doc_id", "piece", "first_token", "tokens", "slack"])

    packed = numbered.where("rest > 0").select("doc_id", "tokens", "rest", "number").mapInArrow(place, "bin long, slot int, doc_id long, piece int, first_token long, tokens long, slack long")
    packed = packed.withColumn("bin", F.concat(F.lit("b"), F.col("bin").cast("string")))
    pieces = numbered.where(F.col("tokens") >= capacity).withColumn("piece", F.explode(F.sequence(F.lit(0), (F.floor(F.col("tokens") / capacity) - 1).cast("int"))))
    full = pieces.select(F.concat_ws("-", F.lit("f"), "rest", "number", "piece").alias("bin"), F.lit(0).alias("slot"), "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("tokens"), F.lit(0).cast("long").alias("slack"))
    return packed.unionByName(full)
