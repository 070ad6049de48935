"""Snippets: the densest window of query-word hits, cut at white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

LEAD, TAIL = 40, 80


def _positions(low: Column, word: str) -> Column:
    """Offsets of the word's non-overlapping occurrences, from the left."""
    parts = F.split(low, "\\Q" + word + "\\E", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + len(word)).alias("at"), F.array_append(a["found"], (a["at"] + F.length(p)).cast("int")).alias("found"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step)["found"]


def _hits(low: Column, words: list[str]) -> Column:
    """(pos, key) of all hits; the key is the first word, in the query's order, that the text has there."""
    found = F.array_sort(F.flatten(F.array(*[_positions(low, w) for w in dict.fromkeys(words)])))
    key = lambda p: F.coalesce(*[F.when(F.substring(low, p + 1, F.lit(len(w))) == w, F.lit(w)) for w in words])
    return F.transform(found, lambda p: F.struct(p.alias("pos"), key(p).alias("key")))


def _cut(content: Column, best: Column, window: int) -> Column:
    start = F.greatest(best - LEAD, F.lit(0))
    end = F.least(F.length(content), start + window + TAIL)
    before = F.regexp_extract(F.substring(content, F.lit(1), start + 1), r"(?s)^(.*[ \n])[^ \n]*$", 1)
    start = F.greatest(F.length(before) - 1, F.lit(0))
    end = end + F.length(F.regexp_extract(F.substring(content, end + 1, F.length(content)), r"^[^ \n]*", 0))
    piece = F.substring(content, start + 1, end - start)
    bare = F.trim(piece, F.lit(" \t\n\r"))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.when(bare == "", piece).otherwise(bare), F.when(end < F.length(content), "...").otherwise(""))


def beginning(content: Column, most: int = 200) -> Column:
    """A text's first characters, with dots where there are more; an empty one stays empty, none stays none."""
    return F.concat(F.substring(content, 1, most), F.when(F.length(content) > most, "...").otherwise(""))


def snippets(docs: DataFrame, words: list[str], window: int = 300) -> DataFrame:
    """(doc_id, snippet) of documents (doc_id, content).  Meant for the few documents of a result.

    The window is that of the first hit with the most distinct words among the
    ``window`` characters before it, and starts at its leftmost hit.
    """
    words = [w.lower() for w in words if w]
    docs = docs.select("doc_id", "content")
    plain = beginning(F.col("content"))
    empty = F.when(F.col("content").isNull(), "[file no longer available]").when(F.col("content") == "", "[empty document]")
    if not words:
        return docs.select("doc_id", F.coalesce(empty, plain).alias("snippet"))
    hits = docs.select("doc_id", F.explode(_hits(ascii_lower(F.col("content")), words)).alias("h")).select("doc_id", "h.pos", "h.key")
    back = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(-window, 0)
    seen = hits.select("doc_id", "pos", F.size(F.collect_set("key").over(back)).alias("n"), F.min("pos").over(back).alias("left"))
    best = seen.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("pos")).alias("first"), "left")).alias("b")).select("doc_id", F.col("b.left").alias("best"))
    cut = F.when(F.col("best").isNull(), plain).otherwise(_cut(F.col("content"), F.col("best"), window))
    return docs.join(best, "doc_id", "left").select("doc_id", F.coalesce(empty, cut).alias("snippet"))
