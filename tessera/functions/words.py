"""Words of whole Arrow text columns, counted document by document.

A document's words are counted where it is read: no row for a word leaves the
kernel before it stands for all of the word's occurrences in the document, so
that nothing has to be gathered again.  A batch is cut into runs of whole
documents of about ``RUN`` bytes, which bounds what is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import Analyzer, stem_word

RUN = 1 << 22
#: ASCII letters in lower case and digits; a blank for any other byte.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass
class Counted:
    """Words of a run of documents: for each document and word that it has, in order of the documents."""

    first: int
    #: Tokens of each document.
    dl: np.ndarray
    words: pa.Array
    #: By pair: document (from the run's first on), word, occurrences; and the occurrences' places in the document, if asked for.
    doc: np.ndarray
    word: np.ndarray
    tf: np.ndarray
    places: np.ndarray | None


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
    """(first row, row after the last, offsets, bytes) for runs of whole documents."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    first = 0
    while first < len(column):
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN, "right")) - 1)
        raw = data.slice(offsets[first], offsets[after] - offsets[first]).to_pybytes() if data is not None and offsets[after] > offsets[first] else b""
        yield first, after, offsets[first : after + 1] - offsets[first], raw
        first = after


def _kept(words: pa.Array, analyzer: Analyzer) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words as terms: the terms, the term of each word, and whether it counts."""
    of = np.arange(len(words))
    if analyzer.stemming:
        coded = pa.array([stem_word(w) for w in words.to_pylist()], pa.large_string()).dictionary_encode()
        words, of = coded.dictionary, coded.indices.to_numpy()
    passed = pc.is_in(words, pa.array(["", *sorted(analyzer.stopwords)], words.type)).to_numpy(zero_copy_only=False)
    return words, of, ~passed[of] if len(of) else np.zeros(0, bool)


def counted(column: pa.Array, analyzer: Analyzer, places: bool = False) -> Iterator[Counted]:
    """The runs of a text column; a null text has no words."""
    for first, after, offsets, raw in _runs(pc.fill_null(column.cast(pa.large_string()), "")):
        n = after - first
        text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw.translate(_TABLE)))
        split = pc.ascii_split_whitespace(text)
        coded = split.values.dictionary_encode()
        words, of, counts = _kept(coded.dictionary, analyzer)
        code = coded.indices.to_numpy()
        doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
        stay = counts[code]
        word, doc = of[code[stay]], doc[stay]
        dl = np.bincount(doc, minlength=n)
        key, size, at = doc * max(1, len(words)) + word, len(doc), None
        if places:
            if n * len(words) * size < 1 << 62:  # one sort of numbers, instead of one that follows places
                joint = np.sort(key * size + np.arange(size)) if size else key
                key, at = joint // max(1, size), joint % max(1, size)
            else:
                at = np.argsort(key, kind="stable")
                key = key[at]
            at = at - (np.cumsum(dl) - dl)[doc[at]]
        else:
            key = np.sort(key)
        start = np.flatnonzero(np.diff(key, prepend=-1))
        doc, word = np.divmod(key[start], max(1, len(words)))
        yield Counted(first, dl, words, doc, word, np.diff(start, append=size), at)


def posting_batches(batches: Iterator[pa.RecordBatch], analyzer: Analyzer, places: bool, own: list[str]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, tf, *own[, positions]) of batches (doc_id, *own, content); an own column dl is made where they lack it."""
    for batch in batches:
        text = batch.column("content")
        for c in counted(text, analyzer, places):
            rows = pa.array(c.doc + c.first)
            out = {"term": c.words.take(pa.array(c.word)).cast(pa.string()), "doc_id": batch.column("doc_id").take(rows), "tf": pa.array(c.tf)}
            for name in own:
                out[name] = batch.column(name).take(rows) if name in batch.schema.names else pa.array(c.dl[c.doc])
            if places:
                out["positions"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c.tf)]), pa.int32()), pa.array(c.places, pa.int32()))
            yield pa.RecordBatch.from_pydict(out)


def length_batches(batches: Iterator[pa.RecordBatch], analyzer: Analyzer) -> Iterator[pa.RecordBatch]:
    """(doc_id, dl) of batches (doc_id, content)."""
    for batch in batches:
        dl = [c.dl for c in counted(batch.column("content"), analyzer)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "dl": pa.array(np.concatenate([np.zeros(0, np.int64), *dl]))})


def term_batches(batches: Iterator[pa.RecordBatch], analyzer: Analyzer) -> Iterator[pa.RecordBatch]:
    """(term, df, n) of batches (content), added up over each run: documents with the term, occurrences."""
    for batch in batches:
        for c in counted(batch.column("content"), analyzer):
            df = np.bincount(c.word, minlength=len(c.words))
            some = np.flatnonzero(df)
            n = np.bincount(c.word, c.tf, len(c.words)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"term": c.words.take(pa.array(some)).cast(pa.string()), "df": pa.array(df[some]), "n": pa.array(n[some])})


def measure_batches(batches: Iterator[pa.RecordBatch], analyzer: Analyzer, terms: pa.Array, idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, tf, dl, part) of batches (doc_id, content): for each document with tokens a row with its length and its known terms' share
    of its squared norm (its term is a blank and the id, which no term is), and its postings of terms that aren't among ``terms``."""
    for batch in batches:
        for c in counted(batch.column("content"), analyzer):
            at = pc.fill_null(pc.index_in(c.words, terms), -1).to_numpy()
            known = at >= 0
            weight = np.zeros(len(at))
            weight[known] = idf[at[known]]
            part = np.bincount(c.doc, ((1 + np.log(c.tf)) * weight[c.word]) ** 2, len(c.dl))
            rest, some = ~known[c.word], np.flatnonzero(c.dl)
            own = batch.column("doc_id").take(pa.array(some + c.first))
            names = pc.binary_join_element_wise("", own.cast(pa.string()), " ")
            none = np.zeros(int(rest.sum()))
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.concat_arrays([names, c.words.take(pa.array(c.word[rest])).cast(pa.string())]),
                    "doc_id": pa.concat_arrays([own, batch.column("doc_id").take(pa.array(c.doc[rest] + c.first))]),
                    "tf": pa.array(np.concatenate([np.ones(len(some), np.int64), c.tf[rest]])),
                    "dl": pa.array(np.concatenate([c.dl[some], none.astype(np.int64)])),
                    "part": pa.array(np.concatenate([part[some], none])),
                }
            )
