"""Boolean queries: lexer, parser, and compilation of the tree to one aggregation and filter."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Node = Term | Phrase | Not | And | Or
_BINDING = {"OR": 1, "AND": 2, "NOT": 3}


def lex(query: str) -> list[str]:
    """Words, quoted strings (with their quotes; an unclosed one runs to the end), brackets, and operators in capitals."""
    out, at = [], 0
    while at < len(query):
        c = query[at]
        if c in " \t\n\r\v\f":
            at += 1
        elif c == '"':
            close = query.find('"', at + 1)
            close = len(query) if close < 0 else close + 1
            out.append(query[at:close])
            at = close
        elif c in "()":
            out.append(c)
            at += 1
        else:
            end = at
            while end < len(query) and query[end] not in " \t\n\r\v\f()":
                end += 1
            word = query[at:end]
            out.append(word.upper() if word.upper() in _BINDING else word)
            at = end
    return out


def _leaf(token: str, analyzer: Analyzer) -> Node:
    if len(token) >= 2 and token[0] == token[-1] == '"':
        return Phrase(tuple(analyzer.split(token[1:-1])))
    return Term(next(iter(analyzer.split(token)), token))


def parse(query: str, analyzer: Analyzer = Analyzer()) -> Node | None:
    """The tree, or None where the query isn't one expression; then it is a ranked OR of its words.

    Two bare words aren't joined by an implied AND.  A closing bracket too many is
    passed over; an opening one too many counts as a word that nothing matches.
    """
    postfix: list[str] = []
    waiting: list[str] = []
    for t in lex(query):
        if t in _BINDING:
            while waiting and waiting[-1] != "(" and _BINDING[waiting[-1]] >= _BINDING[t] + (t == "NOT"):
                postfix.append(waiting.pop())
            waiting.append(t)
        elif t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                postfix.append(waiting.pop())
            if waiting:
                waiting.pop()
        else:
            postfix.append(t)
    postfix += reversed(waiting)
    done: list[Node] = []
    for t in postfix:
        if len(done) < {"AND": 2, "OR": 2, "NOT": 1}.get(t, 0):
            return None
        if t == "NOT":
            done.append(Not(done.pop()))
        elif t in _BINDING:
            right, left = done.pop(), done.pop()
            done.append(And(left, right) if t == "AND" else Or(left, right))
        else:
            done.append(_leaf(t, analyzer))
    return done[0] if len(done) == 1 else None


def leaf_terms(node: Node) -> list[str]:
    """Every term that the tree's truth depends on, sorted."""
    if isinstance(node, Term):
        found = {node.text}
    elif isinstance(node, Phrase):
        found = set(node.words)
    elif isinstance(node, Not):
        found = set(leaf_terms(node.child))
    else:
        found = set(leaf_terms(node.left)) | set(leaf_terms(node.right))
    return sorted(found)


def holds_without_terms(node: Node) -> bool:
    """Whether a document with none of the terms matches: then all documents have to be looked at."""
    if isinstance(node, Not):
        return not holds_without_terms(node.child)
    if isinstance(node, And):
        return holds_without_terms(node.left) and holds_without_terms(node.right)
    if isinstance(node, Or):
        return holds_without_terms(node.left) or holds_without_terms(node.right)
    return False


def has_phrase(node: Node) -> bool:
    if isinstance(node, Phrase):
        return True
    if isinstance(node, Not):
        return has_phrase(node.child)
    return isinstance(node, (And, Or)) and (has_phrase(node.left) or has_phrase(node.right))


def condition(node: Node, column: dict[str, str]) -> Column:
    """The tree as a condition over one column of positions for each term (null where the document lacks it); never null."""
    if isinstance(node, Term):
        return F.col(column[node.text]).isNotNull()
    if isinstance(node, Phrase):
        if not node.words:
            return F.lit(False)
        after = lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.col(column[w]), (p + i).cast("int")) for i, w in enumerate(node.words) if i], F.lit(True))
        return F.coalesce(F.exists(F.col(column[node.words[0]]), after), F.lit(False))
    if isinstance(node, Not):
        return ~condition(node.child, column)
    left, right = condition(node.left, column), condition(node.right, column)
    return left & right if isinstance(node, And) else left | right


def match(node: Node, postings: DataFrame, docs: DataFrame, extra: dict[str, Column] | None = None, terms: list[str] = ()) -> DataFrame:
    """(doc_id, *extra) of the matching documents: one scan of the terms' postings and one aggregation, whatever the tree.

    extra: aggregates over the same postings (of the tree's terms and ``terms``).
    """
    own = leaf_terms(node)
    column = {t: f"__p{i}" for i, t in enumerate(own)}
    wanted = sorted({*own, *terms})
    value = F.col("positions") if has_phrase(node) else F.col("doc_id")
    flags = [F.max(F.when(F.col("term") == t, value)).alias(c) for t, c in column.items()]
    aggregates = flags + [c.alias(k) for k, c in (extra or {}).items()]
    if not aggregates:
        return docs.select("doc_id").where(F.lit(holds_without_terms(node)))
    found = postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(*aggregates)
    if holds_without_terms(node):
        found = docs.select("doc_id").join(found, "doc_id", "left")
    return found.where(condition(node, column)).select("doc_id", *(extra or {}))


def term_docs(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("term") == term).select("doc_id")


def list_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def list_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def list_not(a: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(a, "doc_id", "left_anti")
