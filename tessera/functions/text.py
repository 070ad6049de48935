"""Text analysis as Spark expressions, and its driver-side twin for query strings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words, in alphabetical order.
STOPWORDS = frozenset(
    "a an and are as at be been but by can could did do for from had has have he her his i if in is it "
    "its may me might my no not of on or our shall she should so that the their them these they this "
    "those to us was we were will with would you".split()
)
_SUFFIXES = tuple("ing ed ly es s".split())
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Analyzer:
    """What a token is: runs of ASCII letters and digits, lower-cased, stemmed if asked for, without stopwords."""

    stopwords: frozenset[str] = field(default=STOPWORDS)
    stemming: bool = False

    def tokens(self, text: Column) -> Column:
        """Array of tokens in order; null text has none."""
        found = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1)
        if self.stemming:
            found = F.transform(found, lambda t: stem(F.lower(t)))
        else:
            found = F.transform(found, F.lower)
        if self.stopwords:
            words = sorted(self.stopwords)
            found = F.filter(found, lambda t: ~t.isin(words))
        return F.coalesce(found, F.array().cast("array<string>"))

    def split(self, text: str) -> list[str]:
        """The same for a string on the driver."""
        found = [t.lower() for t in re.findall("[A-Za-z0-9]+", text)]
        if self.stemming:
            found = [stem_word(t) for t in found]
        return [t for t in found if t not in self.stopwords]


def stem(term: Column) -> Column:
    """Without the first of the suffixes ing, ed, ly, es, s that leaves three letters or more."""
    out = term
    for s in reversed(_SUFFIXES):
        out = F.when(F.endswith(term, F.lit(s)) & (F.length(term) > len(s) + 2), F.substring(term, F.lit(1), F.length(term) - len(s))).otherwise(out)
    return out


def stem_word(term: str) -> str:
    for s in _SUFFIXES:
        if term.endswith(s) and len(term) > len(s) + 2:
            return term[: -len(s)]
    return term


def ascii_lower(text: Column) -> Column:
    """Lower case of ASCII letters only, so that no offset moves."""
    return F.translate(text, _UPPER, _UPPER.lower())


def sanitize(text: Column, most: int = 512) -> Column:
    """Printable ASCII; tabs and line breaks become blanks, all else goes; cut to ``most`` afterwards."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, "[\t\n\r]", " "), "[^ -~]", ""), 1, most)


def sanitize_text(text: str, most: int = 512) -> str:
    return re.sub("[^ -~]", "", re.sub("[\t\n\r]", " ", text))[:most]


def valid_query(text: Column, most: int = 1000) -> Column:
    return F.octet_length(text) <= most


def highlight(snippet: Column, query: str) -> Column:
    """The query's words, without and/or/not, marked wherever they occur."""
    words = [w for w in query.lower().split() if w not in ("and", "or", "not")]
    if not words:
        return snippet
    return F.regexp_replace(snippet, "(?i)(" + "|".join(re.escape(w) for w in words) + ")", "<mark>$1</mark>")


def display_path(path: Column) -> Column:
    """Base name without .txt, with ___ read as ://; a path without a slash stays as it is."""
    base = F.substring_index(path, "/", -1)
    bare = F.when((F.length(base) > 4) & F.endswith(base, F.lit(".txt")), F.substring(base, F.lit(1), F.length(base) - 4)).otherwise(base)
    return F.when(F.contains(path, F.lit("/")), F.replace(bare, F.lit("___"), F.lit("://"))).otherwise(path)


def html_escape(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def base64url(data: Column) -> Column:
    return F.translate(F.rtrim(F.base64(data), F.lit("=")), "+/", "-_")


def unbase64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def password_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(text: Column) -> Column:
    return F.xxhash64(text)


def json_field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def size_kb(size: Column) -> Column:
    return F.round(size / 1024, 1)


def day(mtime: Column) -> Column:
    return F.date_format(F.timestamp_seconds(mtime), "MMM d, yyyy")


def relevance(score: Column) -> Column:
    """Per cent of a score of 20, at most 100."""
    return F.least(F.lit(100.0), score * 5)
