"""URL filter: a blocked Bloom filter passes possible hits to an exact join.

The list's canonical URLs are hashed to one of the filter's blocks of eight
32-bit words and to one bit in each word.  The filter is a table (block, eight
words), built by OR-ing the keys' masks by block; a probe is a join on the
block number and eight AND-compares, all of it built-in expressions.  The
filter is broadcast where it is small enough, and joined by block number where
it is not.  What passes (all listed URLs, and false positives) goes to an exact
join with the list.

Results in odd cases
  * null URL: never listed.  Empty URL: canonical form is the empty text, listed only if the list has it.
  * repeated rows of pages: each is reported; of the list: count once.
  * an empty list: nothing passes.  Further columns of the pages stay, also by clashing names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import fresh, written

_SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


@dataclass(frozen=True)
class Params:
    bits_per_key: int = 16
    #: Blocks up to which the filter is sent to every executor; as a row one takes 72 bytes of numbers, with what a hashed relation adds 150 or so.
    broadcast_blocks: int = 200_000


def _without_endings(path: Column) -> Column:
    """Without any .html, .htm and slashes at the end.  Each ending becomes one character of private use, to be trimmed: a repeated group would recurse."""
    marked = F.replace(F.replace(path, F.lit(".html"), F.lit("\ue000")), F.lit(".htm"), F.lit("\ue001"))
    bare = F.rtrim(marked, F.lit("/\ue000\ue001"))
    return F.replace(F.replace(bare, F.lit("\ue000"), F.lit(".html")), F.lit("\ue001"), F.lit(".htm"))


def canonical(url: Column) -> Column:
    """Without scheme, fragment, default port, www. or m., tracking parameters, .html and closing slashes; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), "^(www|m)[.]", ""), ":(80|443)$", "")
    path = _without_endings(F.regexp_extract(rest, "^[^?]*", 0))
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)(utm_[a-z]*|ref)=[^&]*", ""), "^&+", "")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, i: int) -> Column:
    """One bit of a 32-bit word (held in a long), by a multiplicative hash."""
    low = F.xxhash64(F.lit(8), key).bitwiseAND(F.lit(0x7FFFFFFF))
    place = F.shiftright((low * F.lit(_SALTS[i])).bitwiseAND(F.lit(0xFFFFFFFF)), 27)
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def filter_table(keys: DataFrame, blocks: int) -> DataFrame:
    masks = [F.bit_or(_mask(F.col("key"), i)).alias(f"__w{i}") for i in range(8)]
    return keys.groupBy(_block(F.col("key"), blocks).alias("__block")).agg(*masks)


def possible(rows: DataFrame, key: str, keys: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows whose key the filter of the keys (a column key, distinct) lets pass."""
    n = keys.count()
    blocks = max(1, -(-n * params.bits_per_key // 256))
    block, *words = fresh(rows.columns, "__block", *[f"__w{i}" for i in range(8)])
    table = filter_table(keys, blocks).toDF(block, *words)
    if blocks <= params.broadcast_blocks:
        table = F.broadcast(table)
    found = rows.withColumn(block, _block(F.col(key), blocks)).join(table, block)
    for i, w in enumerate(words):
        m = _mask(F.col(key), i)
        found = found.where(F.col(w).bitwiseAND(m) == m)
    return found.drop(block, *words)


def listed(pages: DataFrame, urls: DataFrame, params: Params = Params()) -> DataFrame:
    """The pages (with all their columns, and canonical_url, or that with underscores where there is one) whose canonical URL is that of one of the urls (column url)."""
    keys = written(urls.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct(), "urls")
    name = fresh(pages.columns, "canonical_url")[0]
    rows = pages.withColumn(name, canonical(F.col("url"))).where(F.col(name).isNotNull())
    hits = possible(rows, name, keys, params)
    return hits.join(keys, hits[name] == keys["key"], "left_semi")


def bad_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs whose path ends in the number of a document labelled toxic or of low quality."""
    number = F.regexp_extract("url", "^[a-z]+://[^/]*/[a-z]+/([0-9]+)", 1).try_cast("long")
    bad = labels.where("toxic = 1 or quality = 0").select("doc_id").distinct()
    return pages.select("url", number.alias("doc_id")).join(bad, "doc_id", "left_semi").select("url")


SQL = r"""
WITH parts AS (
  SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages WHERE url IS NOT NULL),
cut AS (SELECT *, regexp_extract(bare, '^[^/?]*') AS h FROM parts),
rest AS (SELECT *, substr(bare, length(h) + 1) AS r FROM cut),
canon AS (
  SELECT page_id, url,
    regexp_replace(regexp_replace(lower(h), '^(www|m)[.]', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(r, '^[^?]*'), '([.]html?|/)+$', '') AS base,
    regexp_replace(regexp_replace(regexp_extract(r, '[?](.*)$', 1), '(^|&)(utm_[a-z]*|ref)=[^&]*', '', 'g'), '^&+', '') AS q
  FROM rest),
keyed AS (SELECT page_id, url, base || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url FROM canon),
bad AS (
  SELECT DISTINCT canonical_url FROM keyed
  WHERE try_cast(regexp_extract(url, '^[a-z]+://[^/]*/[a-z]+/([0-9]+)', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0))
SELECT page_id, url, canonical_url FROM keyed WHERE canonical_url IN (SELECT canonical_url FROM bad)
"""
