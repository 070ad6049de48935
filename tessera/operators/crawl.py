"""Breadth-first crawling over a table of pages (url, html) in place of the web."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.web import file_name, html_text, links, page_file, resolve, url_parts
from ..workspace import discard, written

AGENT = "tessera"


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link, target): every link of every page, in order of occurrence, with what it resolves to (null if to nothing)."""
    each = pages.select("url", url_parts(F.col("url")).alias("u"), F.posexplode(links(F.col("html"))).alias("n", "link"))
    return each.select("url", "n", "link", resolve(F.col("link"), F.col("u.scheme"), F.col("u.host")).alias("target"))


def robots_rules(robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """(host, prefix) that robots files (host, body) forbid to everyone or to the agent."""
    line = robots.select("host", F.posexplode(F.split("body", "\r?\n")).alias("n", "line")).where(~F.startswith("line", F.lit("#")))
    value = F.regexp_replace(F.regexp_extract("line", "^[^:]*:(.*)$", 1), "^[ \t]+", "")
    names = F.when(F.startswith("line", F.lit("User-agent")), value.isin("*", agent))
    seen = Window.partitionBy("host").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    told = line.withColumn("ours", F.last(names, ignorenulls=True).over(seen)).where(F.col("ours") & F.startswith("line", F.lit("Disallow")))
    return told.select("host", value.alias("prefix")).where("prefix <> ''").distinct()


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows (column url) whose path no rule of the host forbids."""
    u = urls.withColumn("__u", url_parts(F.col("url"))).withColumn("__host", F.col("__u.host")).withColumn("__path", F.col("__u.path"))
    r = rules.select(F.col("host").alias("__rh"), "prefix")
    return u.join(r, (u["__host"] == r["__rh"]) & F.startswith(u["__path"], r["prefix"]), "left_anti").drop("__u", "__host", "__path")


def crawl(pages: DataFrame, seeds: list[str], max_pages: int = 50, max_depth: int = 3, robots: DataFrame | None = None) -> DataFrame:
    """(url, depth, text) of the pages reached, one job for each depth.

    Pages without text are neither reported nor followed.  Within a depth pages are
    taken in order of URL until max_pages are reached; the frontier holds only URLs.
    Of several pages with one URL the one with the least html counts.
    """
    spark = pages.sparkSession
    rules = robots_rules(robots) if robots is not None else None
    frontier = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "url string")
    visited = frontier.limit(0)
    out = None
    left = max_pages
    for depth in range(max_depth + 1):
        open_ = frontier.where(url_parts(F.col("url")).isNotNull())
        if rules is not None:
            open_ = allowed(open_, rules)
        got = pages.join(open_, "url", "left_semi").groupBy("url").agg(F.min("html").alias("html")).withColumn("text", html_text(F.col("html"))).where(F.trim("text") != "")
        got = got.orderBy("url").limit(left).select("url", "html", "text")
        got = written(got, "crawl")
        n = got.count()
        layer = got.select("url", F.lit(depth).alias("depth"), "text")
        out = layer if out is None else out.unionByName(layer)
        left -= n
        if not n or left <= 0 or depth == max_depth:
            break
        seen, asked = visited, frontier
        visited = written(visited.union(frontier).distinct(), "visited")
        frontier = written(page_links(got).where("target is not null").select(F.col("target").alias("url")).distinct().join(visited, "url", "left_anti"), "frontier")
        discard(seen, asked)
    return out


def crawled_documents(crawled: DataFrame) -> DataFrame:
    """Crawled pages as documents (path, content)."""
    return crawled.select(F.concat(F.lit("/crawled/"), file_name(F.col("url")), F.lit(".txt")).alias("path"), page_file(F.col("url"), F.col("text")).alias("content"))
