"""URLs and HTML as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKUP = r"(?is)<(?:script|style).*?(?:/script[^>]?|/style[^>]{0,2})>|<(?:script|style).*$|<[^>]*>|>"


def html_text(html: Column) -> Column:
    """Without tags, and without scripts and styles; white space collapsed, not trimmed; entities stay."""
    bare = F.regexp_replace(F.regexp_replace(html, _MARKUP, " "), r"(?s)<[^>]*$", "")
    return F.regexp_replace(bare, "[ \n\r\t]+", " ")


def links(html: Column) -> Column:
    """Targets of href="...", without empty ones, anchors and mail addresses."""
    found = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)
    return F.filter(found, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("mailto:")))


def url_parts(url: Column) -> Column:
    """scheme, host and path (/ where there is none); null if there is no scheme or no host."""
    scheme = F.regexp_extract(url, "^(.*?)://", 1)
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "^([^/]*)", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    good = F.contains(url, F.lit("://")) & (host != "")
    return F.when(good, F.struct(scheme.alias("scheme"), host.alias("host"), F.when(path == "", "/").otherwise(path).alias("path")))


def resolve(link: Column, scheme: Column, host: Column) -> Column:
    """A link's URL: whole ones as they are, those from the root with scheme and host; null for others."""
    return (
        F.when((link == "") | F.startswith(link, F.lit("#")), F.lit(None).cast("string"))
        .when(F.startswith(link, F.lit("http")), link)
        .when(F.startswith(link, F.lit("/")), F.concat(scheme, F.lit("://"), host, link))
    )


def file_name(url: Column) -> Column:
    return F.substring(F.translate(url, "/:?&=#", "______"), 1, 120)


def page_file(url: Column, text: Column) -> Column:
    """Content of the file that a crawled page is kept in."""
    return F.concat(F.lit("URL: "), url, F.lit("\n\n"), text)
