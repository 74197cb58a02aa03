"""URL columns, by regular expressions (the built-in parser drops ports and keeps the host's case)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of the first 2,000 characters that give a page's type, in order.
PAGE_TYPES = (
    ("pricing", ("/pricing", "pricing", "on-demand", "price-list")),
    ("docs", ("/docs", "documentation", "userguide", "developer", "/learn/")),
    ("marketing", ("/products", "/product/", "solutions", "platform")),
    ("hub", ("/blog", "resources", "customers")),
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def netloc(url: Column) -> Column:
    """Host with its port, as written."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-cased, without a leading www."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalize(url: Column) -> Column:
    """Scheme and host lower-cased, no www., no fragment, no trailing slash; the query stays."""
    p = path(url)
    p = F.when(p == "", "/").when(p == "/", "/").otherwise(F.when(p.rlike("^/+$"), "").otherwise(F.regexp_replace(p, "/+$", "")))
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), host(url), p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def page_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", ""))


def slug(url: Column, fallback: Column) -> Column:
    dashed = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    h, p = dashed(F.when(netloc(url) == "", "site").otherwise(host(url))), dashed(path(url))
    raw = F.when(p == "", h).otherwise(F.concat(h, F.lit("-"), p))
    cut = F.regexp_replace(F.substring(raw, 1, 80), "^-+|-+$", "")
    return F.when(cut == "", fallback).otherwise(cut)


def site_group_key(url: Column, depth: int = 1) -> Column:
    parts = F.slice(F.filter(F.split(path(url), "/"), lambda x: x != ""), 1, depth)
    key = F.when(F.size(parts) == 0, host(url)).otherwise(F.concat(host(url), F.lit("/"), F.array_join(parts, "/")))
    return F.when(url.isNull() | (url == ""), "unknown").otherwise(key)


def fingerprint(url: Column, html: Column) -> Column:
    """One page fetched twice has one fingerprint: host, path and query, or the body's hash without a URL."""
    key = F.concat(F.lower(netloc(url)), F.regexp_replace(path(url), "/+$", ""), F.lit("?"), query(url))
    return F.when(url.isNull() | (url == ""), F.sha1(html)).otherwise(key)


def page_type(url: Column, html: Column) -> Column:
    blob = F.lower(F.concat(F.coalesce(url, F.lit("")), F.lit(" "), F.substring(html, 1, 2000)))
    out = None
    for name, words in PAGE_TYPES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(blob, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")
