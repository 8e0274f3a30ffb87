"""Columns over URLs: parts, link predicates, robots rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def robots_path(url: Column) -> Column:
    """What robots rules are tested against: the path, / where there is none, and the query, both unquoted."""
    raw = F.concat(F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), query(url)), F.lit("")))
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def query(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")))


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def is_candidate(url: Column, marker: str) -> Column:
    """An iCalendar file or a detail page; a query after the file name defeats the former."""
    low = F.lower(url)
    return low.endswith(".ical") | F.contains(low, F.lit(marker))


def has_parameter(url: Column, name: str, value: str) -> Column:
    return F.coalesce(F.exists(F.split(query(url), "&"), lambda p: F.lower(p) == f"{name}={value}"), F.lit(False))


def is_safe_detail(url: Column, marker: str, banned_path: str, banned_query: list[str]) -> Column:
    """A web page of a kind whose address holds no state of the site's search or editing."""
    q = F.lower(F.coalesce(query(url), F.lit("")))
    bad = F.lit(False)
    for b in banned_query:
        bad = bad | q.startswith(b) | F.contains(q, F.lit("&" + b))
    return is_web(url) & ~F.contains(F.lower(path(url)), F.lit(banned_path)) & ~bad & F.contains(url, F.lit(marker))


def hrefs(html: Column) -> Column:
    """All link targets in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))


def rule_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * is anything, a last $ ends the path, else it is a prefix."""
    ended = pattern.endswith("$")
    body = F.when(ended, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(ended, "$").otherwise(""))


def rule_length(pattern: Column) -> Column:
    """How specific a robots pattern is."""
    return F.length(F.regexp_replace(F.replace(pattern, F.lit("*"), F.lit("")), r"\$$", ""))


def product_token(agent: Column) -> Column:
    return F.lower(F.get(F.split(F.get(F.split(agent, r"\s+"), F.lit(0)), "/"), F.lit(0)))
