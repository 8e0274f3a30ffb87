"""Columns over strings: normal forms, fingerprints, hashes, slugs, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"


def squeeze(c: Column) -> Column:
    """White space of any kind as one space, none at the ends; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def normal_title(c: Column) -> Column:
    """Lower case, letters, digits and underscores only, single spaces."""
    bare = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def weak_fingerprint(title: Column, day: Column) -> Column:
    """Digest of a normal title and a local date (ISO text)."""
    return F.sha2(F.concat(normal_title(title), F.lit("|"), day), 256)


def joined_hash(*parts: Column) -> Column:
    """Digest of all parts with a unit separator between; null counts as empty."""
    return F.sha2(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def python_bool(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def casefold(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[ßẞ]", "ss"))


def slug(c: Column, most: int = 100) -> Column:
    """Lower-case letters and digits with hyphens in between."""
    return F.substring(F.regexp_replace(F.regexp_replace(casefold(c), "[^a-z0-9äöü]+", "-"), "^-+|-+$", ""), 1, most)


def distinct_join(values: Column, separator: str) -> Column:
    """The distinct values that aren't blank, in order of appearance."""
    return F.array_join(F.array_distinct(F.filter(values, lambda x: F.trim(x) != "")), separator)


def bounded(items: Column, most_items: int = 8, most_chars: int = 320, most_total: int = 2000) -> Column:
    """Diagnostics cut to so many items, characters an item and characters in all, with a count of those left out."""
    cut = F.transform(items, lambda x: F.substring(x, 1, most_chars))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        cost = F.length(x) + F.when(F.size(a["kept"]) > 0, 2).otherwise(0)
        fits = ~a["full"] & (F.size(a["kept"]) < most_items) & (a["size"] + cost <= most_total)
        return F.struct(F.when(fits, F.array_append(a["kept"], x)).otherwise(a["kept"]).alias("kept"), F.when(fits, a["size"] + cost).otherwise(a["size"]).alias("size"), (~fits).alias("full"))

    def done(a: Column) -> Column:
        out = F.size(items) - F.size(a["kept"])
        return F.concat(F.array_join(a["kept"], "; "), F.when(out > 0, F.concat(F.lit("; omitted="), out.cast("string"))).otherwise(F.lit("")))

    return F.aggregate(cut, start, step, done)


# Words that mark a path segment as secret, as patterns.
SECRETS = ["api[-_]?key", "auth", "bearer", "key", "password", "secret", "signature", "token"]


def redacted_path(path: Column, most: int = 180) -> Column:
    """A URL path in which secret segments, what follows them, and overlong or token-like segments are masked, as they read unquoted."""
    parts = F.split(path, "/")
    plain = lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    secret = lambda s: F.lower(plain(s)).rlike(rf"(^|[-_.])({'|'.join(SECRETS)})($|[-_.])")
    dots = lambda s: F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))

    def mask(s: Column, i: Column) -> Column:
        after = (i > 0) & secret(F.get(parts, F.greatest(i - 1, F.lit(0))))
        odd = (F.length(plain(s)) > 80) | ((dots(plain(s)) == 2) & (F.length(plain(s)) > 40))
        return F.when((s != "") & (secret(s) | after | odd), F.lit("<redacted>")).otherwise(s)

    whole = F.array_join(F.transform(parts, mask), "/")
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 3), F.lit("..."))).otherwise(whole)


def endpoint(url: Column) -> Column:
    """Host, port and masked path of a URL, for diagnostics."""
    at = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    host = F.when(at == "", F.lit("<unknown-host>")).when(at.rlike(r":.*[^0-9]"), F.lit("<invalid-host>")).otherwise(at)
    return F.concat(F.lit("host="), host, F.lit(" path="), redacted_path(F.when(path == "", F.lit("/")).otherwise(path)))


def escaped(c: Column) -> Column:
    """Text as an iCalendar value."""
    for plain, safe in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    """An iCalendar value as text: a backslash pair at a time, so that an escaped backslash never joins what follows it."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for safe, plain in (("\\;", ";"), ("\\,", ","), ("\\n", "\n"), ("\\N", "\n"), ("\x00", "\\")):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c
