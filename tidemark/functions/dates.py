"""Columns over dates in local time: German date texts, Berlin days, ISO texts, retry waits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"

# German names of months.
MONTHS = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]
EXTRA_MONTHS = {"maerz": 3}

_LETTERS, _GAP = "A-Za-zÄÖÜäöüß", r"[\s\u00a0]"
_NUMBERS, _NAME, _TO = r"\d{1,2}\.\d{1,2}\.", rf"\d{{1,2}}\.{_GAP}*[{_LETTERS}]+", rf"{_GAP}*[+\-]{_GAP}*"
# The forms of german_range in order: each is looked for in the whole text before the next one is, and none comes last.
_FORMS = [rf"(?<!\d){_NUMBERS}20\d\d{_TO}{_NUMBERS}(?:20\d\d)?", rf"{_NAME}{_TO}{_NAME}{_GAP}+20\d\d", rf"\d{{1,2}}\.{_TO}{_NAME}{_GAP}+20\d\d", rf"(?<!\d){_NUMBERS}20\d\d(?!\d)", rf"(?<!\d){_NAME}{_GAP}+20\d\d(?!\d)"]
_SPAN = f"(?s)^(?:{'|'.join(f'.*?({f})' for f in _FORMS)}|).*"


def month_number(name: Column) -> Column:
    pairs = [x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))] + [x for m, i in EXTRA_MONTHS.items() for x in (F.lit(m), F.lit(i))]
    return F.element_at(F.create_map(*pairs), F.lower(name))


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date")


def german_range(text: Column) -> Column:
    """struct(first date, end date): the first and the day after the last day that a text names; null where it names none.

    The text is searched once; what the first form matched is cut into its numbers and names once. In order: d.m.20yy +|- d.m.[20yy]; d. month +|- d. month 20yy; d. +|- d. month 20yy; d.m.20yy; d. month 20yy.
    """
    return F.get(F.filter(F.transform(F.array(F.split(F.regexp_replace(text, _SPAN, "$1$2$3$4$5"), f"[^{_LETTERS}0-9]+")), _read), lambda s: s["first"].isNotNull() & s["end"].isNotNull()), 0)


def _read(t: Column) -> Column:
    """The span of a piece's parts, by their number: d m y d m [y], d name d name y, d d name y, or d m y."""
    n = F.size(t)
    at = lambda i: F.get(t, F.lit(i))
    back = lambda i: F.get(t, n - i)
    month = lambda c: F.when(c.rlike("^[0-9]"), c).otherwise(month_number(c).cast("string"))
    year = F.coalesce(F.nullif(back(1), F.lit("")), at(2))
    first = _day(F.when(n == 6, at(2)).otherwise(year), month(F.when(n == 4, at(2)).otherwise(at(1))), at(0))
    return F.struct(first.alias("first"), F.date_add(_day(year, month(back(2)), back(3)), 1).alias("end"))


def german_time(text: Column) -> Column:
    """Minutes after midnight of the first H:MM or H.MM in a text."""
    h, m = F.regexp_extract(text, r"(\d{1,2})[:.](\d{2})", 1), F.regexp_extract(text, r"(\d{1,2})[:.](\d{2})", 2)
    minutes = h.try_cast("int") * 60 + m.try_cast("int")
    return F.when((h.try_cast("int") < 24) & (m.try_cast("int") < 60), minutes)


def berlin_midnight(day: Column) -> Column:
    """The instant at which a day starts in Berlin."""
    return F.to_utc_timestamp(day.cast("timestamp_ntz").cast("string").cast("timestamp"), ZONE)


def berlin_day(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def iso_utc(instant: Column) -> Column:
    """ISO text in UTC, with a fraction only where there is one."""
    micros = F.unix_micros(instant) % 1_000_000
    return F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != 0, F.format_string(".%06d", micros)).otherwise(""), F.lit("+00:00"))


def iso_berlin(instant: Column) -> Column:
    """ISO text in Berlin time with its offset."""
    local = F.from_utc_timestamp(instant, ZONE)
    minutes = ((F.unix_micros(local) - F.unix_micros(instant)) / 60_000_000).cast("int")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.format_string("+%02d:%02d", (minutes / 60).cast("int"), minutes % 60))


def elapsed_days(since: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(since)) / 8.64e10


def backoff(attempt: Column, most: float = 2.0) -> Column:
    """Seconds to wait after an attempt, from 1."""
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a number, or an HTTP date; never below 0."""
    when = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.coalesce(F.trim(header).try_cast("double"), (F.unix_micros(when) - F.unix_micros(now)) / 1e6), F.lit(0.0))
