"""iCalendar text as rows, with column functions: unfold, split into events, read properties, resolve local times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

PROPERTIES = ["SUMMARY", "DTSTART", "DTEND", "DURATION", "LOCATION", "DESCRIPTION", "ORGANIZER", "STATUS", "URL", "UID", "X-ID", "SEQUENCE", "LAST-MODIFIED"]
STATUSES = ["CONFIRMED", "TENTATIVE", "CANCELLED"]


def _pattern(name: str) -> str:
    return rf'(?im)^{name}((?:;(?:"[^"\r\n]*"|[^":\r\n])*)?):([^\r\n]*)'


def properties(block: Column) -> list[Column]:
    """Columns of their own, so that each is searched for once: the value, and the parameters before it."""
    part = lambda n, i: F.nullif(F.trim(F.regexp_extract(block, _pattern(n), i)), F.lit(""))
    return [part(n, 2).alias(f"v_{n}") for n in PROPERTIES] + [part(n, 1).alias(f"p_{n}") for n in PROPERTIES]


def value(name: str) -> Column:
    return F.col(f"`v_{name}`")


def parameter(name: str, key: str) -> Column:
    found = F.regexp_extract(F.col(f"`p_{name}`"), rf'(?i);{key}=(?:"([^"]*)"|([^;:]*))', 0)
    return F.nullif(F.regexp_replace(found, r'(?i)^;[^=]*="?|"$', ""), F.lit(""))


def words(name: str) -> Column:
    return F.nullif(F.trim(text.unescaped(value(name))), F.lit(""))


def local_time(name: str) -> tuple[Column, Column, Column]:
    """(wall-clock time, its zone, whether it is a date): floating times and dates are Berlin's."""
    raw = value(name)
    all_day = raw.rlike(r"^\d{8}$")
    stamp = F.when(all_day, F.concat(raw, F.lit("T000000"))).otherwise(F.regexp_replace(raw, "Z$", ""))
    zone = F.when(raw.endswith("Z"), "UTC").otherwise(F.coalesce(parameter(name, "TZID"), F.lit(dates.ZONE)))
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz"), zone, F.coalesce(all_day, F.lit(False))


def instant(wall: Column, zone: Column) -> Column:
    return F.convert_timezone(zone, F.lit("UTC"), wall).cast("timestamp")


def duration() -> Column:
    """Seconds of a DURATION property."""
    raw = value("DURATION")
    part = lambda unit, seconds: F.coalesce(F.regexp_extract(raw, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0)) * seconds
    size = part("W", 604800) + part("D", 86400) + part("H", 3600) + part("M", 60) + part("S", 1)
    return F.when(raw.rlike(r"^[+-]?P"), F.when(raw.startswith("-"), -size).otherwise(size))


def parse(resources: DataFrame) -> DataFrame:
    """resources: source_id, url, body. A row per event with a title and a start; a broken calendar is one row with an error."""
    unfolded = F.regexp_replace("body", "\r?\n[ \t]", "")
    count = lambda s: F.regexp_count(F.col("flat"), F.lit(rf"(?im)^{s}\s*$"))
    flat = resources.select("source_id", "url", F.sha2("body", 256).alias("raw_content_hash"), unfolded.alias("flat"))
    broken = (count("BEGIN:VCALENDAR") == 0) | (count("BEGIN:VCALENDAR") != count("END:VCALENDAR")) | (count("BEGIN:VEVENT") != count("END:VEVENT"))
    marked = flat.withColumn("error", F.when(F.coalesce(broken, F.lit(True)), "malformed calendar"))
    blocks = F.regexp_extract_all(F.col("flat"), F.lit(r"(?is)BEGIN:VEVENT\s*?\r?\n(.*?)END:VEVENT"), F.lit(1))
    rows = marked.withColumn("blocks", F.when(F.col("error").isNull(), blocks).otherwise(F.array(F.lit("")))).select("source_id", "url", "raw_content_hash", "error", F.posexplode("blocks").alias("row", "b"))
    rows = rows.select("source_id", "url", "raw_content_hash", "error", "row", *properties(F.col("b")))
    (start, start_zone, all_day), (end, end_zone, _) = local_time("DTSTART"), local_time("DTEND")
    lasting = F.timestamp_add("SECOND", duration(), start)
    number = F.coalesce(words("X-ID"), F.concat(F.lit("ics:"), F.nullif(F.regexp_extract("url", r"(?i)-(\d+)-\d+\.ical$", 1), F.lit(""))))
    person = F.coalesce(parameter("ORGANIZER", "CN"), F.nullif(F.trim(F.regexp_replace(value("ORGANIZER"), "(?i)^mailto:", "")), F.lit("")))
    status = F.upper(words("STATUS"))
    out = rows.select(
        "source_id", "url", "row", "error", "raw_content_hash", words("SUMMARY").alias("title"),
        instant(start, start_zone).alias("start"), F.coalesce(instant(end, end_zone), instant(lasting, start_zone)).alias("end"), all_day.alias("all_day"),
        words("LOCATION").alias("location"), words("DESCRIPTION").alias("description"), person.alias("organizer"),
        F.when(status.isin(STATUSES), status).otherwise("CONFIRMED").alias("status"), F.coalesce(words("URL"), F.col("url")).alias("event_url"),
        words("UID").alias("source_event_uid"), number.alias("source_x_id"), F.trim(value("SEQUENCE")).try_cast("int").alias("source_sequence"),
        instant(*local_time("LAST-MODIFIED")[:2]).alias("source_last_modified"), F.lit("ics").alias("extraction_method"), F.lit(1.0).alias("extraction_confidence"),
    )
    return out.filter("error is not null or (title is not null and start is not null)")
