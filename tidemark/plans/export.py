"""The calendar feed: RFC 5545 text in a fixed order, written in parts by the executors and put together in the store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text


def fold(line: Column) -> Column:
    """Lines of at most 75 bytes, broken before a character; further ones start with a space."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("room"))

    def step(a: Column, ch: Column) -> Column:
        size = F.octet_length(ch)
        full = a["room"] + size > 75
        return F.struct(F.concat(a["out"], F.when(full, F.lit("\r\n ")).otherwise(F.lit("")), ch).alias("out"), F.when(full, size + 1).otherwise(a["room"] + size).alias("room"))

    folded = F.aggregate(F.split(line, "(?!^)"), start, step, lambda a: a["out"])
    plain = F.concat(F.substring(line, 1, 75), F.regexp_replace(F.substring(line, F.lit(76), F.length(line)), "(?s)(.{1,74})", "\r\n $1"))
    return F.when(F.octet_length(line) <= 75, line).when(F.octet_length(line) == F.length(line), plain).otherwise(folded)


def vevents(events: DataFrame, domain: str) -> DataFrame:
    """(start, title, event_id, vevent): the text of each event."""
    c = F.col
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    day = lambda t: F.date_format(dates.berlin_day(t), "yyyyMMdd")
    local = lambda t: F.date_format(F.from_utc_timestamp(t, dates.ZONE), "yyyyMMdd'T'HHmmss")

    def when(name: str, t: Column) -> Column:
        return F.when(c("all_day"), F.concat(F.lit(f"{name};VALUE=DATE:"), day(t))).otherwise(F.concat(F.lit(f"{name};TZID={dates.ZONE}:"), local(t)))

    def said(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}:"), text.escaped(value)))

    lines = [
        F.lit("BEGIN:VEVENT"), said("SUMMARY", c("title")), when("DTSTART", c("start")), F.when(c("end").isNotNull(), when("DTEND", c("end"))), F.concat(F.lit("DTSTAMP:"), stamp(c("dtstamp"))),
        F.concat(F.lit("UID:"), c("event_id"), F.lit(f"@{domain}")), F.concat(F.lit("SEQUENCE:"), c("sequence")), F.concat(F.lit("STATUS:"), c("status")), F.concat(F.lit("LAST-MODIFIED:"), stamp(c("last_modified"))),
        said("LOCATION", c("location")), said("DESCRIPTION", c("description")),
        F.when(F.coalesce(c("organizer"), F.lit("")) != "", F.concat(F.lit('ORGANIZER;CN="'), F.regexp_replace("organizer", '["\r\n]', ""), F.lit(f'":mailto:noreply@{domain}'))),
        F.when(F.coalesce(c("event_url"), F.lit("")) != "", F.concat(F.lit("URL:"), c("event_url"))), F.lit("END:VEVENT"),
    ]
    return events.select("start", "title", "event_id", F.concat_ws("\r\n", *[fold(x) for x in lines]).alias("vevent"))


def feed(events: DataFrame, domain: str) -> DataFrame:
    """Event texts in the order of the feed."""
    return vevents(events, domain).orderBy("start", "title", "event_id").select("vevent")


def write(events: DataFrame, domain: str, path: str, name: str = "Events") -> int:
    """Writes the feed at a path of any store; gives the number of events.

    Sorted part files lie beside it until they have been copied, one after the other, between a head and a tail; the whole then takes
    the feed's place. What passes through the driver are bytes of a file, a buffer at a time.
    """
    spark = events.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    mark = uuid.uuid4().hex
    parts, whole = f"{path}.parts-{mark}", f"{path}.whole-{mark}"
    fs = at(path).getFileSystem(conf)
    fs.setWriteChecksum(False)
    try:
        feed(events, domain).write.option("lineSep", "\r\n").text(parts)
        head = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{domain}//tidemark//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{name}", f"X-WR-TIMEZONE:{dates.ZONE}"]
        manifest = sorted(f.getPath().toString() for f in fs.listStatus(at(parts)) if f.getPath().getName().startswith("part-"))
        out = fs.create(at(whole))
        try:
            out.write(bytearray("".join(f"{line}\r\n" for line in head).encode()))
            for part in manifest:  # numbered in the order of the feed
                source = fs.open(at(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                finally:
                    source.close()
            out.write(bytearray(b"END:VCALENDAR\r\n"))
        finally:
            out.close()
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri() if "://" in path else fs.getUri(), conf).rename(at(whole), at(path), over)
        return spark.read.option("lineSep", "\r\n").text(parts).filter("value = 'BEGIN:VEVENT'").count()
    finally:
        fs.delete(at(parts), True)
        fs.delete(at(whole), False)
