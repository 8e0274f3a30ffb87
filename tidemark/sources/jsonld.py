"""schema.org events in pages: a small walk finds the event objects, columns do the rest."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import history
from . import html_nodes

SCRIPT = re.compile(r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>')
FIELDS = ["name", "start", "end", "description", "location", "organizer", "identifier", "status", "link"]
ARROW = pa.schema([(c, pa.string()) for c in ("source_id", "url", "raw_content_hash")] + [("row", pa.int32())] + [(f, pa.string()) for f in FIELDS])
#: Event objects that are passed on at a time; those of one page stay together.
ROWS = 5000


def _walk(value) -> Iterator[dict]:
    """Event objects in document order, however deep."""
    rest = [value]
    while rest:
        value = rest.pop()
        if isinstance(value, dict):
            if kinds := value.get("@type"):
                if any(str(k).rsplit("/", 1)[-1].casefold() == "event" for k in (kinds if isinstance(kinds, list) else [kinds])):
                    yield value
            value = value.values()
        elif not isinstance(value, list):
            continue
        rest.extend([v for v in reversed(value) if isinstance(v, (dict, list))])


def _named(value) -> str | None:
    """A name, that of a thing, or those of a list, each once."""
    if isinstance(value, list):
        return ", ".join(dict.fromkeys(n for v in value if (n := _named(v)))) or None
    if isinstance(value, dict):
        value = value.get("name")
    return value.strip() or None if isinstance(value, str) else None


def _place(value) -> str | None:
    """Name, street, and postal code with town of a place; several places stand side by side."""
    if isinstance(value, list):
        return " / ".join(dict.fromkeys(p for v in value if (p := _place(v)))) or None
    if not isinstance(value, dict):
        return value.strip() or None if isinstance(value, str) else None
    address = value.get("address")
    parts = [_named(value)]
    if isinstance(address, str):
        parts.append(address.strip())
    elif isinstance(address, dict):
        street, code, town = (str(address.get(k) or "").strip() for k in ("streetAddress", "postalCode", "addressLocality"))
        parts += [street, f"{code} {town}".strip()]
    return ", ".join(dict.fromkeys(p for p in parts if p)) or None


def _identifier(value) -> str | None:
    """The first that says something."""
    if isinstance(value, (str, int)):
        return str(value).strip() or None
    inner = value if isinstance(value, list) else [value.get(k) for k in ("value", "@value", "name")] if isinstance(value, dict) else []
    return next((i for v in inner if (i := _identifier(v))), None)


def _plain(value) -> str | None:
    """The text of a description, which may be HTML; single-spaced."""
    if not isinstance(value, str):
        return None
    if "<" in value or "&" in value:
        tree = html_nodes.Nodes()
        tree.read(value)
        value = " ".join(t for t in tree.text if t)
    return " ".join(value.split()) or None


def _told(body: str) -> Iterator[tuple]:
    """The fields of each event object of a page, in document order."""
    for raw in SCRIPT.findall(body):
        try:
            found = list(_walk(json.loads(raw)))
        except (ValueError, RecursionError):  # not JSON, or nested beyond what the reader takes
            continue
        for e in found:
            said = (_named(e.get("name")), *(x if isinstance(x, str) else None for x in (e.get("startDate"), e.get("endDate"))), _plain(e.get("description")))
            link = e.get("url")
            yield (*said, _place(e.get("location")), _named(e.get("organizer")), _identifier(e.get("identifier")), str(e.get("eventStatus") or ""), link.strip() if isinstance(link, str) else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The event objects of many pages go on together: a batch for each page costs far more than what it holds."""
    for b in batches:
        rows = []
        for page in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows.extend((*page[:3], i, *e) for i, e in enumerate(_told(page[3] or "")))
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def objects(pages: DataFrame) -> DataFrame:
    """(source_id, url, raw_content_hash, row, fields): each event object of a page, in document order, its fields as text."""
    return pages.select("source_id", "url", F.sha2("body", 256).alias("raw_content_hash"), "body").mapInArrow(_read, "source_id string, url string, raw_content_hash string, row int, " + ", ".join(f"{f} string" for f in FIELDS))


def moment(value: Column) -> Column:
    """A date is Berlin's midnight; a time with an offset is as said, one without is Berlin's."""
    offset = value.rlike(r"T.*(Z|[+-]\d\d:?\d\d)$")
    berlin = F.to_utc_timestamp(F.try_to_timestamp(value), dates.ZONE)
    return F.when(~F.contains(value, F.lit("T")), dates.berlin_midnight(F.try_to_date(value))).when(offset, F.try_to_timestamp(value)).otherwise(berlin)


def status(said: Column) -> Column:
    """The state of an event, by the last part of its schema.org address."""
    tail = text.casefold(F.element_at(F.split(said, "/"), -1))
    return F.when(tail.isin("eventcancelled", "cancelled"), "CANCELLED").when(tail.isin("eventpostponed", "eventrescheduled", "eventtentative", "tentative"), "TENTATIVE").otherwise("CONFIRMED")


def parse(pages: DataFrame) -> DataFrame:
    """A row per event object with a name and a start; of equal (identifier, name, start) the first."""
    found = objects(pages)
    day = ~F.contains("start", F.lit("T"))
    found = found.withColumns({"_start": moment(F.col("start")), "_end": moment(F.col("end")), "_title": text.squeeze(F.col("name"))}).filter("_title is not null and _start is not null")
    start, end, title = F.col("_start"), F.col("_end"), F.col("_title")
    last = F.when(F.to_date(F.try_to_timestamp("end")) >= F.to_date(F.try_to_timestamp("start")), F.try_to_date(F.substring("end", 1, 10))).when(F.col("end").isNull(), F.try_to_date("start"))
    rows = found.select(
        "source_id", "url", "row", F.lit(None).cast("string").alias("error"), "raw_content_hash", title.alias("title"), start.alias("start"),
        F.when(day, dates.berlin_midnight(F.date_add(last, 1))).otherwise(end).alias("end"), day.alias("all_day"), "location", "description", "organizer",
        status(F.col("status")).alias("status"),
        F.when(F.col("link").rlike("^https?://"), F.col("link")).otherwise(F.col("url")).alias("event_url"), F.lit(None).cast("string").alias("source_event_uid"),
        F.concat(F.lit("jsonld:"), "identifier", F.lit(":"), dates.iso_berlin(start)).alias("source_x_id"), F.lit(None).cast("int").alias("source_sequence"),
        F.lit(None).cast("timestamp").alias("source_last_modified"), F.lit("json-ld").alias("extraction_method"), F.lit(1.0).alias("extraction_confidence"),
    )
    keyed = rows.withColumn("_title", text.casefold(F.col("title")))
    return history.first_of(keyed, ["source_id", "url", "source_x_id", "_title", "start"], ["row"]).drop("_title")
