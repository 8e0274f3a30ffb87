"""Detail pages of one event without machine-readable data: a title, a description that names dates and hours, and blocks of addresses.

A label inside a block governs what follows it until the next one: the lines of the first block are the place, and the first line
under the label of an organiser is the organiser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from .profiles import observed, pick
from .selectors import PAGE, gathered

# Elements of such pages, the label of an organiser, the name of the link to the event's own page.
TITLE, DESCRIPTION, ADDRESS, LINKS = "h1.d1i-head__title", "#descriptionText .toujou-text-clamper__content", "#d1iAddressesSection address.d1i-address", "#d1iSidebarButtonsSection a[href]"
LINE, LINKED, LABEL = "d1i-address__info", "d1i-address__info--with-link", ".d1i-section__subtitle"
ORGANISER, WEBSITE = "veranstalter", "website"
HOURS = r"(?i:Beginn(?:\s+ist)?(?:\s+jeweils)?\s+um\s+(\d{1,2})(?::(\d{2}))?\s*Uhr(?-s:.){0,120}?Ende(?:\s+gegen|\s+um)?\s+(\d{1,2})(?::(\d{2}))?\s*Uhr)"


def clock_range(said: Column) -> Column:
    """struct(first, last): minutes after midnight at which a text says that something begins and ends; null where it doesn't say so."""
    t = F.split(F.regexp_replace(said, f"(?s)^(?:.*?{HOURS}|).*", "$1 $2 $3 $4"), " ")

    def read(t: Column) -> Column:
        h, m, h2, m2 = [F.nullif(F.get(t, F.lit(i)), F.lit("")).try_cast("int") for i in range(4)]  # a cast that fails is slow
        m, m2 = F.coalesce(m, F.lit(0)), F.coalesce(m2, F.lit(0))
        return F.when((h < 24) & (h2 < 24) & (m < 60) & (m2 < 60), F.struct((h * 60 + m).alias("first"), (h2 * 60 + m2).alias("last")))

    return F.get(F.transform(F.array(t), read), F.lit(0))


def instants(span: Column, clock: Column) -> tuple[Column, Column]:
    """Start and end of days with hours: from the first day's first hour to the last day's last one, or the next day's where that came before."""
    at = lambda day, minutes: F.convert_timezone(F.lit(dates.ZONE), F.lit("UTC"), F.timestamp_add("MINUTE", minutes, day.cast("timestamp_ntz"))).cast("timestamp")
    start, last = at(span["first"], clock["first"]), F.date_add(span["end"], -1)
    over = (span["first"] == last) & (clock["last"] < clock["first"])
    end = at(F.when(over, F.date_add(last, 1)).otherwise(last), clock["last"])
    whole = clock.isNull()
    return F.when(whole, dates.berlin_midnight(span["first"])).otherwise(start), F.when(whole, dates.berlin_midnight(span["end"])).otherwise(end)


def _organizer(block: Column) -> Column:
    """The first line that an organiser's label governs: of labels and lines with a text, the one right after it."""
    said = lambda field, kind: F.transform(F.filter(block[field], lambda x: x["t"].isNotNull()), lambda x: F.struct(x["n"].alias("n"), F.lit(kind).alias("kind"), x["t"].alias("t")))

    def first(s: Column) -> Column:
        after = lambda x, i: (x["kind"] == 1) & (F.get(s, i - 1)["kind"] == 0) & (text.casefold(F.get(s, i - 1)["t"]) == ORGANISER)
        return F.get(F.filter(s, after), F.lit(0))["t"]

    return F.when(F.exists(block["label"], lambda x: text.casefold(x["t"]) == ORGANISER), F.get(F.transform(F.array(F.array_sort(F.concat(said("label", 0), said("line", 1)))), first), F.lit(0)))


def parse(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """An observation for each page with a title, a description and a date in it. pages: source_id, url, body."""
    hashed = pages.select(*PAGE, "body", F.sha2("body", 256).alias("raw_content_hash"))
    searches = {"page": ("", {"title": TITLE, "description": DESCRIPTION, "link": LINKS}), "address": (ADDRESS, {"line": f".{LINE}", "plain": f".{LINE}:not(.{LINKED})", "label": LABEL})}
    attrs = {"link": ("href",)}
    found = gathered(hashed, searches, attrs) if "body" in nodes.columns else gathered(nodes, searches, attrs).join(hashed.drop("body"), PAGE)
    site = lambda x: (text.casefold(x["t"]) == WEBSITE) & F.trim(x["href"]).rlike("^https?://")
    heads = found.withColumn("found", F.get("page", F.lit(0)))
    lines = F.array_distinct(F.get("address", F.lit(0))["plain"]["t"])
    organizers = F.filter(F.transform("address", _organizer), lambda o: o.isNotNull())
    named = heads.select(
        *PAGE, "raw_content_hash", pick("title")["t"].alias("title"), pick("description")["t"].alias("description"), F.trim(F.get(F.filter("found.link", site), F.lit(0))["href"]).alias("site"),
        F.nullif(F.array_join(lines, ", "), F.lit("")).alias("location"), F.get(organizers, F.lit(0)).alias("organizer"),
    )
    span = F.explode_outer(F.array(dates.german_range(F.when(F.col("title").isNotNull(), F.col("description")))))  # so that the filter doesn't work it out once more
    rows = named.withColumn("span", span).filter("span is not null").withColumn("clock", clock_range(F.col("description")))
    start, end = instants(F.col("span"), F.col("clock"))
    path = F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]*|[?#].*$", "")
    ident = F.coalesce(F.nullif(F.regexp_extract(path, r"-(\d+)/?$", 1), F.lit("")), text.casefold(F.col("title")))
    whole = rows.select(*PAGE, "raw_content_hash", F.lit(0).alias("row"), "title", "description", "site", "location", "organizer", start.alias("start"), end.alias("end"), F.col("clock").isNull().alias("all_day"), ident.alias("ident"))
    return observed(
        whole, "row", title=F.col("title"), start=F.col("start"), end=F.col("end"), all_day=F.col("all_day"), location=F.col("location"), description=F.col("description"), organizer=F.col("organizer"),
        event_url=F.coalesce("site", "url"), source_x_id=F.concat(F.lit("detail:"), "ident", F.lit(":"), dates.iso_berlin(F.col("start"))),
    )
