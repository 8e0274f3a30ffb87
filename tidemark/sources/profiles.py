"""Event profiles of semi-structured pages, as queries over html_nodes.

A profile gives raw rows (row, title, when, time, location, description, organizer, link, ident); ``finish`` turns them into
observations. Rows whose date can't be read are dropped. Places and organisers that a site doesn't print, and titles that don't count, come
from the source's configuration, as columns default_location, default_organizer and skip_titles of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from .selectors import PAGE, gathered, within

# By what a site's pages are recognised.
MARKUP = {"listing": ".cal-list-event", "table-rows": "table.ce-table", "dated-list": ".veranstaltungen .entryBody", "cards": 'main .wrapper-inner a[title="Zur Veranstaltung"]', "paragraphs": "#content_main"}
STYLED = 'span[style*="Kaushan Script"]'


def said(pieces: str = "pieces") -> Column:
    """The text of an element; null where it has none."""
    return F.nullif(F.array_join(F.transform(pieces, lambda p: p["t"]), " "), F.lit(""))


def first(field: str, what: Column | None = None) -> Column:
    """What the first element of a field says, or what else of it is asked for."""
    mine = F.col("field") == field
    return F.min_by(F.when(mine, said() if what is None else what), F.when(mine, F.col("n")))


def attr(name: str) -> Column:
    return F.element_at("attrs", name)


def pick(field: str) -> Column:
    """The first element of a field, of those found in a scope (see gathered)."""
    return F.get(F.col("found")[field], F.lit(0))


def picked(*fields: str) -> dict[str, Column]:
    """The texts of such elements."""
    return {f: pick(f)["t"] for f in fields}


def scoped(nodes: DataFrame, scope: str, fields: dict[str, str]) -> DataFrame:
    """A row for each element that scope selects: row, found (with the addresses of links), and what else is known of its page."""
    rows = gathered(nodes, {"scope": (scope, fields)}, {"link": ("href",)})
    return rows.withColumn("found", F.explode("scope")).select(*[c for c in rows.columns if c != "scope"], "found.row", "found")


#: What finish needs to know of a page.
GIVEN = {"raw_content_hash": "string", "default_location": "string", "default_organizer": "string", "skip_titles": "array<string>"}


def raw(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows of a profile; what isn't given is null."""
    none = F.lit(None).cast("string")
    names = ("title", "when", "time", "location", "description", "organizer", "link", "ident")
    return rows.select(*PAGE, "row", *[c for c in GIVEN if c in rows.columns], *[columns.get(n, none).alias(n) for n in names])


def listing(nodes: DataFrame) -> DataFrame:
    """Blocks with day, month, year, time and title in elements of their own."""
    parts = ("cal-list-title", "cal-date-day", "cal-date-month", "cal-date-year", "cal-date-time", "cal-list-type", "cal-list-teaser", "cal-list-place")
    found = scoped(nodes, ".cal-list-event", {p: f".{p}" for p in parts} | {"link": ".cal-button a[href]"})
    rows = found.withColumns(picked(*parts) | {"link": pick("link")["href"]}).filter("`cal-date-time` is not null")
    when = F.concat(F.concat("cal-date-day", F.lit(".")), F.lit(" "), "cal-date-month", F.lit(" "), "cal-date-year")
    ident = F.nullif(F.regexp_extract("link", r"/(\d+)/detail(?:$|[?#])", 1), F.lit(""))
    c = F.col
    return raw(rows, title=c("cal-list-title"), when=when, time=c("cal-date-time"), location=c("cal-list-type"), description=c("cal-list-teaser"), organizer=c("cal-list-place"), link=c("link"), ident=ident)


def table_rows(nodes: DataFrame) -> DataFrame:
    """Rows of a table: date, time, title; short rows and those without a clock time are skipped."""
    cells = scoped(nodes, "table.ce-table tr", {"cell": "td"})
    cell = lambda i: F.coalesce(F.get("found.cell", F.lit(i))["t"], F.lit(""))
    return raw(cells.filter(F.size("found.cell") >= 3), title=F.nullif(cell(2), F.lit("")), when=F.regexp_substr(cell(0), F.lit(r"\d{1,2}\.\d{1,2}\.20\d{2}")), time=cell(1)).filter(r"time rlike '\\d{1,2}[.:]\\d{2}'")


def dated_list(nodes: DataFrame) -> DataFrame:
    """Date headings and bodies side by side: each body has the date of the last heading before it."""
    sides = within(nodes, ".veranstaltungen", {"head": ":scope > .entryHeadDate", "body": ":scope > .entryBody"})
    w = Window.partitionBy(*PAGE, "row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    dated = sides.withColumn("when", F.last(F.when(F.col("field") == "head", said()), ignorenulls=True).over(w))
    bodies = dated.filter("field = 'body' and when is not null").select(*PAGE, F.col("n").alias("row"), "when", F.regexp_replace("lead", "^Veranstalter:", "").alias("lead"))
    parts = within(nodes, ".veranstaltungen > .entryBody", {"title": ".wglListEntryDetails h2 a[href]", "left": ".leftCol", "details": ".wglListEntryDetails", "heading": ".wglListEntryDetails h2"})
    rows = parts.groupBy(*PAGE, "row").agg(
        first("title").alias("title"), first("title", attr("href")).alias("link"), first("left", F.col("pieces")).alias("left"), first("details", F.col("pieces")).alias("details"), first("heading", F.struct("n", "last")).alias("heading"),
    )
    place = F.get(F.filter(F.transform("left", lambda p: p["t"]), lambda t: ~t.rlike(r"\d{1,2}[.:]\d{2}") & ~F.contains(text.casefold(t), F.lit("onlineticket"))), F.lit(0))
    rest = F.filter("details", lambda p: F.col("heading").isNull() | (p["n"] < F.col("heading.n")) | (p["n"] > F.col("heading.last")))
    joined = rows.withColumns({"time": said("left"), "place": place, "rest": rest}).join(bodies, [*PAGE, "row"]).filter("title is not null and time is not null")
    ident = F.coalesce(F.nullif(F.regexp_extract("link", r"[?&]vDetail=([^&#]+)", 1), F.lit("")), text.slug(F.col("title")))
    return raw(joined, title=F.col("title"), when=F.col("when"), time=F.col("time"), location=F.col("place"), description=said("rest"), organizer=F.nullif(F.trim("lead"), F.lit("")), link=F.col("link"), ident=ident)


def cards(nodes: DataFrame) -> DataFrame:
    """Cards with a headline, a date or range in bold, and a link to the event."""
    found = scoped(nodes, "main .wrapper-inner", {"title": "h2.ce_headline", "when": ".ce_text strong", "body": ".ce_text", "link": 'a[title="Zur Veranstaltung"][href]'})
    rows = found.withColumns(picked("title", "when", "body") | {"link": pick("link")["href"]}).filter("title is not null and when is not null and link is not null")
    at = F.position(F.col("when"), F.col("body"))
    rest = F.when(at > 0, F.concat(F.substring("body", F.lit(1), at - 1), F.substring("body", at + F.length("when"), F.length("body")))).otherwise(F.col("body"))
    ident = text.slug(F.regexp_replace("link", "^[a-zA-Z]+://[^/]*|[?#].*$", ""))
    return raw(rows, title=F.col("title"), when=F.col("when"), description=F.nullif(F.regexp_replace(rest, "^[ :]+", ""), F.lit("")), link=F.col("link"), ident=ident)


def paragraphs(nodes: DataFrame, ahead: int = 4) -> DataFrame:
    """Headings set in a decorative font; of the paragraphs that follow, the last dated one counts. The events last whole days."""
    found = within(nodes, "#content_main", {"p": ":scope > p", "head": f":scope > p {STYLED}"})
    order = Window.partitionBy(*PAGE, "row").orderBy("n", F.desc("last"))
    inside = F.last(F.when(F.col("field") == "p", F.col("n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = found.withColumn("p", inside).groupBy(*PAGE, "row", "p").agg(first("p").alias("t"), first("head").alias("title"))
    order = Window.partitionBy(*PAGE, "row").orderBy("p")
    grouped = each.withColumn("g", F.sum(F.col("title").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*PAGE, "row", "g").orderBy("p").rowsBetween(1, ahead)
    dated = F.contains("t", F.lit("Termin")) & F.col("t").rlike(r"20\d\d")
    seen = grouped.withColumn("when", F.last(F.when(dated, F.col("t")), ignorenulls=True).over(w)).withColumn("description", F.array_join(F.collect_list("t").over(w), " "))
    rows = seen.filter("title is not null and when is not null").select(*PAGE, F.col("p").alias("row"), F.trim(F.regexp_replace("title", "[. ]+$", "")).alias("title"), "when", F.nullif("description", F.lit("")).alias("description"))
    return raw(rows, title=F.col("title"), when=F.col("when"), description=F.col("description"))


PROFILES = {"listing": listing, "table-rows": table_rows, "dated-list": dated_list, "cards": cards, "paragraphs": paragraphs}
#: Profiles whose link ids name an event, not a series of them.
OWN_IDS = ("listing",)


def recognised(pages: DataFrame, nodes_of) -> DataFrame:
    """(source_id, url): those pages, of a known profile, that still have its markup. nodes_of: html_nodes.nodes."""
    rows = nodes_of(pages)
    found = within(rows, "", MARKUP).select(*PAGE, F.col("field").alias("profile")).distinct()
    return pages.select(*PAGE, "profile").join(found, [*PAGE, "profile"], "left_semi").select(*PAGE).distinct()


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page."""
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), r"(://[^/]*)$|/[^/]*$", "$1")
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(urls.scheme(base), F.lit(":"), link)).when(link.startswith("/"), F.concat(origin, link)).when(link.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), link)).otherwise(F.concat(folder, F.lit("/"), link))


def known(pages: DataFrame) -> DataFrame:
    """Pages with what finish needs to know of them."""
    given = [F.col(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in GIVEN.items() if c != "raw_content_hash"]
    return pages.select(*PAGE, "body", F.sha2("body", 256).alias("raw_content_hash"), *given)


def finish(raw: DataFrame, pages: DataFrame, profile: str) -> DataFrame:
    """Observations: timed where a time is given, else all days from the first to the last one."""
    rows = raw.withColumn("span", dates.german_range(F.col("when"))).withColumn("minutes", dates.german_time(F.col("time"))).filter("span is not null and title is not null")
    if any(c not in raw.columns for c in GIVEN):
        rows = rows.join(known(pages).drop("body"), PAGE)
    skipped = F.exists(F.coalesce("skip_titles", F.array().cast("array<string>")), lambda t: text.casefold(t) == text.casefold(F.col("title")))
    rows = rows.filter(~skipped)
    midnight = F.col("span.first").cast("timestamp_ntz")
    timed = F.col("minutes").isNotNull()
    start = F.when(timed, F.convert_timezone(F.lit(dates.ZONE), F.lit("UTC"), F.timestamp_add("MINUTE", F.col("minutes"), midnight)).cast("timestamp")).otherwise(dates.berlin_midnight(F.col("span.first")))
    dated = F.concat(F.coalesce("ident", text.slug(F.col("title"))), F.lit(":"), dates.iso_berlin(start))
    own = F.coalesce("ident", dated) if profile in OWN_IDS else dated
    return observed(
        rows, "row", title=F.col("title"), start=start, end=F.when(~timed, dates.berlin_midnight(F.col("span.end"))), all_day=~timed, location=F.coalesce("location", "default_location"), description=F.col("description"), organizer=F.coalesce("organizer", "default_organizer"),
        event_url=F.coalesce(absolute(F.col("url"), F.col("link")), F.col("url")), source_x_id=F.concat(F.lit(f"{profile}:"), own),
    )


def observed(rows: DataFrame, row: str, **c: Column) -> DataFrame:
    """Observations of pages whose structure is known."""
    none = F.lit(None).cast("string")
    return rows.select(
        *PAGE, F.col(row).cast("int").alias("row"), none.alias("error"), "raw_content_hash", c["title"].alias("title"), c["start"].alias("start"), c["end"].alias("end"), c["all_day"].alias("all_day"),
        c["location"].alias("location"), c["description"].alias("description"), c["organizer"].alias("organizer"), F.lit("CONFIRMED").alias("status"), c["event_url"].alias("event_url"), none.alias("source_event_uid"),
        c["source_x_id"].alias("source_x_id"), F.lit(None).cast("int").alias("source_sequence"), F.lit(None).cast("timestamp").alias("source_last_modified"), F.lit("structured-html").alias("extraction_method"), F.lit(1.0).alias("extraction_confidence"),
    )


def parse(pages: DataFrame, nodes: DataFrame, profile: str) -> DataFrame:
    return finish(PROFILES[profile](known(nodes) if "body" in nodes.columns else nodes), pages, profile)
