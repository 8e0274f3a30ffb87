"""Queries that write the driver's rows as calendars and pages, and read them back with the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..sources import detail, ics, jsonld, model, profiles, sitemaps
from .scalar_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""select o_orderkey, 'Order; ' || o_orderpriority || ', x' as title, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') as starts, o_custkey % 3 as seq, case when o_orderstatus = 'F' then 'CANCELLED' else 'CONFIRMED' end as status from orders""")
def ics_roundtrip(spark, sf_dir):
    lines = [F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "o_orderkey"), F.concat(F.lit("SUMMARY:"), text.escaped(F.concat(F.lit("Order; "), "o_orderpriority", F.lit(", x")))), F.concat(F.lit("DTSTART:"), F.date_format(F.date_trunc("day", "o_orderdate"), "yyyyMMdd'T'HHmmss'Z'")), F.lit("DURATION:PT1H"), F.concat(F.lit("SEQUENCE:"), F.col("o_custkey") % 3), F.concat(F.lit("STATUS:"), F.when(F.col("o_orderstatus") == "F", "CANCELLED").otherwise("unknown")), F.lit("END:VEVENT"), F.lit("END:VCALENDAR")]
    said = table(spark, sf_dir, "orders").select(F.lit("o").alias("source_id"), F.concat(F.lit("https://x/"), "o_orderkey").alias("url"), F.concat_ws("\r\n", *lines).alias("body"))
    return ics.parse(said).select(F.col("source_event_uid").cast("long").alias("o_orderkey"), "title", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("starts"), F.col("source_sequence").cast("long").alias("seq"), "status")


def _spread(rows):
    """Orders over all cores: a file of them is small beside the pages that are made of it, so its parts are too few."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "o_orderkey")


_STATES = ["EventCancelled", "https://schema.org/eventcancelled", "cancelled", "https://schema.org/EventPostponed", "EventRescheduled", "tentative", "https://schema.org/EventScheduled"]


@query("""select o_orderkey, o_orderpriority as title, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') as starts,
case when o_custkey % 3 = 0 then 'Hall ' || o_custkey % 10 || ', Way 1, 0' || o_custkey % 7 || ' Town / Park' when o_custkey % 3 = 1 then 'Hall ' || o_custkey % 10 || ', Town' else 'Hall ' || o_custkey % 10 || ', by the lake' end as location,
case when o_orderkey % 7 < 3 then 'CANCELLED' when o_orderkey % 7 < 6 then 'TENTATIVE' else 'CONFIRMED' end as status, case when o_orderkey % 5 = 0 then null else o_orderkey end as ident from orders""")
def jsonld_roundtrip(spark, sf_dir):
    """An event object for each order, with places, states and identifiers of all kinds, read back by the parser."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    quoted = lambda c: F.to_json(F.struct(c.alias("x")))
    inner = lambda c: F.expr("substring(j, 6, length(j) - 6)") if c is None else F.substring(quoted(c), F.lit(6), F.length(quoted(c)) - 6)
    hall = F.concat(F.lit("Hall "), n % 10)
    address = F.when(n % 3 == 0, F.concat(F.lit('{"streetAddress":"Way 1","postalCode":"0'), n % 7, F.lit('","addressLocality":"Town"}'))).when(n % 3 == 1, F.lit('{"addressLocality":"Town"}')).otherwise(F.lit('" by the lake "'))
    place = F.concat(F.lit('{"@type":"Place","name":" '), hall, F.lit('","address":'), address, F.lit("}"))
    places = F.when(n % 3 == 0, F.concat(F.lit("["), place, F.lit(',"Park",'), place, F.lit("]"))).otherwise(place)
    state = F.element_at(F.array(*map(F.lit, _STATES)), (k % 7 + 1).cast("int"))
    ident = F.when(k % 5 == 0, F.lit('{"caption":"none"}')).when(k % 5 == 1, F.concat(F.lit('[{"name":"","value":'), k, F.lit(',"name":"ID"},8]'))).when(k % 5 == 2, F.concat(F.lit('[[],"",{"@value":"'), k, F.lit('"}]'))).otherwise(k.cast("string"))
    named = F.when(k % 2 == 0, inner(F.col("o_orderpriority"))).otherwise(F.concat(F.lit('{"name":'), inner(F.col("o_orderpriority")), F.lit("}")))
    event = F.concat(F.lit('{"@type":'), F.when(k % 2 == 0, '["Thing","https://schema.org/Event"]').otherwise('"event"'), F.lit(',"name":'), named, F.lit(',"startDate":"'), F.date_format(F.date_trunc("day", "o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","location":'), places, F.lit(',"eventStatus":"'), state, F.lit('","identifier":'), ident, F.lit("}"))
    again = F.replace(event, hall, F.lit("Elsewhere"))  # told once more, so it is left out
    deep = F.when(k % 50 == 0, F.concat(F.lit('<script type="application/ld+json">'), F.repeat(F.lit("["), F.lit(3000)), F.lit("</script>"))).otherwise("")
    page = F.concat(F.lit("<html>"), deep, F.lit('<script type="application/ld+json">{"@graph":['), event, F.when(k % 4 == 0, F.concat(F.lit(","), again)).otherwise(""), F.lit("]}</script></html>"))
    orders = _spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")).select(F.lit("o").alias("source_id"), F.concat(F.lit("https://x/"), "o_orderkey").alias("url"), page.alias("body"))
    found = jsonld.parse(orders)
    return found.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("o_orderkey"), "title", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("starts"), "location", "status", F.nullif(F.regexp_extract("source_x_id", r"^jsonld:([^:]*):", 1), F.lit("")).cast("long").alias("ident"))


def _pages(rows, key: str, block, top: str, bottom: str, **given):
    """A page for each key, of the blocks of its orders in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(key).agg(body.alias("rows")).select(F.lit("o").alias("source_id"), F.concat(F.lit("https://x/p/"), key).alias("url"), F.concat(F.lit(top), "rows", F.lit(bottom)).alias("body"), *[v.alias(k) for k, v in given.items()])


def _told(spark, pages, profile):
    """What a profile reads, by the number in the title."""
    found = profiles.parse(pages, pages, profile)
    return found.select(F.regexp_extract("title", r"(\d+)$", 1).cast("long").alias("o_orderkey"), F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page"), F.date_format(F.from_utc_timestamp("start", "Europe/Berlin"), "yyyy-MM-dd HH:mm").alias("starts"), "all_day", "location", "description", "organizer", F.regexp_replace("event_url", "^https://x/", "").alias("link"), "source_x_id")


def _dated(spark, sf_dir):
    day = F.date_format(F.add_months(F.to_date("o_orderdate"), 336), "d.M.yyyy")
    return table(spark, sf_dir, "orders").withColumns({"day": day, "iso": F.date_format(F.add_months(F.to_date("o_orderdate"), 336), "yyyy-MM-dd"), "name": F.concat(F.lit("Order "), "o_orderkey")})


_ISO = "strftime(cast(o_orderdate as date) + interval 28 year, '%Y-%m-%d')"
#: The offset of Berlin at a time of an order's day.
_OFFSET = "case when cast(o_orderdate as date) + interval 28 year + interval 10 hour >= m - to_days(dayofweek(m)::int) + interval 2 hour and cast(o_orderdate as date) + interval 28 year + interval 10 hour < o - to_days(dayofweek(o)::int) + interval 3 hour then '+02:00' else '+01:00' end"
_DAYS = "(select *, make_date(year(o_orderdate) + 28, 3, 31)::timestamp as m, make_date(year(o_orderdate) + 28, 10, 31)::timestamp as o from orders) t"


@query(f"""select o_orderkey, o_custkey as page, {_ISO} || ' 10:30' as starts, false as all_day, 'the hall' as location, null::varchar as description, 'the club' as organizer, 'p/' || o_custkey as link,
'table-rows:order-' || o_orderkey || ':' || {_ISO} || 'T10:30:00' || {_OFFSET} as source_x_id from {_DAYS} where o_orderkey % 9 <> 0""")
def profile_roundtrip(spark, sf_dir):
    """A table page for each customer, with a row per order, read back by its profile; place, organiser and titles to skip come from the configuration."""
    row = F.concat(F.lit("<tr><td>am "), "day", F.lit("</td><td>10:30 Uhr</td><td><b>"), F.when(F.col("o_orderkey") % 9 == 0, "PAUSE").otherwise(F.col("name")), F.lit("</b></td></tr>"))
    pages = _pages(_dated(spark, sf_dir), "o_custkey", row, '<table class="ce-table x"><tr><th>Datum</th></tr><tr><td>kurz</td></tr>', "</table><table><tr><td>1.1.2030</td><td>10:00</td><td>Order 1</td></tr></table>", default_location=F.lit("the hall"), default_organizer=F.lit("the club"), skip_titles=F.array(F.lit("Pause")))
    return _told(spark, pages, "table-rows")


@query(f"""select o_orderkey, o_custkey as page, {_ISO} || ' 09:05' as starts, false as all_day, 'Room ' || o_custkey % 5 as location, 'More on it' as description, 'Host' as organizer, case when o_orderkey % 2 = 0 then 'c/' || o_orderkey || '/detail' else 'p/' || o_custkey end as link,
case when o_orderkey % 2 = 0 then 'listing:' || o_orderkey else 'listing:order-' || o_orderkey || ':' || {_ISO} || 'T09:05:00' || {_OFFSET} end as source_x_id from {_DAYS}""")
def listing_roundtrip(spark, sf_dir):
    """A listing for each customer, a block per order."""
    part = lambda name, value: F.concat(F.lit(f'<i class="{name}">'), value, F.lit("</i>"))
    months = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month(F.to_date("day", "d.M.yyyy")))
    link = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('<p class="cal-button"><a>-</a><a href="/c/'), "o_orderkey", F.lit('/detail">x</a></p>'))).otherwise("")
    block = F.concat(F.lit('<div class="a cal-list-event"><p>'), part("cal-date-day", F.dayofmonth(F.to_date("day", "d.M.yyyy")).cast("string")), part("cal-date-month", months), part("cal-date-year", F.element_at(F.split("day", "[.]"), -1)), part("cal-date-time", F.lit("9.05 Uhr")), F.lit("</p>"), part("cal-list-title", F.col("name")), part("cal-list-type", F.concat(F.lit("Room "), F.col("o_custkey") % 5)), part("cal-list-teaser", F.lit("<b>More</b> on it")), part("cal-list-place", F.lit("Host")), link, F.lit("</div>"))
    return _told(spark, _pages(_dated(spark, sf_dir), "o_custkey", block, "<div>", "</div>"), "listing")


@query(f"""select o_orderkey, o_custkey as page, {_ISO} || ' 19:30' as starts, false as all_day, 'Room ' || o_custkey % 5 as location, 'with guests' as description, 'Club' as organizer, 'p/' || o_custkey || '?vDetail=s' as link,
'dated-list:s:' || {_ISO} || 'T19:30:00' || {_OFFSET} as source_x_id from {_DAYS}""")
def dated_list_roundtrip(spark, sf_dir):
    """A list for each customer, headings with days before the orders of a series; the start tells its dates apart."""
    block = F.concat(F.lit('<div class="entryHeadDate"><b>Am '), "day", F.lit('</b></div><div class="entryBody">Veranstalter: Club<div class="leftCol"><b>19:30 h</b><br>OnlineTicket<br>Room '), F.col("o_custkey") % 5, F.lit('</div><div class="wglListEntryDetails"><h2><a href="?vDetail=s">'), "name", F.lit("</a></h2><p>with guests</p></div></div>"))
    return _told(spark, _pages(_dated(spark, sf_dir), "o_custkey", block, '<div class="veranstaltungen">', "</div>"), "dated-list")


@query(f"""select o_orderkey, o_custkey as page, {_ISO} || ' 00:00' as starts, true as all_day, 'land' as location, 'much to see' as description, null::varchar as organizer, 'e/' || o_custkey % 3 as link,
'cards:e-' || o_custkey % 3 || ':' || {_ISO} || 'T00:00:00' || {_OFFSET.replace("interval 10 hour", "interval 0 hour")} as source_x_id from {_DAYS} where o_orderkey % 4 <> 0""")
def cards_roundtrip(spark, sf_dir):
    """Cards for each customer; those whose link isn't one to an event don't count."""
    title = F.when(F.col("o_orderkey") % 4 == 0, "Impressum").otherwise("Zur Veranstaltung")
    block = F.concat(F.lit('<div class="wrapper-inner"><h2 class="ce_headline">'), "name", F.lit('</h2><div class="ce_text"><p><strong>'), "day", F.lit('</strong>: much to see</p></div><a href="/e/'), F.col("o_custkey") % 3, F.lit('" title="'), title, F.lit('">x</a></div>'))
    return _told(spark, _pages(_dated(spark, sf_dir), "o_custkey", block, "<main>", "</main>", default_location=F.lit("land")), "cards")


@query(f"""select o_orderkey, o_custkey as page, {_ISO} || ' 00:00' as starts, true as all_day, null::varchar as location, 'words Termin ' || strftime(cast(o_orderdate as date) + interval 28 year, '%-d.%-m.%Y') || ' um 18:00 Uhr' as description, null::varchar as organizer, 'p/' || o_custkey as link,
'paragraphs:order-' || o_orderkey || ':' || {_ISO} || 'T00:00:00' || {_OFFSET.replace("interval 10 hour", "interval 0 hour")} as source_x_id from {_DAYS}""")
def paragraphs_roundtrip(spark, sf_dir):
    """Paragraphs for each customer: styled headings, then text with a date; a clock time in it doesn't make them timed."""
    block = F.concat(F.lit('<p>- <span style="font-family: kaushan script">'), "name", F.lit(".</span> -</p><p>words</p><p></p><p>Termin "), "day", F.lit(" um 18:00 Uhr</p>"))
    return _told(spark, _pages(_dated(spark, sf_dir), "o_custkey", block, '<div id="content_main">', "</div>"), "paragraphs")


@query(f"""with t as (select *, o_orderkey % 20 + 4 as h, (o_orderkey * 7) % 20 + 4 as e from {_DAYS} where o_orderkey % 11 <> 0)
select o_orderkey, 'Order ' || o_orderkey as title, {_ISO} || case when o_orderkey % 3 = 0 then ' 00:00' else ' ' || lpad(h::varchar, 2, '0') || ':15' end as starts,
case when o_orderkey % 3 = 0 then strftime(cast(o_orderdate as date) + interval 28 year + interval 2 day, '%Y-%m-%d 00:00') when o_orderkey % 3 = 1 then strftime(cast(o_orderdate as date) + interval 28 year + case when e * 60 < h * 60 + 15 then interval 1 day else interval 0 day end, '%Y-%m-%d') || ' ' || lpad(e::varchar, 2, '0') || ':00'
else strftime(cast(o_orderdate as date) + interval 28 year + interval 1 day, '%Y-%m-%d') || ' ' || lpad(e::varchar, 2, '0') || ':00' end as ends, o_orderkey % 3 = 0 as all_day, 'Field ' || o_custkey || ', 1 Town' as location, case when o_orderkey % 2 = 0 then 'Club ' || o_custkey end as organizer,
case when o_orderkey % 2 = 0 then 'https://club/' || o_orderkey else 'https://x/fair-' || o_orderkey || '/' end as event_url from t""")
def detail_roundtrip(spark, sf_dir):
    """A detail page for each order, with one day or two, with hours (some over midnight) or without, read back; such without a date give nothing."""
    k = F.col("o_orderkey")
    first = F.add_months(F.to_date("o_orderdate"), 336)
    day = lambda d: F.date_format(d, "dd.MM.yyyy")
    when = F.when(k % 11 == 0, "bald").when(k % 3 == 1, day(first)).otherwise(F.concat(day(first), F.lit("-"), day(F.date_add(first, 1))))
    hours = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" Beginn ist jeweils um "), k % 20 + 4, F.lit(":15 Uhr und <i>das Ende gegen "), (k * 7) % 20 + 4, F.lit(" Uhr</i>.")))
    line = lambda t, more="": F.concat(F.lit(f'<p class="d1i-address__info{more}">'), t, F.lit("</p>"))
    place = F.concat(F.lit('<address class="d1i-address">'), line(F.concat(F.lit("Field "), "o_custkey")), line(F.lit("1 Town")), line(F.lit("map"), " d1i-address__info--with-link"), line(F.lit("1 Town")), F.lit("</address>"))
    label = F.when(k % 2 == 0, "Veranstalter").otherwise("Kontakt")
    other = F.concat(F.lit('<address class="d1i-address"><h4 class="d1i-section__subtitle">'), label, F.lit("</h4>"), line(F.concat(F.lit("Club "), "o_custkey")), line(F.lit("2 Town")), F.lit("</address>"))
    site = F.concat(F.lit('<section id="d1iSidebarButtonsSection"><a href="/map">Karte</a><a href="'), F.when(k % 2 == 0, F.concat(F.lit("https://club/"), k)).otherwise("mailto:x"), F.lit('">WEBSITE</a></section>'))
    body = F.concat(F.lit('<h1 class="d1i-head__title">Order '), k, F.lit('</h1><div id="descriptionText"><div class="toujou-text-clamper__content">Wann? '), when, F.lit("."), hours, F.lit('</div></div><section id="d1iAddressesSection">'), place, other, F.lit("</section>"), site)
    pages = _spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select(F.lit("o").alias("source_id"), F.concat(F.lit("https://x/fair-"), k, F.lit("/")).alias("url"), body.alias("body"))
    local = lambda c: F.date_format(F.from_utc_timestamp(c, "Europe/Berlin"), "yyyy-MM-dd HH:mm")
    found = detail.parse(pages, pages)
    return found.select(F.regexp_extract("url", r"(\d+)/$", 1).cast("long").alias("o_orderkey"), "title", local("start").alias("starts"), local("end").alias("ends"), "all_day", "location", "organizer", "event_url")


@query("""select o_custkey, row_number() over (partition by o_custkey order by o_orderkey % 2, o_orderkey) as place, 'https://x/d?a=' || o_orderkey || '&b=<' || o_orderkey % 3 || '>' as url from orders where o_custkey % 10 <> 0""")
def sitemap_roundtrip(spark, sf_dir):
    """A sitemap for each customer, with prefixes, comments, CDATA and images; its orders of even keys as an index's maps. Every tenth isn't XML."""
    k = F.col("o_orderkey")
    plain = F.concat(F.lit("https://x/d?a="), k, F.lit("&b=<"), k % 3, F.lit(">"))
    told = F.when(k % 3 == 0, F.concat(F.lit("<![CDATA["), plain, F.lit("]]>"))).otherwise(F.concat(F.lit("\n "), F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("<!-- x --> ")))
    tag = F.when(k % 2 == 0, "s:sitemap").otherwise("s:url")
    entry = F.concat(F.lit("<"), tag, F.lit("><s:loc>"), told, F.lit("</s:loc><i:image><i:loc>https://img/x</i:loc></i:image></"), tag, F.lit("><!-- <s:url><s:loc>https://no/</s:loc></s:url> -->"))
    top = F.when(F.col("o_custkey") % 10 == 0, "<broken>").otherwise("")
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("t")))), lambda x: x["t"]), "").alias("rows"))
    body = F.concat(F.lit('<?xml version="1.0"?><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="urn:image">'), top, "rows", F.lit("<s:url/></s:urlset>"))
    read = pages.select("o_custkey", sitemaps.read(body).alias("r")).filter("r.valid")
    return read.select("o_custkey", F.posexplode("r.locations").alias("place", "url")).select("o_custkey", (F.col("place") + 1).cast("long").alias("place"), "url")


@query()
def html_visible_text(spark, sf_dir):
    """What a reader sees of each page; Python's parser has no equal in SQL."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), "url", F.col("html").alias("body"))
    return model.visible_text(pages, 6000).select(F.col("source_id").cast("long").alias("page_id"), "page_text")
