"""A run: sources to candidates to observations to the next version of the state.

The session's time zone must be UTC and spark.checkpoint.dir set (tests set their own): what a step hands to several later
ones is stored there once.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import coverage, reconcile
from ..sources import detail, fetch, ics, jsonld, model, profiles, sitemaps
from ..sources.config import Config
from .state import State

# Texts by which a page says that it has no events, by kind of source.
EMPTY = {
    "listing": ["keine veranstaltungen", "keine ergebnisse", "keine treffer", "keine einträge"],
    "structured-html": ["keine veranstaltungen", "keine termine", "keine einträge"],
}
#: The profile whose lists go on over further pages.
PAGED = "dated-list"
DETAIL, SITEMAP_PARAMETER, ITEM = "/veranstaltungen/veranstaltung/", ("sitemap", "destinationdataevent"), "d1i-item-page/"
BANNED_QUERY = ["id=", "tx_solr"]
MOST_SITEMAPS = 3


@dataclass
class Result:
    version: int
    runs: list


def _says_empty(kind: Column, body: Column) -> Column:
    low = text.casefold(body)
    said = F.lit(False)
    for name, markers in EMPTY.items():
        said = said | ((kind == name) & F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m)))
    return F.coalesce(said, F.lit(False))


def further_pages(url: Column, links: Column) -> Column:
    """Addresses of the pages from 2 that links name by a parameter."""
    numbers = F.transform(links, lambda u: F.regexp_extract(u, r"[?&]page=(\d{1,9})(?:&|#|$)", 1).try_cast("int"))
    return F.transform(F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n >= 2))), lambda n: F.concat(url, F.lit("?page="), n.cast("string")))


def calendar_link(page: Column, body: Column) -> Column:
    """The first iCalendar file that a page links to."""
    links = F.transform(urls.hrefs(body), lambda h: profiles.absolute(page, h))
    return F.get(F.filter(links, lambda u: F.lower(u).endswith(".ical")), F.lit(0))


def discover(sources: DataFrame, get) -> tuple[DataFrame, DataFrame]:
    """(outcomes of seeds, candidates: source_id, kind, profile, hosts, url, ord)."""
    plain = F.lit(None).cast("string").alias("etag")
    seeds = sources.select("source_id", "kind", "profile", "hosts", F.posexplode("seeds").alias("seed", "url"), plain)
    got = get(seeds)
    ok = F.col("error").isNull() & ~F.col("not_modified")
    low = F.col("kind")
    links = F.transform(urls.hrefs(F.col("body")), lambda h: profiles.absolute(F.col("at"), h))
    found = F.when(low == "listing", F.filter(links, lambda u: urls.is_candidate(u, DETAIL))).when(low == "structured-html", F.concat(F.array("url"), F.when(F.col("profile") == PAGED, further_pages(F.col("url"), links)).otherwise(F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    structured = got.filter(ok & (low == "structured-html")).select("source_id", F.col("url"), "profile", "body")
    marked = profiles.recognised(structured, lambda pages: pages).withColumn("marked", F.lit(True))
    changed = ok & (low == "structured-html") & F.col("marked").isNull() & ~_says_empty(low, F.col("body"))
    got = got.join(marked, ["source_id", "url"], "left").withColumn("error", F.when(changed, F.lit("no event markup")).otherwise(F.col("error")))
    got = _with_locations(got, ok & (low == "sitemap"))
    first = got.withColumn("found", F.when(ok, found).otherwise(F.array().cast("array<string>")))
    maps = F.slice(F.filter("locations", lambda u: urls.has_parameter(u, *SITEMAP_PARAMETER)), 1, MOST_SITEMAPS)
    children = got.filter(ok & (low == "sitemap")).select("source_id", "kind", "profile", "hosts", "seed", F.posexplode(maps).alias("child", "url"), plain).checkpoint()
    below = _with_locations(got.limit(0).drop("locations").withColumn("child", F.lit(0)) if children.isEmpty() else get(children), ok).withColumn("found", F.when(ok, F.filter("locations", lambda u: urls.is_safe_detail(u, ITEM, "/typo3/", BANNED_QUERY))).otherwise(F.array().cast("array<string>")))
    part = lambda d, child: d.select("source_id", "kind", "profile", "hosts", "seed", child.alias("child"), ok.alias("ok"), "not_modified", "found", (ok & _says_empty(low, F.col("body")) & ((low != "listing") | (F.size("found") == 0))).alias("explicit_empty"), "error")
    everything = part(first, F.lit(-1)).unionByName(part(below, F.col("child")))
    outcomes = everything.select("source_id", F.coalesce("ok", F.lit(False)).alias("ok"), "not_modified", F.col("found").alias("urls"), "explicit_empty", "error")
    each = everything.select("source_id", "kind", "profile", "hosts", "seed", "child", F.posexplode("found").alias("i", "url"))
    once = each.groupBy("source_id", "url").agg(F.min_by(F.struct("kind", "profile", "hosts"), F.struct("seed", "child", "i")).alias("s"), F.min(F.struct("seed", "child", "i")).alias("place"))
    order = Window.partitionBy("source_id").orderBy("place")
    return outcomes, once.select("source_id", "url", "s.*", F.row_number().over(order).alias("ord"))


def _with_locations(got: DataFrame, maps: Column) -> DataFrame:
    """got with the locations of those pages that are sitemaps; one that isn't XML is an error."""
    read = got.withColumn("read", F.when(maps, sitemaps.read(F.col("body"))))
    return read.withColumn("error", F.when(~F.col("read.valid"), F.lit("not a sitemap")).otherwise(F.col("error"))).withColumn("locations", F.coalesce("read.locations", F.array().cast("array<string>"))).drop("read")


def parse(pages: DataFrame, profiles_used: list[str]) -> DataFrame:
    """pages: source_id, url, body, kind, profile, and what profiles take from the configuration. Pages of sitemaps without event data are read as detail pages."""
    calendars = _is_calendar()
    given = [c for c in ("default_location", "default_organizer", "skip_titles") if c in pages.columns]
    body = lambda d: d.select("source_id", "url", "body", *given)
    data = jsonld.parse(body(pages.filter(~calendars & (F.col("kind") != "structured-html")))).checkpoint()
    rest = body(pages.filter(~calendars & (F.col("kind") == "sitemap")).join(data, ["source_id", "url"], "left_anti"))
    parts = [ics.parse(body(pages.filter(calendars))), data, detail.parse(rest, rest)]
    for name in profiles_used:
        mine = body(pages.filter((F.col("kind") == "structured-html") & (F.col("profile") == name)))
        parts.append(profiles.parse(mine, mine, name))
    return reduce(DataFrame.unionByName, parts)


def replay(unchanged: DataFrame, state: State) -> DataFrame:
    """Stored events of addresses that haven't changed, as observations."""
    alias = state.read("aliases").filter(F.col("alias_type").isin("ics_uid", "x_id")).groupBy("event_id").pivot("alias_type", ["ics_uid", "x_id"]).agg(F.min("alias_value"))
    e = state.read("events").join(unchanged.select("source_id", F.col("url").alias("source_url")), ["source_id", "source_url"]).join(alias, "event_id", "left")
    number = F.row_number().over(Window.partitionBy("source_id", "source_url").orderBy("created_at", "event_id")) - 1
    return e.select("source_id", F.col("source_url").alias("url"), number.cast("int").alias("row"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("unchanged:"), "semantic_hash").alias("raw_content_hash"), "title", "start", "end", "all_day", "location", "description", "organizer", "status", "event_url", F.col("ics_uid").alias("source_event_uid"), F.col("x_id").alias("source_x_id"), F.lit(None).cast("int").alias("source_sequence"), F.lit(None).cast("timestamp").alias("source_last_modified"), "extraction_method", "extraction_confidence")


def linked(pages: DataFrame, get) -> DataFrame:
    """pages, those of listings that link to an iCalendar file with its body in place of their own; gone where it can't be fetched."""
    known = pages.withColumn("link", F.when((F.col("kind") == "listing") & ~_is_calendar(), calendar_link(F.col("at"), F.col("body")))).checkpoint()
    if known.filter("link is not null").isEmpty():
        return known.drop("link")
    files = get(known.filter("link is not null").select("source_id", F.col("url").alias("page"), F.col("link").alias("url"), "hosts")).filter("error is null")
    bodies = files.select("source_id", F.col("page").alias("url"), F.col("body").alias("calendar"))
    met = known.join(bodies, ["source_id", "url"], "left").filter("link is null or calendar is not null")
    return met.withColumn("body", F.coalesce("calendar", "body")).drop("calendar", "link")


def _is_calendar() -> Column:
    return F.lower("url").endswith(".ical") | F.col("body").startswith("BEGIN:VCALENDAR")


def run(spark: SparkSession, config: Config, provider: fetch.Provider, state: State, run_ts: datetime, ids: list[str] | None = None, backend: model.Backend | None = None) -> Result:
    """Fetches all enabled sources (or those named), reconciles what they give, and commits the next version.

    backend: a language model for pages of listings and sitemaps from which nothing else gives an event."""
    sources = config.table(spark, ids)
    now, run_id = F.lit(run_ts).cast("timestamp"), run_ts.strftime("%Y%m%dT%H%M%S")
    rules = fetch.Robots(provider, config.user_agent)
    get = lambda requests: fetch.get(requests, provider, rules, config.max_bytes)

    outcomes, candidates = discover(sources, get)
    outcomes, candidates = outcomes.checkpoint(), candidates.checkpoint()
    dropped = candidates.filter(F.col("ord") > config.max_events)
    cache = state.read("resource_cache").select("url", "etag", "last_modified")
    fetched = get(candidates.filter(F.col("ord") <= config.max_events).join(cache, "url", "left"))
    good = fetched.filter("error is null and not not_modified")
    used = [p for p in profiles.PROFILES if any(s[2] == p for s in config.sources)]
    read = linked(good, get).join(sources.select("source_id", "default_location", "default_organizer", "skip_titles"), "source_id")
    fresh = parse(read, used).checkpoint()
    answers = state.read("model_cache")
    if backend is not None:
        rest = read.filter((F.col("kind") != "structured-html") & ~_is_calendar()).join(fresh, ["source_id", "url"], "left_anti").select("source_id", "url", "body")
        told, new_answers = model.extract(rest, answers, backend, config.model or "", config.max_input_chars)
        fresh, answers = fresh.unionByName(told), answers.unionByName(new_answers.withColumn("created_at", now), allowMissingColumns=True)
    old = fetched.filter("not_modified")
    rows = fresh.unionByName(replay(old, state)).withColumn("valid", F.coalesce(reconcile.valid(), F.lit(False))).checkpoint()

    per_page = rows.groupBy("source_id", "url").agg(F.bool_and("valid").alias("all_valid"))
    usable = rows.join(per_page.filter("all_valid"), ["source_id", "url"]).join(fetched.select("source_id", "url", "ord"), ["source_id", "url"])
    numbered = usable.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("ord", "row")))
    kept = numbered.filter(F.col("n") <= config.max_events)
    observations = kept.select(F.lit(run_id).alias("run_id"), F.col("n").cast("long").alias("obs_ord"), F.col("url").alias("source_url"), *[c for c in kept.columns if c not in ("n", "ord", "url", "valid", "all_valid")]).withColumn("event_url", F.coalesce(F.nullif("event_url", F.lit("")), F.col("source_url"))).checkpoint()

    empty = fetched.join(per_page, ["source_id", "url"], "left").filter("error is not null or all_valid is null or not all_valid")
    fail = lambda d, why: d.select("source_id", F.concat(F.lit(why), F.coalesce(text.endpoint(F.col("url")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.col("error"), F.lit(")")), F.lit("")) if "error" in d.columns else F.lit("")).alias("note"))
    failures = fail(empty, "no events from ").unionByName(fail(dropped, "over the limit ")).unionByName(fail(numbered.filter(F.col("n") > config.max_events), "over the limit ")).checkpoint()
    seen = coverage.downgrade(coverage.discovery(outcomes, sources), failures).checkpoint()

    aliases, events = state.read("aliases"), state.read("events")
    assigned = observations.join(reconcile.assign(observations, aliases), ["source_id", "obs_ord"]).checkpoint()
    after = reconcile.effects(events, assigned, seen, now, config.missing_threshold, config.missing_grace_days).checkpoint()
    done = reconcile.run_counts(events, after, now).select("source_id", "created", "updated", "cancelled")
    etag = F.element_at("headers", "etag")
    new_cache = good.groupBy("url").agg(F.max(etag).alias("etag"), F.max(F.element_at("headers", "last-modified")).alias("last_modified"), F.max(F.sha2("body", 256)).alias("content_hash")).withColumn("fetched_at", now)
    kept_cache = state.read("resource_cache").join(new_cache, "url", "left_anti")
    counts = assigned.groupBy("source_id").agg(F.count("*").alias("events_seen"))
    notes = failures.groupBy("source_id").agg(text.bounded(F.array_sort(F.collect_list("note"))).alias("notes"))  # bounded by the cap on candidates
    log = seen.join(counts, "source_id", "left").join(notes, "source_id", "left").join(done, "source_id", "left").select(F.lit(run_id).alias("run_id"), "source_id", now.alias("started_at"), now.alias("finished_at"), "coverage", F.coalesce("events_seen", F.lit(0)).alias("events_seen"), F.coalesce("notes", F.lit("")).alias("notes"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("created", "updated", "cancelled")]).checkpoint()
    version = state.commit({"events": after, "aliases": reconcile.upsert_aliases(aliases, assigned, now), "resource_cache": kept_cache.unionByName(new_cache), "model_cache": answers, "runs": state.read("runs").unionByName(log)})
    return Result(version, log.orderBy("source_id").collect())
