"""Observations against stored state: identity, change sequences, absence, revival; one version of the state per run.

Identity is an ordered fold (an alias set by one observation is seen by the next). Observations that can't meet, directly or through
others, don't see each other's, so the fold is a grouped function over connected components of observations, aliases and stored
events; everything else is joins and windows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from . import components

CONTENT = ["title", "start", "end", "all_day", "location", "description", "organizer", "status", "extraction_method", "extraction_confidence"]
EVENTS = "event_id string, source_id string, title string, start timestamp, end timestamp, all_day boolean, location string, description string, organizer string, status string, extraction_method string, extraction_confidence double, source_url string, event_url string, cancelled_reason string, sequence long, semantic_hash string, missing_count long, first_missing timestamp, dtstamp timestamp, last_modified timestamp, created_at timestamp, updated_at timestamp"
ALIASES = "alias_type string, alias_value string, source_id string, event_id string, created_at timestamp"
STRONG = ["ics_uid", "x_id"]
#: Aliases of a batch that are folded together, on average; a larger component is one group by itself.
ALIASES_A_GROUP = 10_000


def semantic_hash() -> Column:
    trimmed = lambda c: text.squeeze(F.col(c))
    return text.joined_hash(F.col("title"), dates.iso_berlin(F.col("start")), dates.iso_berlin(F.col("end")), text.python_bool(F.col("all_day")), trimmed("location"), trimmed("description"), trimmed("organizer"), F.col("status"))


def valid() -> Column:
    return F.col("error").isNull() & (F.trim("title") != "") & F.col("extraction_confidence").between(0, 1) & (F.col("end").isNull() | (F.col("end") >= F.col("start")))


def assign(observations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(source_id, obs_ord, event_id, is_new): the event of each observation.

    The first known alias decides, strongest first; a fingerprint only where the event has no other strong alias. An event
    that this batch has seen under strong aliases of the same type but without one in common is left out. New ids are
    digests of source, order-free aliases and place, so that a repeated task gives the same ones.
    """
    keyed = observations.select("source_id", "obs_ord", "source_event_uid", "source_x_id", "source_url", text.weak_fingerprint(F.col("title"), F.date_format(dates.berlin_day(F.col("start")), "yyyy-MM-dd")).alias("fingerprint"), "run_id")
    candidates = candidate_aliases(observations.withColumn("event_id", F.lit(None).cast("string"))).select("source_id", "obs_ord", "alias_type", "alias_value").checkpoint()
    held = touched(aliases, candidates).checkpoint()
    labels = components.components(_direct(_bonds(candidates, held)))
    # components share a group where they are small: the fold keeps them apart, and a group costs more than a row
    groups = max(int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // ALIASES_A_GROUP))
    number = F.pmod(F.coalesce("component", "node"), F.lit(groups)).alias("component")
    seen = keyed.withColumn("node", _node("o", "obs_ord")).join(labels, "node", "left").select(*keyed.columns, number)
    known = held.withColumn("node", _node("e", "event_id")).join(labels, "node", "left").select(*held.columns, number)
    return seen.groupBy("source_id", "component").cogroup(known.groupBy("source_id", "component")).applyInPandas(lambda obs, held: fold(obs, held), "source_id string, obs_ord long, event_id string, is_new boolean")


def _node(kind: str, *columns: str) -> Column:
    """A number for an observation, event or alias of a source; two that are equal by chance only put more into one group."""
    return F.xxhash64(F.lit(kind), "source_id", *columns)


def _bonds(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): what must be folded together, as observations that have an alias in common, or aliases of one stored event.

    An address or a fingerprint binds nothing where it can never decide: all observations that have it carry a strong alias of
    one type, and no stored event has it (or, of fingerprints, one that owns an alias of that type). Two of them that have
    no strong alias in common then bar each other, and two that have one are bound by it.
    """
    strong = candidates.groupBy("source_id", "obs_ord").agg(*[F.bool_or(F.col("alias_type") == t).alias(f"has_{t}") for t in STRONG])
    owns = held.groupBy("source_id", "event_id").agg(*[F.bool_or(F.col("alias_type") == t).alias(f"owns_{t}") for t in STRONG])
    weak = F.col("alias_type").isin("source_url", "fingerprint")
    shared = candidates.filter(weak).join(strong, ["source_id", "obs_ord"]).groupBy("source_id", "alias_type", "alias_value").agg(*[F.bool_and(f"has_{t}").alias(f"all_{t}") for t in STRONG])
    stored = held.filter(weak).join(owns, ["source_id", "event_id"]).select("source_id", "alias_type", "alias_value", F.lit(True).alias("stored"), *[f"owns_{t}" for t in STRONG])
    decides = shared.join(stored, ["source_id", "alias_type", "alias_value"], "left")
    idle = F.lit(False)
    for t in STRONG:
        idle = idle | (F.col(f"all_{t}") & (F.col("stored").isNull() | ((F.col("alias_type") == "fingerprint") & F.col(f"owns_{t}"))))
    binding = decides.filter(~idle).select("source_id", "alias_type", "alias_value")
    bound = candidates.filter(~weak).unionByName(candidates.join(binding, ["source_id", "alias_type", "alias_value"], "left_semi").select(*candidates.columns))
    alias = _node("a", "alias_type", "alias_value").alias("b")
    return bound.select(_node("o", "obs_ord").alias("a"), alias).unionByName(held.select(_node("e", "event_id").alias("a"), alias))


def _direct(bonds: DataFrame) -> DataFrame:
    """(a, b): bonds between observations and stored events only, those of an alias each with the smallest of them.

    With the alias as a node of its own, paths would be twice as long, and one that nothing shares would go through all rounds.
    """
    owners = bonds.checkpoint()
    least = owners.groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("most")).filter("least < most").drop("most")
    return owners.join(least, "b").filter("a <> least").select("a", F.col("least").alias("b"))


def fold(obs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Gives each observation its event, in order; held are the stored aliases that they can meet."""

    def barred(seen: set | None, strong: set, types: set) -> bool:
        return bool(seen) and not seen & strong and any(t in types for t, _ in seen)

    known = {(t, v): e for t, v, e in zip(held.alias_type, held.alias_value, held.event_id, strict=True)}
    owned: dict[str, dict[str, set]] = {}
    for (t, v), e in known.items():
        owned.setdefault(e, {}).setdefault(t, set()).add(v)
    met: dict[str, set] = {}
    rows = []
    for o in obs.sort_values("obs_ord").itertuples():
        strong = [(t, v) for t, v in (("ics_uid", o.source_event_uid), ("x_id", o.source_x_id)) if v]
        tried = strong + ([("source_url", o.source_url)] if o.source_url else [])
        weak = ("fingerprint", o.fingerprint)
        types = {t for t, _ in strong}
        hit = next((e for a in tried if (e := known.get(a)) and not barred(met.get(e), set(strong), types)), None)
        if hit is None and (e := known.get(weak)) and not barred(met.get(e), set(strong), types):
            if not any(vs and v not in vs for t, v in strong if (vs := owned.get(e, {}).get(t))):
                hit = e
        new = hit is None
        hit = hit or hashlib.sha256(f"{o.source_id}\x1f{o.run_id}\x1f{o.obs_ord}".encode()).hexdigest()[:32]
        for t, v in [*tried, weak]:
            known[t, v] = hit
            owned.setdefault(hit, {}).setdefault(t, set()).add(v)
        met.setdefault(hit, set()).update(strong)
        rows.append((o.source_id, o.obs_ord, hit, new))
    return pd.DataFrame(rows, columns=["source_id", "obs_ord", "event_id", "is_new"])


def touched(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """All aliases of those events at which an alias in wanted points: the history that a batch can meet."""
    events = aliases.join(wanted, ["source_id", "alias_type", "alias_value"], "left_semi").select("source_id", "event_id").distinct()
    return aliases.join(events, ["source_id", "event_id"], "left_semi")


def candidate_aliases(assigned: DataFrame) -> DataFrame:
    """A row for each alias of each observation."""
    alias = lambda kind, value: F.struct(F.lit(kind).alias("alias_type"), value.alias("alias_value"))
    day = F.date_format(dates.berlin_day(F.col("start")), "yyyy-MM-dd")
    all_ = F.array(alias("ics_uid", F.col("source_event_uid")), alias("x_id", F.col("source_x_id")), alias("source_url", F.col("source_url")), alias("fingerprint", text.weak_fingerprint(F.col("title"), day)))
    return assigned.select("source_id", "event_id", "obs_ord", F.explode(F.filter(all_, lambda a: F.coalesce(a["alias_value"], F.lit("")) != "")).alias("a")).select("source_id", "event_id", "obs_ord", "a.*")


def upsert_aliases(old: DataFrame, assigned: DataFrame, run_ts: Column) -> DataFrame:
    """The last observation of an alias decides where it points; when it was first seen stays."""
    new = candidate_aliases(assigned).withColumn("created_at", run_ts)
    both = old.withColumn("obs_ord", F.lit(-1).cast("long")).unionByName(new)
    return both.groupBy("alias_type", "alias_value", "source_id").agg(F.max_by("event_id", "obs_ord").alias("event_id"), F.min("created_at").alias("created_at"))


def effects(events: DataFrame, assigned: DataFrame, coverage: DataFrame, run_ts: Column, threshold: int, grace_days: float) -> DataFrame:
    """The next version of events.

    An event's observations follow its stored row; each that differs in content or public address (or the first, where it
    revives an event cancelled by absence) counts once. Content comes from the last that counted, addresses from the last
    of all. Events of completely covered sources that weren't observed count a miss and are cancelled after enough of them.
    """
    c = F.col
    stored = events.select("event_id", F.lit(-1).cast("long").alias("obs_ord"), F.lit(True).alias("old"), "semantic_hash", "source_url", "event_url", *CONTENT, "cancelled_reason")
    seen = assigned.select("event_id", "obs_ord", F.lit(False).alias("old"), semantic_hash().alias("semantic_hash"), "source_url", "event_url", *CONTENT, F.lit(None).cast("string").alias("cancelled_reason"))
    touched = seen.select("event_id").distinct()
    rows = stored.join(touched, "event_id", "left_semi").unionByName(seen)
    w = Window.partitionBy("event_id").orderBy("obs_ord")
    before = lambda x: F.lag(x).over(w)
    absent_before = before(c("old")) & (before(c("status")) == "CANCELLED") & (before(c("cancelled_reason")) == "absence")
    revives = F.coalesce(absent_before & (c("status") != "CANCELLED"), F.lit(False))
    differs = (c("semantic_hash") != before(c("semantic_hash"))) | ~c("event_url").eqNullSafe(before(c("event_url")))
    marked = rows.withColumn("revives", revives).withColumn("n", F.row_number().over(w)).withColumn("changed", F.when(c("old") | (c("n") == 1), False).otherwise(differs | c("revives")))
    base = c("old") | c("changed") | (c("n") == 1)
    settled = marked.groupBy("event_id").agg(
        F.max_by(F.struct(*CONTENT, "semantic_hash"), F.when(base, c("obs_ord"))).alias("content"), F.max_by(F.struct("source_url", "event_url"), "obs_ord").alias("place"),
        F.sum(c("changed").cast("long")).alias("changes"), F.bool_or("revives").alias("revived"), F.bool_or(~c("old") & (c("changed") | (c("n") == 1)) & (c("status") == "CANCELLED")).alias("source_cancels"),
    )
    source = assigned.groupBy("event_id").agg(F.first("source_id").alias("seen_source"))
    joined = events.alias("e").join(settled.join(source, "event_id"), "event_id", "full_outer").withColumn("source_id", F.coalesce("source_id", "seen_source")).join(coverage, "source_id", "left")
    hit, new = c("content").isNotNull(), c("created_at").isNull()
    misses = ~hit & (c("coverage") == "COMPLETE") & (c("e.status") != "CANCELLED")
    misses = F.coalesce(misses, F.lit(False))
    count = c("missing_count") + 1
    since = F.coalesce("first_missing", run_ts)
    cancels = misses & (count >= threshold) & (dates.elapsed_days(since, run_ts) >= grace_days)
    moved = hit & (new | (c("changes") > 0))
    pick = lambda name: F.when(hit, c(f"content.{name}")).otherwise(c(f"e.{name}")).alias(name)
    return joined.select(
        "event_id", "source_id", *[pick(x) for x in CONTENT if x not in ("status",)], F.when(cancels, "CANCELLED").otherwise(F.when(hit, c("content.status")).otherwise(c("e.status"))).alias("status"),
        F.when(hit, c("place.source_url")).otherwise(c("e.source_url")).alias("source_url"), F.when(hit, c("place.event_url")).otherwise(c("e.event_url")).alias("event_url"),
        F.when(cancels, "absence").when(hit & c("source_cancels"), "source").when(hit & c("revived"), None).otherwise(c("cancelled_reason")).alias("cancelled_reason"),
        (F.coalesce("sequence", F.lit(0)) + F.coalesce("changes", F.lit(0)) + cancels.cast("long")).alias("sequence"), pick("semantic_hash"),
        F.when(hit, 0).when(misses, count).otherwise(c("missing_count")).cast("long").alias("missing_count"), F.when(hit, None).when(misses, since).otherwise(c("first_missing")).alias("first_missing"),
        F.when(hit | cancels, run_ts).otherwise(c("dtstamp")).alias("dtstamp"), F.when(moved | cancels, run_ts).otherwise(c("last_modified")).alias("last_modified"), F.coalesce("created_at", run_ts).alias("created_at"),
        F.when(hit | misses, run_ts).otherwise(c("updated_at")).alias("updated_at"),
    )


def run_counts(before: DataFrame, after: DataFrame, run_ts: Column) -> DataFrame:
    """(source_id, created, updated, cancelled, observed) of a run, from its events before and after.

    Cancelled are those cancelled for absence, which are neither observed nor updated."""
    known = before.select("event_id", F.col("sequence").alias("_sequence"), F.col("status").alias("_status"))
    c = F.col
    seen = (c("updated_at") == run_ts) & (c("missing_count") == 0)
    absent = (c("status") == "CANCELLED") & (c("_status") != "CANCELLED") & ~seen
    rows = after.join(known, "event_id", "left")
    return rows.groupBy("source_id").agg(F.count_if(c("_sequence").isNull()).alias("created"), F.count_if(seen & (c("sequence") > c("_sequence"))).alias("updated"), F.count_if(absent).alias("cancelled"), F.count_if(seen).alias("observed"))
