"""Queries that give the driver's rows, as observations, events, aliases and pages, to the operators that a run uses."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import reconcile, scan
from ..sources import fetch, jsonld, model
from . import export
from .scalar_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


STARTS, RUN = "timestamp '2026-01-01 12:00:00'", "timestamp '2026-03-01 00:00:00'"


def _observed(rows: DataFrame, source: str, place: str, **said: str) -> DataFrame:
    """Observations whose columns are expressions over rows; those not given are null."""
    told = dict.fromkeys(["event_id", "source_event_uid", "source_x_id", "source_url"], "cast(null as string)") | {"title": "''", "start": STARTS} | said
    return rows.selectExpr(f"cast({source} as string) as source_id", f"cast({place} as bigint) as obs_ord", "'r' as run_id", *[f"{v} as {k}" for k, v in told.items()])


def _held(rows: DataFrame, kind: str, value: str, source: str, event: str, where: str) -> DataFrame:
    return rows.filter(where).selectExpr(f"'{kind}' as alias_type", f"{value} as alias_value", f"cast({source} as string) as source_id", f"{event} as event_id", f"{STARTS} as created_at")


def _fingerprint_sql(title: str) -> str:
    return f"sha256(trim(regexp_replace(regexp_replace(lower(trim({title})), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) || '|2026-01-01')"


@query(f"""select c_custkey, 'ics_uid' as kind, c_name as value from customer where c_custkey % 3 = 0 union all select c_custkey, 'x_id', c_mktsegment from customer where c_custkey % 2 = 0
union all select c_custkey, 'source_url', 'https://x/' || c_custkey from customer where c_custkey % 5 > 0 union all select c_custkey, 'fingerprint', {_fingerprint_sql("c_name")} from customer""")
def alias_explode(spark, sf_dir):
    """Every alias of each observation; null and empty ones are none."""
    seen = _observed(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", event_id="cast(c_custkey as string)", source_event_uid="if(c_custkey % 3 = 0, c_name, null)", source_x_id="if(c_custkey % 2 = 0, c_mktsegment, '')", source_url="if(c_custkey % 5 > 0, concat('https://x/', c_custkey), null)", title="c_name")
    return reconcile.candidate_aliases(seen).select(F.col("obs_ord").alias("c_custkey"), F.col("alias_type").alias("kind"), F.col("alias_value").alias("value"))


def _weak(name: str) -> Column:
    return text.weak_fingerprint(F.col(name), F.lit("2026-01-01"))


@query("""with c as (select c_custkey as k, c_nationkey as n from customer),
p as (select k, n, case when k % 3 = 0 and k % 5 <> 0 then 'eu' || k when k % 2 = 0 and k % 4 <> 0 then 'ex' || k when k % 7 = 0 and k % 2 = 1 then 'es' || k when k % 11 <> 0 and k % 9 <> 0 then 'ef' || k end as e from c)
select k as c_custkey, coalesce(e, left(sha256(n || chr(31) || 'r' || chr(31) || k), 32)) as event_id, e is null as is_new from p""")
def alias_precedence(spark, sf_dir):
    """The event of the strongest alias that is known; a fingerprint counts only where the event has no other calendar id."""
    c = table(spark, sf_dir, "customer")
    rest = [("ics_uid", "concat('u', c_custkey)", "eu", "c_custkey % 5 <> 0"), ("x_id", "concat('x', c_custkey)", "ex", "c_custkey % 4 <> 0"), ("source_url", "concat('s', c_custkey)", "es", "c_custkey % 2 = 1"), ("ics_uid", "concat('other', c_custkey)", "ef", "c_custkey % 9 = 0"), ("fingerprint", "weak", "ef", "c_custkey % 11 <> 0")]
    held = None
    for kind, value, event, where in rest:
        part = _held(c.withColumn("weak", _weak("c_name")), kind, value, "c_nationkey", f"concat('{event}', c_custkey)", where)
        held = part if held is None else held.unionByName(part)
    seen = _observed(c, "c_nationkey", "c_custkey", source_event_uid="if(c_custkey % 3 = 0, concat('u', c_custkey), null)", source_x_id="if(c_custkey % 2 = 0, concat('x', c_custkey), null)", source_url="if(c_custkey % 7 = 0, concat('s', c_custkey), null)", title="c_name")
    return reconcile.assign(seen, held).select(F.col("obs_ord").alias("c_custkey"), "event_id", "is_new")


@query("select c_custkey from customer where c_custkey % 2 = 0 and c_custkey % 3 = 1")
def alias_conflicts(spark, sf_dir):
    """Rows whose fingerprint points at an event that another calendar id holds: they become events of their own."""
    c = table(spark, sf_dir, "customer").withColumn("weak", _weak("c_name"))
    event = "concat('e', c_custkey)"
    held = _held(c, "fingerprint", "weak", "c_nationkey", event, "true").unionByName(_held(c, "ics_uid", "concat(if(c_custkey % 3 = 0, 'u', 'other'), c_custkey)", "c_nationkey", event, "c_custkey % 3 < 2"))
    seen = _observed(c, "c_nationkey", "c_custkey", source_event_uid="if(c_custkey % 2 = 0, concat('u', c_custkey), null)", title="c_name")
    return reconcile.assign(seen, held).filter("is_new").select(F.col("obs_ord").alias("c_custkey"))


@query("""with f as (select o_orderkey, o_custkey, min(o_orderkey) over (partition by o_custkey) as head from orders)
select o_orderkey, left(sha256('o' || chr(31) || 'r' || chr(31) || head), 32) as event_id, o_orderkey = head as is_new from f""")
def identity_fold(spark, sf_dir):
    """Orders as observations of one source whose calendar id is the customer, folded into events; days and titles repeat across customers."""
    seen = _observed(table(spark, sf_dir, "orders"), "'o'", "o_orderkey", source_event_uid="cast(o_custkey as string)", title="o_orderstatus", start="cast(o_orderdate as timestamp)")
    folded = reconcile.assign(seen, spark.createDataFrame([], reconcile.ALIASES))
    return folded.select(F.col("obs_ord").alias("o_orderkey"), "event_id", "is_new")


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """A key with its place k, from 0: counted within ranges of keys, and over the ranges' totals."""
    ranges = scan.blocks(rows.select(key, F.lit(0).alias("all")), "all", [key])
    return scan.running(ranges, "all", [key], k=("sum", F.lit(1).cast("long"))).select(key, (F.col("k") - 1).alias("k"))


@query("""with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as k from orders), f as (select o_orderkey, min(o_orderkey) over (partition by k // 40) as head, k // 40 as chain from n)
select o_orderkey, case when chain % 3 = 0 then 'held' || chain else left(sha256('o' || chr(31) || 'r' || chr(31) || head), 32) end as event_id, chain % 3 <> 0 and o_orderkey = head as is_new from f""")
def identity_chains(spark, sf_dir):
    """Orders in chains of forty, in which each has an alias in common with the next few only; every third chain's end leads to a stored event."""
    rows = _numbered(table(spark, sf_dir, "orders"), "o_orderkey")
    seen = _observed(rows, "'o'", "o_orderkey", source_event_uid="cast(k div 4 as string)", source_x_id="if(k % 40 in (0, 1, 38, 39), null, cast((k + 2) div 4 as string))", title="cast(o_orderkey as string)")
    held = _held(rows, "ics_uid", "cast(k div 4 as string)", "'o'", "concat('held', k div 40)", "k % 40 = 0 and k div 40 % 3 = 0")
    return reconcile.assign(seen, held).select(F.col("obs_ord").alias("o_orderkey"), "event_id", "is_new")


@query(f"""with o as (select 'ics_uid' as kind, o_custkey::varchar as value, o_orderkey from orders union all select 'fingerprint', {_fingerprint_sql("o_orderstatus")}, o_orderkey from orders),
new as (select kind, value, arg_max(o_orderkey, o_orderkey)::varchar as event_id from o group by all),
old as (select 'ics_uid' as kind, c_custkey::varchar as value, 'old' || c_custkey as event_id from customer where c_custkey % 2 = 0)
select coalesce(new.kind, old.kind) as kind, coalesce(new.value, old.value) as value, coalesce(new.event_id, old.event_id) as event_id, case when old.value is null then '2026-03-01' else '2026-01-01' end as since
from old full join new on old.kind = new.kind and old.value = new.value""")
def alias_upsert(spark, sf_dir):
    """Aliases after a run: the last observation decides where one points, the first sighting stays."""
    seen = _observed(table(spark, sf_dir, "orders"), "'o'", "o_orderkey", event_id="cast(o_orderkey as string)", source_event_uid="cast(o_custkey as string)", title="o_orderstatus")
    old = _held(table(spark, sf_dir, "customer"), "ics_uid", "cast(c_custkey as string)", "'o'", "concat('old', c_custkey)", "c_custkey % 2 = 0")
    after = reconcile.upsert_aliases(old, seen, F.expr(RUN))
    return after.select(F.col("alias_type").alias("kind"), F.col("alias_value").alias("value"), "event_id", F.date_format("created_at", "yyyy-MM-dd").alias("since"))


def _reconciled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers as stored events, some cancelled by absence before, and every third as observed in this run, every ninth twice."""
    c = table(spark, sf_dir, "customer")
    content = {"title": "c_name", "start": STARTS, "end": "cast(null as timestamp)", "all_day": "false", "location": "c_mktsegment", "description": "cast(null as string)", "organizer": "cast(null as string)", "status": "if(c_custkey % 13 = 0, 'CANCELLED', 'CONFIRMED')", "extraction_method": "'ics'", "extraction_confidence": "1.0d", "source_url": "'s'", "event_url": "'u'"}
    state = {"cancelled_reason": "if(c_custkey % 13 = 0, 'absence', null)", "sequence": "c_custkey % 4", "missing_count": "c_custkey % 3", "first_missing": f"case when c_custkey % 3 = 0 then null when c_custkey % 2 = 0 then {RUN} - interval 10 days else {RUN} - interval 1 day end", "dtstamp": STARTS, "last_modified": STARTS, "created_at": STARTS, "updated_at": STARTS}
    both = ["cast(c_custkey as string) as event_id", "cast(c_nationkey as string) as source_id"]
    old = c.filter("c_custkey % 10 <> 0").selectExpr(*both, *[f"{v} as {k}" for k, v in (content | state).items()]).withColumn("semantic_hash", reconcile.semantic_hash())
    times = c.filter("c_custkey % 3 = 0").withColumn("turn", F.explode(F.expr("if(c_custkey % 9 = 0, array(0, 1), array(0))")))
    said = content | {"location": "case when turn = 1 then 'second hall' when c_custkey % 2 = 0 then 'hall' else c_mktsegment end", "status": "'CONFIRMED'", "obs_ord": "c_custkey * 2 + turn"}
    seen = times.selectExpr(*both, *[f"{v} as {k}" for k, v in said.items()])
    covered = c.selectExpr("cast(c_nationkey as string) as source_id", "if(c_nationkey % 2 = 0, 'COMPLETE', 'PARTIAL') as coverage").distinct()
    return old, reconcile.effects(old, seen, covered, F.expr(RUN), 3, 7)


_EFFECTS_SQL = """c as (select c_custkey as k, c_nationkey as n, c_mktsegment as segment, c_custkey % 10 <> 0 as old, c_custkey % 3 = 0 as hit, c_custkey % 13 = 0 as gone from customer where c_custkey % 10 <> 0 or c_custkey % 3 = 0),
m as (select *, old and not hit and n % 2 = 0 and not gone as misses, case when not hit then 0 when old then (k % 2 = 0 or gone)::int + (k % 9 = 0)::int else (k % 9 = 0)::int end as changes from c),
s as (select *, misses and k % 3 = 2 and k % 2 = 0 as cancels from m)"""


@query(f"""with {_EFFECTS_SQL} select k as c_custkey, case when hit and k % 9 = 0 then 'second hall' when hit and k % 2 = 0 then 'hall' else segment end as location,
case when cancels then 'CANCELLED' when hit or not gone then 'CONFIRMED' else 'CANCELLED' end as status, case when cancels or gone and not hit then 'absence' end as cancelled_reason,
(case when old then k % 4 else 0 end + changes + cancels::int)::bigint as sequence, (case when hit then 0 when misses then k % 3 + 1 else k % 3 end)::bigint as missing_count, not old as created,
not old or changes > 0 or cancels as modified, hit or misses as touched from s""")
def state_upsert(spark, sf_dir):
    """The next version of stored events: changes, revivals, misses, cancellations."""
    _, after = _reconciled(spark, sf_dir)
    now = F.expr(RUN)
    return after.select(F.col("event_id").cast("long").alias("c_custkey"), "location", "status", "cancelled_reason", "sequence", "missing_count", (F.col("created_at") == now).alias("created"), (F.col("last_modified") == now).alias("modified"), (F.col("updated_at") == now).alias("touched"))


@query(f"with {_EFFECTS_SQL} select k as c_custkey from s where cancels")
def absent_entities(spark, sf_dir):
    """Events that this run cancels, as completely covered sources haven't shown them often and long enough."""
    old, after = _reconciled(spark, sf_dir)
    gone = after.filter("status = 'CANCELLED' and cancelled_reason = 'absence'").join(old.filter("status = 'CANCELLED'"), "event_id", "left_anti")
    return gone.select(F.col("event_id").cast("long").alias("c_custkey"))


@query(f"""with {_EFFECTS_SQL} select n::varchar as source_id, count(*) filter (not old) as created, count(*) filter (old and changes > 0) as updated, count(*) filter (cancels) as cancelled, count(*) filter (hit) as observed from s group by n""")
def run_log_counts(spark, sf_dir):
    """What a run did, by source."""
    old, after = _reconciled(spark, sf_dir)
    return reconcile.run_counts(old, after, F.expr(RUN))


_SUMMER = """(o_orderdate + interval 28 year + interval 10 hour >= march - to_days(dayofweek(march)::int) + interval 1 hour and o_orderdate + interval 28 year + interval 10 hour < october - to_days(dayofweek(october)::int) + interval 1 hour)"""


@query(f"""with o as (select *, make_date(year(o_orderdate) + 28, 3, 31)::timestamp as march, make_date(year(o_orderdate) + 28, 10, 31)::timestamp as october, o_orderkey % 4 = 0 as whole, repeat('a,b ' || o_orderkey || ' ', 9) as said from orders),
t as (select *, o_orderdate + interval 28 year + interval 10 hour + case when {_SUMMER} then interval 2 hour else interval 1 hour end as local, 'DESCRIPTION:' || replace(trim(said), ',', '\\,') as line from o)
select o_orderkey, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'SUMMARY:' || o_orderpriority || '\\, x\\;y\\nz', case when whole then 'DTSTART;VALUE=DATE:' || strftime(o_orderdate + interval 28 year, '%Y%m%d') else 'DTSTART;TZID=Europe/Berlin:' || strftime(local, '%Y%m%dT%H%M%S') end,
'DTSTAMP:20260301T000000Z', 'UID:' || o_orderkey || '@example.org', 'SEQUENCE:' || o_custkey % 3, 'STATUS:' || case o_orderstatus when 'F' then 'CANCELLED' else 'CONFIRMED' end, 'LAST-MODIFIED:20260101T120000Z',
case when length(line) <= 75 then line else left(line, 75) || regexp_replace(substr(line, 76), '(.{{1,74}})', chr(13) || chr(10) || ' \\1', 'g') end, case when o_custkey % 2 = 0 then 'URL:https://x/' || o_custkey end, 'END:VEVENT') as vevent from t""")
def vevent_text(spark, sf_dir):
    """Events of the feed, all-day ones and such in summer and winter time, with lines that need folding."""
    later = "cast(o_orderdate as timestamp) + interval 28 years"
    events = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as event_id", "concat(o_orderpriority, ', x;y\\nz') as title", f"{later} + if(o_orderkey % 4 = 0, interval 0 hours, interval 10 hours) as start", "cast(null as timestamp) as end", "o_orderkey % 4 = 0 as all_day", f"{RUN} as dtstamp", f"{STARTS} as last_modified",
        "o_custkey % 3 as sequence", "if(o_orderstatus = 'F', 'CANCELLED', 'CONFIRMED') as status", "'' as location", "trim(repeat(concat('a,b ', o_orderkey, ' '), 9)) as description", "cast(null as string) as organizer", "if(o_custkey % 2 = 0, concat('https://x/', o_custkey), null) as event_url",
    )
    return export.vevents(events, "example.org").select(F.col("event_id").cast("long").alias("o_orderkey"), "vevent")


@query("""select o_orderkey, case o_orderstatus when 'F' then 'CANCELLED' when 'P' then 'TENTATIVE' else 'CONFIRMED' end as status from orders""")
def status_domain(spark, sf_dir):
    said = F.concat(F.lit("https://schema.org/Event"), F.when(F.col("o_orderstatus") == "F", "Cancelled").when(F.col("o_orderstatus") == "P", "Tentative").otherwise("Scheduled"))
    return table(spark, sf_dir, "orders").select("o_orderkey", jsonld.status(said).alias("status"))


def _refused(spark, sf_dir) -> DataFrame:
    """Pages with the reason why a source that allows their own host, or in every seventh case just another, refuses them."""
    u = F.col("url")
    hosts = F.array(F.lit("x.example"), F.when(F.col("page_id") % 7 == 0, "y.example").otherwise(urls.host(u)))
    asked = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp"), F.regexp_replace(u, "^[a-z]+", ""))).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", "url", fetch.refusal(asked, hosts).alias("reason"))


@query("select page_id, url from pages where page_id % 7 <> 0 and page_id % 5 <> 0")
def allowed_hosts(spark, sf_dir):
    return _refused(spark, sf_dir).filter("reason is null").select("page_id", "url")


@query("select page_id, url, case when page_id % 5 = 0 then 'scheme' else 'host' end as reason from pages where page_id % 7 = 0 or page_id % 5 = 0")
def denied_hosts(spark, sf_dir):
    return _refused(spark, sf_dir).filter("reason is not null")


@query(f"""with d as (select doc_id, sha256(coalesce(text, '') || chr(31) || 'm' || chr(31) || '{json.dumps(sorted(model.FIELDS))}' || chr(31) || '{model.PROMPT_VERSION}') as cache_key from documents)
select distinct cache_key from d where cache_key not in (select d.cache_key from d join labels l on d.doc_id = l.doc_id)""")
def cache_misses(spark, sf_dir):
    """Texts whose answer isn't among those of labelled documents: only these would go to a model."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("page_text"), model.cache_key(F.col("text"), "m").alias("cache_key"))
    return model.unanswered(d, d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")).select("cache_key")


@query("""with a as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as attempt, case event_id % 6 when 0 then 200 when 1 then 429 when 2 then 404 else 503 end as status, case when event_id % 2 = 1 then event_id % 37 end as asked from events),
b as (select *, case when status = 429 and asked is not null then asked::double when attempt = 1 then 1.0 else 2.0 end as wait from a), c as (select *, sum(wait) over (partition by user_id order by attempt) as total from b)
select event_id, wait, total, bool_and(status in (429, 503) and attempt < 3 and total <= 30) over (partition by user_id order by attempt) as again from c""")
def retry_budget(spark, sf_dir):
    """Each user's events as the attempts of a request: how long to wait after each, and whether there is a next one."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, (200, 429, 404, 503, 503, 503))), (F.col("event_id") % 6 + 1).cast("int"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    attempts = e.select("event_id", F.col("user_id").alias("request"), F.row_number().over(order).alias("attempt"), status.alias("status"), F.when(F.col("event_id") % 2 == 1, F.col("event_id") % 37).alias("asked"))
    return fetch.waits(attempts).select("event_id", "wait", "total", "again")
