"""Queries of joins, aggregates, windows and state changes over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import coverage, history, robots
from .scalar_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


RULES = [("/", True), ("/article", False), ("/article/*/a", True), ("*7", False), ("/*.html$", False), ("", False)]


@query(
    """with rules(pattern, allow, re, n) as (values ('/', true, '^/', 1), ('/article', false, '^/article', 8), ('/article/*/a', true, '^/article/.*/a', 11), ('*7', false, '^.*7', 1), ('/*.html$', false, '^/.*\\.html$', 6)),
    p as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages)
    select p.page_id, coalesce(arg_max(r.allow, r.n * 2 + r.allow::int), true) as allowed from p left join rules r on regexp_matches(p.path, r.re) group by p.page_id"""
)
def robots_longest_match(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.lit("o").alias("origin"), urls.path(F.col("url")).alias("path"))
    rules = spark.createDataFrame([("o", a, b) for a, b in RULES], "origin string, pattern string, is_allow boolean")
    return robots.decide(p, rules, ["page_id"])


@query("""with s as (select event_type, cast(ts as date) as d, bool_and(value > 1) as all_ok, bool_and(user_id % 4 < day(ts) % 5) as all_old, bool_or(user_id % 4 < day(ts) % 5) as any_old, sum(case when value > 20 then 1 else 0 end) as n_urls, bool_or(value > 90) as any_empty from events group by 1, 2)
select event_type, strftime(d, '%Y-%m-%d') as day, case when not all_ok then 'PARTIAL' when all_old then 'UNCHANGED' when any_old then 'PARTIAL' when n_urls = 0 and not any_empty then 'PARTIAL' else 'COMPLETE' end as coverage from s""")
def coverage_by_source(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    c = F.col
    outs = coverage.outcome_aggregates(c("value") > 1, c("user_id") % 4 < F.dayofmonth("ts") % 5, (c("value") > 20).cast("long"), c("value") > 90)
    return e.groupBy("event_type", "day").agg(*outs).select("event_type", "day", coverage.classify().alias("coverage"))


@query("""select event_id, cast(sum(changed) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as sequence from (select *, case when lag(event_type) over (partition by user_id order by ts, event_id) <> event_type then 1 else 0 end as changed from events)""")
def sequence_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return history.sequence(e, "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id", "sequence")


def _sightings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seen = e.select("user_id", F.to_date("ts").alias("day")).distinct().withColumn("seen", F.lit(True))
    span = e.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("a"))
    last = e.agg(F.max(F.to_date("ts")).alias("z"))
    days = span.join(F.broadcast(last)).select("user_id", F.explode(F.sequence("a", "z")).alias("day"))  # last is one row
    return days.join(seen, ["user_id", "day"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


_SIGHT_SQL = """e as (select distinct user_id, cast(ts as date) as day from events), span as (select user_id, min(day) as a from e group by 1), last as (select max(day) as z from e),
days as (select user_id, cast(unnest(generate_series(a, z, interval 1 day)) as date) as day from span, last), s as (select d.user_id, d.day, e.day is not null as seen from days d left join e on d.user_id = e.user_id and d.day = e.day),
i as (select *, sum(seen::int) over (partition by user_id order by day) as island from s), m as (select *, sum((not seen)::int) over w as missing, min(case when not seen then day end) over w as first_missing from i window w as (partition by user_id, island order by day rows unbounded preceding))"""


@query(f"with {_SIGHT_SQL} select user_id, strftime(day, '%Y-%m-%d') as day, cast(missing as bigint) as missing from m")
def missing_streak(spark, sf_dir):
    found = history.missing_streak(_sightings(spark, sf_dir), "user_id", ["day"], F.col("seen"))
    return found.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("missing").cast("long").alias("missing"))


@query(f"with {_SIGHT_SQL} select user_id, strftime(min(day), '%Y-%m-%d') as cancelled_on from m where missing >= 2 and datediff('day', first_missing, day) >= 1 group by user_id")
def auto_cancel(spark, sf_dir):
    """The first day on which both the threshold of misses and the days of grace are reached."""
    found = history.missing_streak(_sightings(spark, sf_dir), "user_id", ["day"], F.col("seen"))
    gone = found.filter((F.col("missing") >= 2) & (F.datediff("day", "first_missing") >= 1))
    return gone.groupBy("user_id").agg(F.date_format(F.min("day"), "yyyy-MM-dd").alias("cancelled_on"))


@query("""with a as (select event_id, user_id, cast(epoch_us(ts) // 1000000 as bigint) as t, row_number() over (partition by user_id order by ts, event_id) as i from events) select event_id, max(t - i * 3600) over (partition by user_id order by i rows unbounded preceding) + i * 3600 as start from a""")
def pacing_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")).cast("long"))
    e = e.withColumn("t", F.floor(F.col("t") / 1_000_000).cast("long"))
    return history.paced(e, "user_id", F.col("t"), ["ts", "event_id"], F.lit(3600).cast("long")).select("event_id", "start")


@query("""with recursive a as (select event_id, user_id, cast(epoch_us(ts) // 1000000 as bigint) as t, case when event_id % 4 = 0 then null else (event_id % 7) * 900 end as d, row_number() over (partition by user_id order by ts, event_id) as i from events),
s as (select event_id, user_id, i, coalesce(d, 0) as known, t as start from a where i = 1
union all select a.event_id, a.user_id, a.i, greatest(s.known, coalesce(a.d, 0)), greatest(a.t, s.start + greatest(s.known, coalesce(a.d, 0))) from s join a on a.user_id = s.user_id and a.i = s.i + 1)
select event_id, start from s""")
def pacing_growing_delay(spark, sf_dir):
    """When each request of a host may start, where hosts ask for longer delays as time goes on."""
    e = table(spark, sf_dir, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"))
    delay = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 7 * 900)
    return history.paced(e, "user_id", F.col("t"), ["ts", "event_id"], delay).select("event_id", "start")


@query("""select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as heading from conversations""")
def forward_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return history.forward_fill(c, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("text")), "heading").select("conv_id", "turn", "heading")


@query("""with s as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as section from conversations)
select conv_id, turn, last_value(case when role = 'assistant' then length(text)::bigint end ignore nulls) over w as answer, count(*) over w as n_following from s window w as (partition by conv_id, section order by turn rows between 1 following and 4 following)""")
def lookahead_four(spark, sf_dir):
    grouped, w = history.look_ahead(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role") == "user")
    answer = F.when(F.col("role") == "assistant", F.length("text").cast("long"))
    return grouped.select("conv_id", "turn", F.last(answer, ignorenulls=True).over(w).alias("answer"), F.count("*").over(w).alias("n_following"))


@query("""select min(doc_id) as doc_id, count(*) as copies from documents group by lower(text), lang""")
def dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.lower("text"), 256).alias("k"))
    return history.first_of(d, ["k", "lang"], ["doc_id"], "copies").select("doc_id", "copies")


@query("""select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def upsert_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return history.last_of(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderpriority, o_orderkey) as place from orders qualify place <= 3""")
def feed_order_first(spark, sf_dir):
    found = history.first_n(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderpriority", "o_orderkey"], 3, "place")
    return found.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("""with s as (select event_id, user_id, ts, cast(floor(value) as bigint) % 7 as size from events), b as (select *, coalesce(sum(size) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as before from s)
select event_id, cast(greatest(least(size, 100 - before), 0) as bigint) as taken from b""")
def cap_with_partial(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return history.capped(e, "user_id", ["ts", "event_id"], F.floor("value").cast("long") % 7, 100).select("event_id", "taken")


@query("""select regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) as host, page_id, max(page_id % 11) over (partition by regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) order by page_id rows unbounded preceding) as known_delay from pages""")
def strictest_delay(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return history.strictest_delay(p, "host", ["page_id"], F.col("page_id") % 11).select("host", "page_id", "known_delay")


@query(f"""with {_SIGHT_SQL}, q as (select user_id, event_type, ts, event_id, case when lag(event_type) over (partition by user_id order by ts, event_id) <> event_type then 1 else 0 end as changed from events),
f as (select user_id, cast(sum(changed) as bigint) as sequence, arg_max(event_type, event_id) filter (true) as unused, strftime(max(case when changed = 1 then ts end), '%Y-%m-%d %H:%M:%S') as last_change from q group by user_id),
z as (select user_id, cast(arg_max(missing, day) as bigint) as missing from m group by user_id)
select f.user_id, f.sequence, f.last_change, z.missing from f join z using (user_id)""")
def event_state(spark, sf_dir):
    """Each entity's state after all its observations: changes so far, the last of them, and the streak of misses."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    counted = history.sequence(e, "user_id", ["ts", "event_id"], F.col("event_type"))
    first = counted.groupBy("user_id", "sequence").agg(F.min("ts").alias("since"))
    final = first.groupBy("user_id").agg(F.max("sequence").alias("sequence"), F.date_format(F.max(F.when(F.col("sequence") > 0, F.col("since"))), "yyyy-MM-dd HH:mm:ss").alias("last_change"))
    streak = history.missing_streak(_sightings(spark, sf_dir), "user_id", ["day"], F.col("seen"))
    last = streak.groupBy("user_id").agg(F.max_by("missing", "day").cast("long").alias("missing"))
    return final.join(last, "user_id").select("user_id", "sequence", "last_change", "missing")
