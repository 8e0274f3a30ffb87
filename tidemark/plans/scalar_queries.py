"""Queries of scalar functions and link predicates over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import history

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""select doc_id, sha256(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) || '|2026-01-01') as fingerprint from documents""")
def fingerprint_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.weak_fingerprint(F.col("text"), F.lit("2026-01-01")).alias("fingerprint"))


@query("""select o_orderkey, sha256(o_orderstatus || chr(31) || coalesce(o_orderpriority, '') || chr(31) || case when o_totalprice > 100000 then 'True' else 'False' end || chr(31) || o_custkey) as semantic_hash from orders""")
def semantic_hash_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.joined_hash(F.col("o_orderstatus"), F.col("o_orderpriority"), text.python_bool(F.col("o_totalprice") > 100000), F.col("o_custkey")).alias("semantic_hash"))


@query(r"""select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, lower(regexp_extract(url, '^([a-z]+):', 1)) as scheme from pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.scheme(u).alias("scheme"))


@query(r"""select page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1)) as href, generate_subscripts(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1), 1) - 1 as pos from pages""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls.hrefs(F.col("html"))).alias("pos", "href")).select("page_id", "href", F.col("pos").cast("long").alias("pos"))


@query(r"""select page_id, href, min(pos) as first_pos from (select page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1)) as href, generate_subscripts(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1), 1) - 1 as pos from pages) group by all""")
def page_links_distinct(spark, sf_dir):
    return history.first_of(page_links(spark, sf_dir), ["page_id", "href"], ["pos"]).withColumnRenamed("pos", "first_pos")


@query(r"""select page_id, lower(url) like '%.ical' or contains(lower(url), '/article/') as is_candidate, regexp_matches(lower(url), '^https?:') and not contains(lower(url), '/admin/') and contains(url, '/') as is_safe from pages""")
def candidate_links(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.is_candidate(u, "/article/").alias("is_candidate"), urls.is_safe_detail(u, "/", "/admin/", ["id=", "tx_solr"]).alias("is_safe"))


@query("""with d as (select o_orderkey, cast(o_orderdate as date) + interval 28 year as d from orders) select o_orderkey, strftime(d, '%Y-%m-%d') as first_day, strftime(d + interval 1 day, '%Y-%m-%d') as end_day from d""")
def german_numeric_roundtrip(spark, sf_dir):
    day = F.add_months(F.to_date("o_orderdate"), 12 * 28)
    said = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("am "), F.date_format(day, "d.M.yyyy"), F.lit(" im Saal")).alias("t"))
    return said.select("o_orderkey", dates.german_range(F.col("t")).alias("r")).select("o_orderkey", F.date_format("r.first", "yyyy-MM-dd").alias("first_day"), F.date_format("r.end", "yyyy-MM-dd").alias("end_day"))


@query("""with d as (select l_orderkey, l_linenumber, cast(l_shipdate as date) + interval 28 year as d, cast(l_shipdate as date) + interval 28 year + to_days(cast(l_linenumber as int)) as z from lineitem)
select l_orderkey, l_linenumber, strftime(make_date(year(z), month(d), day(d)), '%Y-%m-%d') as first_day, strftime(z + interval 1 day, '%Y-%m-%d') as end_day from d""")
def german_text_roundtrip(spark, sf_dir):
    """Ranges that name one year, at their end: of one across two years, both days are read in that year."""
    named = lambda d: F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month(d))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.add_months(F.to_date("l_shipdate"), 12 * 28).alias("a")).withColumn("b", F.date_add("a", F.col("l_linenumber")))
    said = F.concat(F.dayofmonth("a").cast("string"), F.lit(". "), F.initcap(named(F.col("a"))), F.lit(" - "), F.dayofmonth("b").cast("string"), F.lit(". "), named(F.col("b")), F.lit(" "), F.year("b").cast("string"))
    rows = l.select("l_orderkey", "l_linenumber", dates.german_range(said).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", F.date_format("r.first", "yyyy-MM-dd").alias("first_day"), F.date_format("r.end", "yyyy-MM-dd").alias("end_day"))


@query("""with t as (select event_id, ts + to_days((event_id % 366)::int) as ts from events), s as (select *, make_date(year(ts), 3, 31)::timestamp as m, make_date(year(ts), 10, 31)::timestamp as o from t),
h as (select event_id, ts, m - to_days(dayofweek(m)::int) + interval 1 hour as a, o - to_days(dayofweek(o)::int) + interval 1 hour as z from s),
d as (select *, date_trunc('day', ts + case when ts >= a and ts < z then interval 2 hour else interval 1 hour end) as day from h)
select event_id, strftime(day, '%Y-%m-%d') as berlin_day, strftime(day - case when day - interval 1 hour >= a and day - interval 2 hour < z then interval 2 hour else interval 1 hour end, '%Y-%m-%d %H:%M:%S') as starts_utc from d""")
def berlin_allday(spark, sf_dir):
    """Moments of a whole year, so in winter and in summer time."""
    moment = F.col("ts").cast("timestamp") + F.make_dt_interval((F.col("event_id") % 366).cast("int"))
    day = dates.berlin_day(moment)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(day, "yyyy-MM-dd").alias("berlin_day"), F.date_format(dates.berlin_midnight(day), "yyyy-MM-dd HH:mm:ss").alias("starts_utc"))


@query("""select event_id, cast(unnest(range(1, 4)) as bigint) as attempt, least(pow(2.0, unnest(range(1, 4)) - 1), 2.0) as wait from events where event_type = (select max(event_type) from events)""")
def retry_backoff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    failed = e.join(F.broadcast(e.agg(F.max("event_type").alias("event_type"))), "event_type")  # one row
    return failed.select("event_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("attempt")).withColumn("wait", dates.backoff(F.col("attempt")))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events""")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""select p_brand, string_agg(distinct p_type, ', ' order by p_type) as types from part group by p_brand""")
def names_join_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(text.distinct_join(F.array_sort(F.collect_set("p_type")), ", ").alias("types"))


@query(r"""select page_id, 'host=shop.example:81 path=' || case page_id % 4 when 0 then '/x/<redacted>/<redacted>' when 1 then '/api/<redacted>/<redacted>/y' when 2 then '/x/<redacted>/<redacted>' else '/x/tokens/' || page_id end as endpoint from pages""")
def redact_endpoint(spark, sf_dir):
    kind = F.col("page_id") % 4
    path = F.when(kind == 0, F.concat(F.lit("x/token/"), "page_id")).when(kind == 1, F.concat(F.lit("api/Bearer/"), "page_id", F.lit("/y"))).when(kind == 2, F.concat(F.lit("x/my-%74oken/"), "page_id")).otherwise(F.concat(F.lit("x/tokens/"), "page_id"))
    return table(spark, sf_dir, "pages").select("page_id", text.endpoint(F.concat(F.lit("https://user:pw@Shop.example:81/"), path, F.lit("?key=1"))).alias("endpoint"))


@query(r"""select doc_id, left(regexp_replace(regexp_replace(lower(replace(replace(text, 'ß', 'ss'), 'ẞ', 'ss')), '[^a-z0-9äöü]+', '-', 'g'), '^-+|-+$', '', 'g'), 100) as slug from documents""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))
