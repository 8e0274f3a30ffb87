"""Policy-checked fetching, a hop at a time for all requests at once.

A provider is a function from a table of (url, etag, last_modified, crawl_delay) to responses (url, status, headers, redirect_to, body):
canned ones from a folder, or live ones. What is a redirect, a refusal or a failure is decided here, by columns.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..operators import robots

RESPONSE = "url string, status int, headers map<string,string>, redirect_to string, body string"
MOVED = [301, 302, 303, 307, 308]
RETRIED = [429, 500, 502, 503, 504]
MOST_HOPS = 5
ROBOTS_HOPS, ROBOTS_BYTES = 3, 512_000
#: Attempts for one request, and seconds that they may wait in all.
ATTEMPTS, MOST_WAIT = 3, 30.0

Provider = Callable[[DataFrame], DataFrame]


def canned(spark: SparkSession, folder: str) -> Provider:
    """Responses from folder/manifest.json; an address that it doesn't have is a 404, an equal etag a 304."""
    entry = "map<string,struct<file:string,status:int,headers:map<string,string>,redirect_to:string>>"
    manifest = spark.read.text(f"{folder}/manifest.json", wholetext=True).select(F.explode(F.from_json("value", entry)).alias("known", "r"))
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").cast("string").alias("body"))
    rows = manifest.select("known", "r.*").join(files, "file", "left")

    def get(requests: DataFrame) -> DataFrame:
        met = requests.select("url", "etag", "last_modified").distinct().join(rows, F.col("url") == F.col("known"), "left")
        same = F.coalesce(F.element_at("headers", "etag") == F.col("etag"), F.element_at("headers", "last-modified") == F.col("last_modified"))
        status = F.when(F.col("known").isNull(), 404).when(F.col("redirect_to").isNotNull(), F.coalesce("status", F.lit(302))).when(same, 304).otherwise(F.coalesce("status", F.lit(200)))
        return met.select("url", status.cast("int").alias("status"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "redirect_to", F.coalesce("body", F.lit("")).alias("body"))

    return get


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def live(agent: str, timeout: float, most_bytes: int, delays: dict[str, float] | None = None, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """Requests of one host run one after the other in one task, paced and retried; hosts run side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = urllib.request.build_opener(_NoRedirect)
        known, last = dict(delays or {}), {}
        for b in batches:
            for url, etag, modified, crawl_delay, host in zip(*(c.to_pylist() for c in b.columns), strict=True):
                known[host], waited = max(known.get(host, 0.0), crawl_delay or 0.0), 0.0  # a delay once known stays, for later requests of the task
                for attempt in range(1, ATTEMPTS + 1):
                    if host in last:
                        sleep(max(0.0, last[host] + known[host] - time.monotonic()))
                    last[host] = time.monotonic()
                    headers = {"User-Agent": agent} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
                    try:
                        with opener.open(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                            status, got, body = r.status, r.headers, r.read(most_bytes + 1)
                    except urllib.error.HTTPError as e:
                        status, got, body = e.code, e.headers, b""
                    except OSError:
                        status, got, body = 599, {}, b""
                    asked = asked_wait(got.get("Retry-After", "")) if status == 429 else None
                    wait = min(2.0 ** (attempt - 1), 2.0) if asked is None else asked
                    if status not in RETRIED or attempt == ATTEMPTS or waited + wait > MOST_WAIT:
                        break
                    waited += wait
                    sleep(wait)
                if len(body) > most_bytes:
                    status, body = 413, b""
                low = {k.lower(): v for k, v in got.items()}
                yield pa.RecordBatch.from_pylist([{"url": url, "status": status, "headers": list(low.items()), "redirect_to": low.get("location"), "body": body.decode("utf-8", "replace")}], schema=ARROW)

    def get(requests: DataFrame) -> DataFrame:
        wanted = requests.groupBy("url", "etag", "last_modified").agg(F.max("crawl_delay").alias("crawl_delay")).withColumn("host", urls.host(F.col("url")))
        return wanted.repartition("host").sortWithinPartitions("host", "url").mapInArrow(run, RESPONSE)

    return get


def asked_wait(header: str, now: datetime | None = None) -> float | None:
    """Seconds that a Retry-After header asks for, as a number or as a date; None if it says neither."""
    if header.strip().isdigit():
        return float(header)
    try:
        return max(0.0, (parsedate_to_datetime(header) - (now or datetime.now(UTC))).total_seconds())
    except (TypeError, ValueError):
        return None


ARROW = pa.schema([("url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("redirect_to", pa.string()), ("body", pa.string())])


def refusal(url: Column, hosts: Column) -> Column:
    return F.when(~urls.is_web(url), "scheme").when(~F.array_contains(hosts, urls.host(url)), "host")


class Robots:
    """The rules of all origins met so far; those of a new one are fetched before its first page, on redirects too."""

    def __init__(self, provider: Provider, agent: str):
        self.provider, self.agent = provider, agent
        self.rules: DataFrame | None = None
        self.origins: DataFrame | None = None

    def of(self, pages: DataFrame) -> DataFrame:
        """Rules for at least the origins of some pages (url, hosts)."""
        new = pages.select(origin(F.col("url")).alias("origin"), "hosts").groupBy("origin").agg(F.array_distinct(F.flatten(F.collect_set("hosts"))).alias("hosts"))
        new = (new if self.origins is None else new.join(self.origins, "origin", "left_anti")).checkpoint()
        if self.rules is None or not new.isEmpty():
            found, known = robots_rules(new, self.provider, self.agent).checkpoint(), new.select("origin")
            self.rules = found if self.rules is None else self.rules.unionByName(found)
            self.origins = known if self.origins is None else self.origins.unionByName(known)
        return self.rules


def get(requests: DataFrame, provider: Provider, robots_of: Robots | None, most_bytes: int = 5_000_000, store: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """requests: source_id, url, hosts, etag. With at (the last address), status, headers, body, error, not_modified.

    Each hop is checked against scheme, allowed hosts and robots rules; validators go with the first hop only.
    """
    open_ = requests.withColumn("at", F.col("url"))
    keys, done = requests.columns, None
    for hop in range(MOST_HOPS + 1):
        checked = open_.withColumn("error", refusal(F.col("at"), F.col("hosts")))
        if robots_of is not None:
            rules = robots_of.of(checked.filter("error is null").select(F.col("at").alias("url"), "hosts"))
            asked = checked.select(F.col("at").alias("url_at"), origin(F.col("at")).alias("origin"), urls.robots_path(F.col("at")).alias("path")).distinct()
            allowed = robots.decide(asked, rules, ["url_at"])
            checked = checked.join(allowed, F.col("at") == F.col("url_at"), "left").withColumn("error", F.coalesce("error", F.when(~F.col("allowed"), "robots"))).drop("url_at", "allowed")
            delays = rules.groupBy("origin").agg(F.max("crawl_delay").alias("crawl_delay"))
            checked = checked.withColumn("origin", origin(F.col("at"))).join(delays, "origin", "left").drop("origin")
        else:
            checked = checked.withColumn("crawl_delay", F.lit(None).cast("double"))
        answers = store(provider(checked.filter("error is null").select(F.col("at").alias("url"), "crawl_delay", *[(F.col(c) if hop == 0 and c in keys else F.lit(None).cast("string")).alias(c) for c in ("etag", "last_modified")])))
        met = checked.join(answers.withColumnRenamed("url", "answered"), F.col("at") == F.col("answered"), "left")
        moves = F.col("status").isin(MOVED) & F.col("redirect_to").isNotNull() & F.col("error").isNull()
        said = F.when(moves, "too many redirects").when(F.col("status") == 304, None).when(F.length("body") > most_bytes, "too large").when(F.col("status") != 200, F.concat(F.lit("status "), "status"))
        final = met.filter(~F.coalesce(moves, F.lit(False)) | F.lit(hop == MOST_HOPS)).withColumn("error", F.coalesce("error", said))
        out = final.select(*keys, "at", "status", "headers", "body", "error", F.coalesce(F.col("status") == 304, F.lit(False)).alias("not_modified"))
        done = out if done is None else done.unionByName(out)
        from .profiles import absolute

        if not _any_moves(answers):
            break
        open_ = store(met.filter(moves).select(*keys, absolute(F.col("at"), F.col("redirect_to")).alias("at")))
    return store(done)


def _any_moves(answers: DataFrame) -> bool:
    """Whether stored answers lead on: no further hop is planned where none does."""
    return not answers.filter(F.col("status").isin(MOVED) & F.col("redirect_to").isNotNull()).isEmpty()


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]*)", 1)


def robots_rules(origins: DataFrame, provider: Provider, agent: str) -> DataFrame:
    """(origin, pattern, is_allow, crawl_delay) for some (origin, hosts): 404 and 410 allow all, other failures nothing.

    Up to ROBOTS_HOPS redirects are followed, to allowed hosts only; more than ROBOTS_BYTES count as a failure.
    """
    from .profiles import absolute

    none = F.lit(None).cast("string")
    open_, told = origins.select("origin", "hosts", F.concat("origin", F.lit("/robots.txt")).alias("at")), None
    for hop in range(ROBOTS_HOPS + 1):
        checked = open_.withColumn("error", refusal(F.col("at"), F.col("hosts")))
        answers = provider(checked.filter("error is null").select(F.col("at").alias("url"), none.alias("etag"), none.alias("last_modified"), F.lit(None).cast("double").alias("crawl_delay"))).checkpoint()
        met = checked.join(answers, F.col("at") == F.col("url"), "left")
        moves = F.coalesce(F.col("status").isin(MOVED) & F.col("redirect_to").isNotNull(), F.lit(False))
        final = met.filter(~moves | F.lit(hop == ROBOTS_HOPS)).select("origin", F.when(F.octet_length("body") > ROBOTS_BYTES, 413).otherwise(F.coalesce("status", F.lit(599))).alias("status"), "body")
        told = final if told is None else told.unionByName(final)
        if not _any_moves(answers):
            break
        open_ = met.filter(moves).select("origin", "hosts", absolute(F.col("at"), F.col("redirect_to")).alias("at")).checkpoint()
    rules = robots.parse(told.filter("status = 200"), agent, text="body")
    closed = told.filter(~F.col("status").isin(200, 404, 410)).select("origin", F.lit("/").alias("pattern"), F.lit(False).alias("is_allow"), F.lit(None).cast("double").alias("crawl_delay"))
    return rules.unionByName(closed)


def waits(attempts: DataFrame) -> DataFrame:
    """attempts (request, attempt from 1, status, asked: seconds that a Retry-After asked for) with wait (before the next one), total (so far, this one
    included) and again: whether there is a next one. It needs a passing failure, a number below ATTEMPTS, all waits within MOST_WAIT, and that none before it ended the request.
    """
    w = Window.partitionBy("request").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    wait = F.when((F.col("status") == 429) & F.col("asked").isNotNull(), F.col("asked").cast("double")).otherwise(dates.backoff(F.col("attempt")))
    summed = attempts.withColumn("wait", wait).withColumn("total", F.sum("wait").over(w))
    fine = F.col("status").isin(RETRIED) & (F.col("attempt") < ATTEMPTS) & (F.col("total") <= MOST_WAIT)
    return summed.withColumn("again", F.min(fine).over(w))
