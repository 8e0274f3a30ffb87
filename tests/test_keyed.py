"""The stateful stream against runs in batches, and timers that need no new rows."""

import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans.state import State
from tidemark.streaming import keyed, landing

ROWS = "source_id string, run_id string, run_ts timestamp, kind string, coverage string, obs_ord long, title string, start timestamp, end timestamp, all_day boolean, location string, description string, organizer string, status string, extraction_method string, extraction_confidence double, source_url string, event_url string, source_event_uid string, source_x_id string, error string"
NOW = datetime.now(UTC).replace(microsecond=0)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, keyed.STORE)
    yield spark
    spark.conf.set(name, before)


def seen(run, at, order, title, day, uid=None, x_id=None, status="CONFIRMED", source="s", place=None, url="https://x/e"):
    return (source, str(run), at, "seen", None, order, title, datetime(2027, 5, day, 12), None, False, place, None, None, status, "ics", 1.0, "https://x/list", url, uid, x_id, None)


def end(run, at, coverage="COMPLETE", source="s"):
    return (source, str(run), at, "end", coverage, *[None] * 16)


def wait(query, done, seconds=90):
    """Stops a query, which goes on by itself for its timers, when something is done."""
    until = time.time() + seconds
    try:
        while time.time() < until and query.isActive and not done():
            time.sleep(0.5)
    finally:
        query.stop()


def runs():
    """Runs of two sources, with changes, absences, revivals, cancellations by the source and by absence."""
    rng, out = random.Random(6), []
    for run in range(5):
        at, coverage = NOW - timedelta(days=30 - 5 * run), rng.choice(["COMPLETE", "COMPLETE", "COMPLETE", "PARTIAL"])
        rows = []
        for source in ("a", "b"):
            picked = [i for i in range(14) if rng.random() < (0.75 if i % 3 else 0.35)]
            for order, i in enumerate(picked + rng.sample(picked, 2)):
                strong = {"uid": f"u{i}"} if i % 4 else {"x_id": f"x{i}"} if i % 8 else {}
                rows.append(seen(run, at, order, f"T{i}" + rng.choice(["", "", "!"]), 1 + i, status=rng.choice(["CONFIRMED"] * 5 + ["CANCELLED"]), source=source, place=rng.choice(["p", "q"]), url=rng.choice(["https://x/e", "https://x/f"]), **strong))
            rows.append(end(run, at, coverage, source))
        out.append(rows)
    return out


def test_a_stream_ends_in_the_state_of_batches(rocks, tmp_path):
    spark, state = rocks, State(rocks, f"file://{tmp_path}/state")
    for number, rows in enumerate(runs()):
        df = spark.createDataFrame(rows, ROWS)
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        batch = df.filter("kind = 'seen'").withColumn("observed_at", F.col("run_ts")).drop("run_ts", "kind", "coverage", "run_id")
        landing.apply(state, batch, number, rows[-1][4] == "COMPLETE", 2, 7)
    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = keyed.follow(source, 2, 7).writeStream.format("memory").queryName("keyed_events").outputMode("update").option("checkpointLocation", f"{tmp_path}/offsets").start()
    wait(query, lambda: sum(p["numInputRows"] for p in query.recentProgress) == sum(map(len, runs())))
    columns = ["title", "status", "cancelled_reason", "sequence", "missing_count", "first_missing", "location", "event_url", "start"]
    last = spark.table("keyed_events").groupBy("source_id", "event_id").agg(F.max_by(F.struct(*columns), F.struct("at", "sequence", "missing_count")).alias("e")).select("source_id", "e.*")
    rows_of = lambda df: sorted((tuple(r) for r in df.select("source_id", *columns).collect()), key=str)
    want = rows_of(state.read("events"))
    assert {r[3] for r in want} >= {None, "absence", "source"} and max(r[4] for r in want) >= 3
    assert rows_of(last) == want


def test_a_timer_cancels_without_new_rows(rocks, tmp_path):
    spark = rocks
    first = [seen(0, NOW - timedelta(days=2), 0, "Gone", 1, "u1"), seen(0, NOW - timedelta(days=2), 1, "Kept", 2, "u2"), end(0, NOW - timedelta(days=2))]
    soon = datetime.now(UTC) + timedelta(seconds=1)
    spark.createDataFrame(first, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    spark.createDataFrame([seen(1, soon, 0, "Kept", 2, "u2"), end(1, soon)], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = keyed.follow(source, 1, 8 / 86400).writeStream.format("memory").queryName("keyed_timers").outputMode("update").option("checkpointLocation", f"{tmp_path}/offsets").trigger(processingTime="1 second").start()
    wait(query, lambda: spark.sql("select 1 from keyed_timers where change = 'cancelled'").count())
    told = [(r.title, r.change, r.status, r.sequence) for r in spark.table("keyed_timers").orderBy("at", "title").collect()]
    assert told[-1] == ("Gone", "cancelled", "CANCELLED", 1) and ("Gone", "missed", "CONFIRMED", 0) in told
    assert [t for t in told if t[0] == "Kept" and t[2] == "CANCELLED"] == []
