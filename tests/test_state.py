import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import reconcile
from tidemark.plans.state import State, migrate
from tidemark.streaming import landing

OBSERVED = "source_id string, obs_ord long, title string, start timestamp, end timestamp, all_day boolean, location string, description string, organizer string, status string, extraction_method string, extraction_confidence double, source_url string, event_url string, source_event_uid string, source_x_id string, error string, observed_at timestamp"


def seen(uid, title, day, order=1, status="CONFIRMED", x_id=None):
    return ("s", order, title, datetime(2026, 5, day), None, False, None, None, None, status, "ics", 1.0, "https://x/l", "https://x/e", uid, x_id, None, datetime(2026, 1, day))


def events(state):
    return {r.title: (r.sequence, r.status, r.cancelled_reason) for r in state.read("events").collect()}


def test_batches_are_versions_and_replays_change_nothing(spark, tmp_path):
    state = State(spark, f"file://{tmp_path}/state")
    one = spark.createDataFrame([seen("a", "A", 1), seen("b", "B", 2, 2)], OBSERVED)
    assert landing.apply(state, one, 0) == 0 and landing.apply(state, one.limit(0), 0) == 0
    assert events(state) == {"A": (0, "CONFIRMED", None), "B": (0, "CONFIRMED", None)}
    landing.apply(state, spark.createDataFrame([seen("a", "A2", 3), seen("a", "A3", 4, 2), seen("b", "B", 2, 3, "CANCELLED")], OBSERVED), 1)
    assert events(state) == {"A3": (2, "CONFIRMED", None), "B": (1, "CANCELLED", "source")}
    assert state.versions() == [0, 1]
    places = [json.loads((tmp_path / "state" / "commits" / v).read_text())["tables"] for v in "01"]
    assert places[0]["runs"] == places[1]["runs"] and places[0]["events"] != places[1]["events"]  # what a run doesn't change is not written again
    assert state.read("runs").count() == 0 and state.read("resource_cache").columns == ["url", "etag", "last_modified", "content_hash", "fetched_at"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([seen("a", "A", 1)], OBSERVED).write.parquet(f"{tmp_path}/in/0")
    state = State(spark, f"file://{tmp_path}/state")
    source = spark.readStream.schema(OBSERVED).parquet(f"{tmp_path}/in/*")
    landing.follow(source, state, f"{tmp_path}/offsets").awaitTermination()
    landing.follow(source, state, f"{tmp_path}/offsets").awaitTermination()
    assert events(state) == {"A": (0, "CONFIRMED", None)} and state.versions() == [0]


def test_identity_upgrades_and_conflicts(spark):
    none = spark.createDataFrame([], reconcile.ALIASES)

    def folded(rows, aliases):
        batch = spark.createDataFrame(rows, OBSERVED).withColumn("run_id", F.lit("r"))
        ids = {r.obs_ord: r.event_id for r in reconcile.assign(batch, aliases).collect()}
        after = reconcile.upsert_aliases(aliases, batch.join(reconcile.assign(batch, aliases), ["source_id", "obs_ord"]), F.lit(datetime(2026, 1, 1)))
        return ids, after

    weak = [seen(None, "A", 1)]
    first, aliases = folded(weak, none)
    later, _ = folded([seen("u1", "A", 1)], aliases)
    assert later[1] == first[1]  # the page's address is known, the strong alias is added
    two, _ = folded([seen("u1", "A", 1, 1), seen("u2", "A", 1, 2)], none)
    assert two[1] != two[2]  # same page, title and day, but different strong aliases
    same, _ = folded([seen("u1", "A", 1, 1), seen("u1", "B", 9, 2)], none)
    assert same[1] == same[2]


def test_old_formats_are_filled(spark):
    old = spark.createDataFrame([("e", "s", "https://x/p")], "event_id string, source_id string, source_url string")
    row = migrate(old, "events").first()
    assert row.event_url == "https://x/p" and row.sequence is None and set(row.asDict()) == {c.split()[0] for c in reconcile.EVENTS.split(", ")}
