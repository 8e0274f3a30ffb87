"""The feed in parts, and lines folded by bytes."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans import export

COLUMNS = "event_id string, title string, start timestamp, end timestamp, all_day boolean, location string, description string, organizer string, status string, sequence long, event_url string, dtstamp timestamp, last_modified timestamp"


def test_parts_make_up_the_ordered_feed(spark, tmp_path):
    day = datetime(2026, 5, 1)
    rows = [(f"e{i}", f"T{i % 7}", day + timedelta(hours=i * 37 % 500), None, i % 3 == 0, None, "ü,\n" * (i % 60), None, "CONFIRMED", i % 4, "", day, day) for i in range(300)]
    events = spark.createDataFrame(rows, COLUMNS).repartition(5)
    path = f"{tmp_path}/feed.ics"
    (tmp_path / "feed.ics").write_text("older")
    assert export.write(events, "x.example", path) == 300
    got = (tmp_path / "feed.ics").read_bytes()
    want = "".join(f"{r.vevent}\r\n" for r in export.vevents(events, "x.example").orderBy("start", "title", "event_id").collect())
    head, _, rest = got.partition(b"X-WR-TIMEZONE:Europe/Berlin\r\n")
    assert head.startswith(b"BEGIN:VCALENDAR\r\n") and rest == want.encode() + b"END:VCALENDAR\r\n"
    assert [p.name for p in tmp_path.iterdir()] == ["feed.ics"]
    assert export.write(events.limit(0), "x.example", f"file://{path}") == 0 and (tmp_path / "feed.ics").read_bytes().count(b"VEVENT") == 0


def test_lines_are_folded_by_bytes(spark):
    lines = ["", "a" * 75, "a" * 76, "a" * 149, "a" * 150, "é" * 37, "é" * 38, "a" + "é" * 120, "x" * 74 + "日本" * 40, "a b " * 100]
    got = [r.f for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", export.fold(F.col("x")).alias("f")).orderBy("i").collect()]
    for line, folded in zip(lines, got, strict=True):
        parts = folded.split("\r\n")
        assert parts[0] + "".join(p[1:] for p in parts[1:]) == line and all(p.startswith(" ") for p in parts[1:])
        assert all(len(p.encode()) <= 75 for p in parts) and all(len(p.encode()) >= 72 for p in parts[:-1])
