import json
import shutil
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest

from tidemark.plans import export, harvest
from tidemark.plans.state import State
from tidemark.sources import config, fetch

SITE = Path(__file__).parent / "fixtures" / "site"
START = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.fixture
def site(tmp_path):
    shutil.copytree(SITE, tmp_path / "site")
    return tmp_path / "site"


def go(spark, site, day):
    settings = config.load(str(site / "config.toml"))
    state = State(spark, settings.state)
    runs = harvest.run(spark, settings, fetch.canned(spark, str(site)), state, START + timedelta(days=day)).runs
    return settings, {r.source_id: r for r in runs}, {r.title: r for r in state.read("events").collect()}


def test_runs_are_repeatable_and_absence_cancels(spark, site):
    settings, runs, first = go(spark, site, 0)
    assert set(first) == {"Fest, gross", "Markt", "Lesung", "Tanz", "Messe", "Kirmes", "Konzert"}
    assert {k: r.coverage for k, r in runs.items()} == {"town": "PARTIAL", "club": "COMPLETE", "cards": "COMPLETE", "maps": "COMPLETE"}
    assert first["Markt"].all_day and first["Markt"].status == "TENTATIVE" and first["Fest, gross"].organizer == "Verein: A"
    assert first["Lesung"].start == datetime(2026, 4, 3, 17, 30) and first["Konzert"].location == "Halle, Weg 1, Ort"

    _, _, again = go(spark, site, 1)
    assert {k: (r.event_id, r.sequence) for k, r in again.items()} == {k: (r.event_id, 0) for k, r in first.items()}
    assert again["Fest, gross"].missing_count == 0  # its page hadn't changed

    page = (site / "dated.html").read_text()
    (site / "dated.html").write_text(page[: page.index('<div class="entryBody"><div class="leftCol">21.00')] + "</div>")
    (site / "concert.html").write_text((site / "concert.html").read_text().replace("20:00:00", "20:30:00"))
    _, _, third = go(spark, site, 2)
    assert third["Tanz"].missing_count == 1 and third["Tanz"].status == "CONFIRMED"
    assert third["Konzert"].sequence == 1 and third["Konzert"].event_id == first["Konzert"].event_id
    _, _, fourth = go(spark, site, 4)
    assert (fourth["Tanz"].status, fourth["Tanz"].cancelled_reason, fourth["Tanz"].sequence) == ("CANCELLED", "absence", 1)
    (site / "dated.html").write_text(page)
    _, _, fifth = go(spark, site, 5)
    assert (fifth["Tanz"].status, fifth["Tanz"].cancelled_reason, fifth["Tanz"].sequence, fifth["Tanz"].missing_count) == ("CONFIRMED", None, 2, 0)

    n = export.write(State(spark, settings.state).read("events"), settings.domain, settings.output)
    feed = Path(settings.output).read_bytes()
    assert n == 7 and feed.count(b"BEGIN:VEVENT") == 7 and feed.endswith(b"END:VCALENDAR\r\n")
    assert max(len(line) for line in feed.split(b"\r\n")) <= 75 and b"\n" not in feed.replace(b"\r\n", b"")


def test_limit_and_failures_give_partial_coverage(spark, site):
    text = (site / "config.toml").read_text().replace("[harvest]", "[harvest]\nmax_events_per_source = 1")
    (site / "config.toml").write_text(text)
    manifest = json.loads((site / "manifest.json").read_text())
    manifest["https://maps.example/robots.txt"] = {"status": 503}
    (site / "manifest.json").write_text(json.dumps(manifest))
    _, runs, events = go(spark, site, 0)
    assert {k: (r.coverage, r.events_seen) for k, r in runs.items()} == {"town": ("PARTIAL", 1), "club": ("PARTIAL", 1), "cards": ("PARTIAL", 1), "maps": ("PARTIAL", 0)}


def test_config_is_checked(tmp_path):
    base = (SITE / "config.toml").read_text()
    for bad in (base.replace("[general]", "[general]\nfoo = 1"), base.replace('["town.example"]', '["other.example"]'), base.replace("https://town.example/list", "ftp://town.example/list"), base + "min_request_delay_seconds = -1\n"):
        (tmp_path / "c.toml").write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "c.toml"))


def put(site, url, body=None, **how):
    manifest = json.loads((site / "manifest.json").read_text())
    if body is not None:
        how["file"] = url.replace("/", "_").replace(":", "_").replace("?", "_")
        (site / how["file"]).write_text(body)
    manifest[url] = how
    (site / "manifest.json").write_text(json.dumps(manifest))


def test_detail_pages_lead_to_calendars_or_to_the_model(spark, site):
    page = "https://town.example/veranstaltungen/veranstaltung/"
    put(site, "https://town.example/list", f'<a href="{page}umzug">x</a> <a href="{page}stumm">y</a> <a href="{page}fort">z</a>')
    put(site, page + "umzug", '<p>Umzug</p><a href="/dl/umzug.ICAL">ics</a>')
    put(site, page + "stumm", "<p>Sommerabend am See, 5. Juni 2026</p>")
    put(site, page + "fort", '<a href="/dl/fort.ical">ics</a>')
    put(site, "https://town.example/dl/umzug.ICAL", (site / "fest.ics").read_text().replace("Fest", "Umzug"))
    settings = config.load(str(site / "config.toml"))
    state, provider = State(spark, settings.state), fetch.canned(spark, str(site))

    def backend(messages, how):
        return json.dumps({"found": True, "title": "Sommerabend", "start": "2026-06-05T19:00:00"}) if "See" in messages[1]["content"] else json.dumps({"found": False})

    first = {r.source_id: r for r in harvest.run(spark, settings, provider, state, START, ["town"], backend).runs}
    assert {r.title for r in state.read("events").collect()} == {"Umzug, gross", "Sommerabend"}
    assert first["town"].events_seen == 2 and first["town"].coverage == "PARTIAL" and "host=town.example path=" in first["town"].notes
    assert state.read("model_cache").count() == 1
    silent = lambda *_: (_ for _ in ()).throw(AssertionError("the answer is cached"))
    assert harvest.run(spark, settings, provider, state, START + timedelta(days=1), ["town"], silent).runs[0].events_seen == 2


def test_lists_go_on_and_changed_markup_is_a_failure(spark, site):
    page = (site / "dated.html").read_text()
    put(site, "https://club.example/termine", page.replace("</body>", "").replace("</html>", "") + '<a href="?page=2">2</a><a href="/termine?page=2">weiter</a><a href="?page=1">1</a>')
    put(site, "https://club.example/termine?page=2", page.replace("Tanz", "Ball").replace("Messe", "Schau").replace("vDetail=", "vDetail=9"))
    put(site, "https://club.example/karten", "<p>Neu gestaltet</p>")
    _, runs, events = go(spark, site, 0)
    assert {"Ball", "Tanz"} <= set(events) and runs["club"].coverage == "COMPLETE"
    assert (runs["cards"].coverage, runs["cards"].events_seen) == ("PARTIAL", 0)


def test_robots_hold_for_redirects_and_queries(spark, site):
    hosts = '["town.example", "files.example"]'
    (site / "config.toml").write_text((site / "config.toml").read_text().replace('allowed_hosts = ["town.example"]', f"allowed_hosts = {hosts}"))
    put(site, "https://town.example/robots.txt", redirect_to="/r.txt")
    put(site, "https://town.example/r.txt", "User-agent: *\nDisallow: /*?print")
    put(site, "https://files.example/robots.txt", "User-agent: *\nDisallow: /private")
    put(site, "https://town.example/list", '<a href="/a.ical">a</a> <a href="/b.ical">b</a> <a href="/veranstaltungen/veranstaltung/c?%70rint=1">c</a>')
    put(site, "https://town.example/a.ical", redirect_to="https://files.example/private/a.ical")
    put(site, "https://town.example/b.ical", redirect_to="https://files.example/open/b.ical")
    for u in ("https://files.example/private/a.ical", "https://files.example/open/b.ical", "https://town.example/veranstaltungen/veranstaltung/c?%70rint=1"):
        put(site, u, (site / "fest.ics").read_text())
    _, runs, _ = go(spark, site, 0)
    assert runs["town"].events_seen == 1 and runs["town"].coverage == "PARTIAL"


def test_validators_by_date_and_waits(spark, site):
    put(site, "https://town.example/fest-12-1.ical", (site / "fest.ics").read_text(), headers={"last-modified": "Thu, 01 Jan 2026 00:00:00 GMT"})
    go(spark, site, 0)
    put(site, "https://town.example/fest-12-1.ical", "not a calendar", headers={"last-modified": "Thu, 01 Jan 2026 00:00:00 GMT"})
    _, _, events = go(spark, site, 1)
    assert events["Fest, gross"].missing_count == 0
    now = datetime(2026, 3, 29, 0, 30, tzinfo=UTC)
    assert [fetch.asked_wait(h, now) for h in ("7", "Sun, 29 Mar 2026 00:31:00 GMT", "Sun, 29 Mar 2026 00:29:00 GMT", "soon", "")] == [7.0, 60.0, 0.0, None, None]
