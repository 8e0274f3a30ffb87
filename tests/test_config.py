from pathlib import Path

import pytest

from tidemark.sources import config

BASE = (Path(__file__).parent / "fixtures" / "site" / "config.toml").read_text()


@pytest.mark.parametrize(
    "bad,says",
    [
        (BASE.replace('id = "club"', 'id = "town"'), "in common"),
        (BASE.replace('type = "listing"', 'type = "gopher"'), "unknown type"),
        (BASE.replace('profile = "cards"\n', ""), "needs a profile"),
        (BASE.replace('profile = "cards"', 'profile = "chairs"'), "needs a profile"),
    ],
)
def test_sources_that_cannot_run_are_errors(tmp_path, bad, says):
    (tmp_path / "c.toml").write_text(bad)
    with pytest.raises(ValueError, match=says):
        config.load(str(tmp_path / "c.toml"))


def test_places_in_a_store_and_what_a_site_does_not_print(tmp_path):
    more = 'profile = "cards"\nlocation = "the land"\norganizer = "the office"\nskip_titles = ["Pause"]'
    (tmp_path / "c.toml").write_text(BASE.replace('database = "state"', 'database = "s3a://bucket/state"').replace('profile = "cards"', more))
    c = config.load(str(tmp_path / "c.toml"))
    assert c.state == "s3a://bucket/state" and c.output == str(tmp_path / "feed.ics")
    assert [s[7:] for s in c.sources if s[0] == "cards"] == [("the land", "the office", ["Pause"])]
