import shutil
from pathlib import Path

from tidemark import cli

SITE = Path(__file__).parent / "fixtures" / "site"


def test_run_prints_sources_and_writes_the_feed(spark, tmp_path, capsys):
    shutil.copytree(SITE, tmp_path / "site")
    config = str(tmp_path / "site" / "config.toml")
    assert cli.main(["--config", str(tmp_path / "none.toml")]) == 2
    assert cli.main(["run", "--config", config, "--fixtures", str(tmp_path / "site"), "--source", "cards"], spark) == 0
    out = capsys.readouterr().out
    assert "cards: COMPLETE events=2" in out and "2 events in" in out
    assert (tmp_path / "site" / "feed.ics").read_bytes().count(b"BEGIN:VEVENT") == 2
    assert cli.main(["run", "--config", config, "--fixtures", str(tmp_path / "site"), "--source", "cards", "-v", "--database", f"{tmp_path}/other", "--output", f"{tmp_path}/other.ics"], spark) == 0
    assert "created=2 updated=0 cancelled=0" in capsys.readouterr().out and (tmp_path / "other.ics").exists() and (tmp_path / "other" / "commits" / "0").exists()
