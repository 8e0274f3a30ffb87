"""Configuration: TOML, checked, with the sources as a table."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from . import profiles

KINDS = ("listing", "structured-html", "sitemap")
SOURCES = "source_id string, kind string, profile string, enabled boolean, seeds array<string>, hosts array<string>, delay double, default_location string, default_organizer string, skip_titles array<string>"


@dataclass
class Config:
    domain: str = "localhost"
    state: str = "state"
    output: str = "calendar.ics"
    user_agent: str = "tidemark/1"
    missing_threshold: int = 3
    missing_grace_days: float = 7
    max_events: int = 500
    timeout: float = 15
    max_bytes: int = 5_000_000
    model: str | None = None
    max_input_chars: int = 6000
    sources: list[tuple] = field(default_factory=list)

    def table(self, spark: SparkSession, ids: list[str] | None = None) -> DataFrame:
        """The enabled sources, or those of them that are named."""
        return spark.createDataFrame([s for s in self.sources if s[3] and (not ids or s[0] in ids)], SOURCES)


KNOWN = {"general": {"domain": "domain", "database": "state", "output": "output", "user_agent": "user_agent", "timezone": None}, "harvest": {"missing_threshold": "missing_threshold", "missing_grace_days": "missing_grace_days", "max_events_per_source": "max_events", "request_timeout_seconds": "timeout", "max_content_bytes": "max_bytes"}, "llm": {"enabled": None, "default_model": "model", "max_input_chars": "max_input_chars"}}


def load(path: str) -> Config:
    """Unknown keys and sections are errors; paths are relative to the file."""
    raw = tomllib.loads(Path(path).read_text())
    if extra := raw.keys() - KNOWN.keys() - {"sources"}:
        raise ValueError(f"unknown sections: {sorted(extra)}")
    values = {}
    for section, names in KNOWN.items():
        for k, v in raw.get(section, {}).items():
            if k not in names:
                raise ValueError(f"unknown key {section}.{k}")
            if names[k]:
                values[names[k]] = v
    config = Config(**values, sources=[source(s) for s in raw.get("sources", [])])
    ids = [s[0] for s in config.sources]
    if len(set(ids)) < len(ids):
        raise ValueError(f"sources that have an id in common: {sorted({i for i in ids if ids.count(i) > 1})}")
    if config.max_events <= 0:
        raise ValueError("max_events_per_source must be positive")
    for name in ("state", "output"):
        if "://" not in getattr(config, name):  # one with a scheme names a store
            setattr(config, name, str((Path(path).parent / getattr(config, name)).resolve()))
    return config


def source(s: dict) -> tuple:
    if extra := s.keys() - {"id", "type", "profile", "enabled", "seed_urls", "allowed_hosts", "min_request_delay_seconds", "location", "organizer", "skip_titles"}:
        raise ValueError(f"unknown keys in a source: {sorted(extra)}")
    seeds, hosts = s["seed_urls"], list(dict.fromkeys(h.strip().lower() for h in s["allowed_hosts"]))
    if not hosts or not all(hosts):
        raise ValueError("allowed_hosts must name hosts")
    for u in seeds:
        if urlsplit(u).scheme not in ("http", "https") or urlsplit(u).hostname not in hosts:
            raise ValueError(f"seed outside of http(s) or the allowed hosts: {u}")
    delay = float(s.get("min_request_delay_seconds", 0))
    if delay < 0:
        raise ValueError("a delay can't be negative")
    if s["type"] not in KINDS:
        raise ValueError(f"unknown type of source {s['id']!r}: {s['type']!r}")
    if s["type"] == "structured-html" and s.get("profile") not in profiles.PROFILES:
        raise ValueError(f"source {s['id']!r} needs a profile, one of {sorted(profiles.PROFILES)}")
    return s["id"], s["type"], s.get("profile"), s.get("enabled", True), seeds, hosts, delay, s.get("location"), s.get("organizer"), s.get("skip_titles", [])
