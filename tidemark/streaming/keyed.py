"""Reconciliation as a stateful stream: each source's aliases and events are keyed state, and grace days are timers.

A row is an observation (kind "seen") or says that a run of its source is over (kind "end", with coverage). The rows of one source's run come in one
micro-batch, as those of one file do. State is read by key: the aliases that a batch names, the events at which they point, and, at the end of a
complete run, the source's events once. An event that was missed often enough but not long enough sets a timer for the rest of the grace
days, which cancels it though nothing else arrives. What comes out is each event as it is after a change.

Sessions need the RocksDB state store; a query goes on for its timers until it is stopped, with the trigger availableNow too. A source is one key: its batch, and at the end of a complete run its events, pass through one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dates, text
from ..operators import reconcile

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAID = [c for c in reconcile.CONTENT if c not in ("start", "end")]
KINDS = {"all_day": "boolean", "extraction_confidence": "double"}
_TIMES = ("start", "end", "first_missing", "dtstamp", "last_modified", "created_at", "updated_at", "seen")
#: An event in the state; instants are microseconds since 1970, owned the strong aliases that it was seen with.
EVENT = ", ".join([*(f"{c} {KINDS.get(c, 'string')}" for c in SAID), "source_url string, event_url string, cancelled_reason string, semantic_hash string, sequence long, missing_count long, owned array<string>", *(f"{c} long" for c in _TIMES)])
NAMES = [c.split()[0] for c in EVENT.split(", ")]
OUT = "source_id string, event_id string, change string, at timestamp, " + ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in SAID) + ", source_url string, event_url string, cancelled_reason string, semantic_hash string, sequence long, missing_count long, start timestamp, end timestamp, first_missing timestamp"
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
DAY = 86_400_000_000


def micros(t) -> int | None:
    return None if t is None or pd.isna(t) else int(pd.Timestamp(t).value // 1000)


def instant(m: int | None) -> datetime | None:
    return None if m is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=m)


class Reconciler(StatefulProcessor):
    def __init__(self, threshold: int = 3, grace_days: float = 7):
        self.threshold, self.grace = threshold, int(grace_days * DAY)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.aliases = handle.getMapState("aliases", "alias_type string, alias_value string", "event_id string")
        self.events = handle.getMapState("events", "event_id string", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True)
        out = []
        for run_ts, run in batch.groupby("run_ts", sort=True):
            now = micros(run_ts)
            seen = run[run.kind == "seen"]
            if len(seen):
                out += self._seen(key[0], seen, now)
            if ((run.kind == "end") & (run.coverage == "COMPLETE")).any():
                out += self._missed(key[0], now)
        if out:
            yield pd.DataFrame(out, columns=OUT_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out = []
        for (event,), held in list(self.events.iterator()):
            e = dict(zip(NAMES, held, strict=True))
            if e["status"] != "CANCELLED" and self._due(e, now):
                out.append(self._put(key[0], event, e | {"missing_count": e["missing_count"]}, now, "cancelled"))
        if out:
            yield pd.DataFrame(out, columns=OUT_NAMES)

    def close(self) -> None:
        pass

    def _due(self, e: dict, now: int) -> bool:
        return e["first_missing"] is not None and e["missing_count"] >= self.threshold and now - e["first_missing"] >= self.grace

    def _put(self, source: str, event: str, e: dict, now: int, change: str) -> tuple:
        if change == "cancelled":
            e |= {"status": "CANCELLED", "cancelled_reason": "absence", "sequence": e["sequence"] + 1, "dtstamp": now, "last_modified": now, "updated_at": now}
        self.events.updateValue((event,), tuple(e[c] for c in NAMES))
        row = {**e, **{c: instant(e[c]) for c in _TIMES}, "source_id": source, "event_id": event, "change": change, "at": instant(now)}
        return tuple(row[c] for c in OUT_NAMES)

    def _held(self, aliases: list[tuple[str, str]]) -> pd.DataFrame:
        """The stored aliases among some, and all strong ones of the events at which they point."""
        found = {a: self.aliases.getValue(a)[0] for a in dict.fromkeys(aliases) if self.aliases.containsKey(a)}
        for event in set(found.values()):
            for owned in dict(zip(NAMES, self.events.getValue((event,)), strict=True))["owned"]:
                alias = tuple(owned.split("\x1f", 1))
                if self.aliases.containsKey(alias) and self.aliases.getValue(alias)[0] == event:
                    found[alias] = event
        return pd.DataFrame([(t, v, e) for (t, v), e in found.items()], columns=["alias_type", "alias_value", "event_id"])

    def _seen(self, source: str, seen: pd.DataFrame, now: int) -> list[tuple]:
        seen = seen.astype(object).where(seen.notna(), None).sort_values("obs_ord")
        kinds = {"ics_uid": "source_event_uid", "x_id": "source_x_id", "source_url": "source_url", "fingerprint": "fingerprint"}
        named = {o.obs_ord: [(t, getattr(o, c)) for t, c in kinds.items() if getattr(o, c)] for o in seen.itertuples()}
        folded = reconcile.fold(seen, self._held([a for each in named.values() for a in each]))
        events = dict(zip(folded.obs_ord, folded.event_id, strict=True))
        touched: dict[str, tuple[dict, str]] = {}
        for o in seen.itertuples():
            event = events[o.obs_ord]
            if event in touched:
                e, change = touched[event]
            elif self.events.containsKey((event,)):
                e, change = dict(zip(NAMES, self.events.getValue((event,)), strict=True)), "seen"
                e["owned"] = list(e["owned"])
            else:
                e, change = dict.fromkeys(NAMES) | {"sequence": 0, "owned": [], "created_at": now}, "created"
            first = change == "created" and event not in touched
            revived = event not in touched and not first and e["status"] == "CANCELLED" and e["cancelled_reason"] == "absence" and o.status != "CANCELLED"
            changed = not first and (o.semantic_hash != e["semantic_hash"] or o.event_url != e["event_url"] or revived)
            if first or changed:
                e |= {c: getattr(o, c) for c in SAID} | {"start": micros(o.start), "end": micros(o.end), "semantic_hash": o.semantic_hash, "sequence": e["sequence"] + changed, "last_modified": now}
                e["cancelled_reason"] = "source" if o.status == "CANCELLED" or e["cancelled_reason"] == "source" and event in touched else None if revived else e["cancelled_reason"]
                change = "changed" if changed and change != "created" else change
            e |= {"source_url": o.source_url, "event_url": o.event_url, "missing_count": 0, "first_missing": None, "dtstamp": now, "updated_at": now, "seen": now}
            e["owned"] = sorted({*e["owned"], *(f"{t}\x1f{v}" for t, v in named[o.obs_ord] if t in reconcile.STRONG)})
            for alias in named[o.obs_ord]:
                self.aliases.updateValue(alias, (event,))
            touched[event] = e, change
        return [self._put(source, event, e, now, change) for event, (e, change) in touched.items()]

    def _missed(self, source: str, now: int) -> list[tuple]:
        out, timers = [], set()
        for (event,), held in list(self.events.iterator()):
            e = dict(zip(NAMES, held, strict=True))
            if e["status"] == "CANCELLED" or e["seen"] >= now:
                continue
            e |= {"missing_count": e["missing_count"] + 1, "first_missing": e["first_missing"] if e["first_missing"] is not None else now, "updated_at": now}
            due = self._due(e, now)
            if not due and e["missing_count"] >= self.threshold:
                timers.add((e["first_missing"] + self.grace) // 1000 + 1)
            out.append(self._put(source, event, e, now, "cancelled" if due else "missed"))
        for at in timers:
            self.handle.registerTimer(at)
        return out


def follow(rows: DataFrame, threshold: int = 3, grace_days: float = 7) -> DataFrame:
    """rows: a stream with source_id, run_id, run_ts, kind, coverage, obs_ord and an observation's columns. Events after each change."""
    day = F.date_format(dates.berlin_day(F.col("start")), "yyyy-MM-dd")
    fine = (F.col("kind") == "end") | F.coalesce(reconcile.valid(), F.lit(False))
    columns = ["source_id", "run_id", "run_ts", "kind", "coverage", "obs_ord", "source_event_uid", "source_x_id", "source_url", "event_url", *reconcile.CONTENT]
    ready = rows.filter(fine).select(*columns, text.weak_fingerprint(F.col("title"), day).alias("fingerprint"), reconcile.semantic_hash().alias("semantic_hash"))
    return ready.groupBy("source_id").transformWithStateInPandas(Reconciler(threshold, grace_days), OUT, "update", "processingTime")
