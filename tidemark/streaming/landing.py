"""Observations as a stream: each micro-batch is a run, and its number the state's version, so a replay changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reconcile
from ..plans.state import State


def apply(state: State, batch: DataFrame, number: int, complete: bool = False, threshold: int = 3, grace_days: float = 7) -> int:
    """Reconciles one batch of observations as version ``number``; a version that is there already is left alone."""
    if number in state.versions():
        return number
    batch = batch.filter(F.coalesce(reconcile.valid(), F.lit(False))).withColumn("run_id", F.lit(str(number))).checkpoint()
    now = batch.agg(F.max("observed_at")).first()[0]
    now = F.lit(now).cast("timestamp")
    aliases, events = state.read("aliases"), state.read("events")
    assigned = batch.join(reconcile.assign(batch, aliases), ["source_id", "obs_ord"]).checkpoint()
    seen = batch.select("source_id").distinct().withColumn("coverage", F.lit("COMPLETE" if complete else "PARTIAL"))
    return state.commit({"events": reconcile.effects(events, assigned, seen, now, threshold, grace_days), "aliases": reconcile.upsert_aliases(aliases, assigned, now)}, number)


def follow(observations: DataFrame, state: State, checkpoint: str, **how) -> StreamingQuery:
    """observations: a stream with the columns of a run's observations and observed_at."""
    return observations.writeStream.foreachBatch(lambda batch, number: apply(state, batch, number, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
