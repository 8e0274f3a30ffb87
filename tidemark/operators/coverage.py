"""How much of a source a run has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETE, UNCHANGED, PARTIAL = "COMPLETE", "UNCHANGED", "PARTIAL"


def outcome_aggregates(ok: Column, not_modified: Column, n_urls: Column, explicit_empty: Column) -> list[Column]:
    return [F.count("*").alias("n_seeds"), F.bool_and(ok).alias("all_ok"), F.bool_and(not_modified).alias("all_old"), F.bool_or(not_modified).alias("any_old"), F.sum(n_urls).alias("n_urls"), F.bool_or(explicit_empty).alias("any_empty")]


def classify() -> Column:
    """Coverage from outcome_aggregates; sources without a seed outcome have nulls there."""
    c = F.col
    return (
        F.when(c("n_seeds").isNull() | ~c("all_ok"), PARTIAL)
        .when(c("all_old"), UNCHANGED)
        .when(c("any_old"), PARTIAL)
        .when((c("n_urls") == 0) & ~c("any_empty"), PARTIAL)
        .otherwise(COMPLETE)
    )


def discovery(outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, coverage) of each source. outcomes: source_id, ok, not_modified, urls, explicit_empty."""
    found = outcomes.groupBy("source_id").agg(*outcome_aggregates(F.col("ok"), F.col("not_modified"), F.size("urls"), F.col("explicit_empty")))
    return sources.select("source_id").join(found, "source_id", "left").select("source_id", classify().alias("coverage"))


def downgrade(coverage: DataFrame, failures: DataFrame) -> DataFrame:
    """COMPLETE becomes PARTIAL where any item of the source failed."""
    failed = failures.groupBy("source_id").agg(F.lit(True).alias("failed"))
    lower = F.when(F.col("failed") & (F.col("coverage") == COMPLETE), PARTIAL).otherwise(F.col("coverage"))
    return coverage.join(failed, "source_id", "left").select("source_id", lower.alias("coverage"))
