"""Ordered, stateful operators as windows: change sequences, missing streaks, forward fill, look-ahead, pacing, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def first_of(df: DataFrame, keys: list[str], order: list, count: str | None = None) -> DataFrame:
    """The first row of each key, and how many there are if count names a column for it: partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    many = [F.count("*").alias(count)] if count else []
    return df.groupBy(*keys).agg(least, *many).select(*keys, "_r.*", *([count] if count else [])).select(*df.columns, *([count] if count else []))


def first_n(df: DataFrame, keys: list[str], order: list, n: int, place: str) -> DataFrame:
    """The first n rows of each key with their places, from 1; rows beyond are dropped before the shuffle already."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n)


def last_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key (an upsert's result)."""
    rest = [c for c in df.columns if c not in keys]
    most = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(most).select(*keys, "_r.*").select(*df.columns)


def sequence(df: DataFrame, key: str, order: list, content: Column, column: str = "sequence") -> DataFrame:
    """How often an entity's content has changed so far, from 0."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.lag("_content").over(w) != F.col("_content")
    marked = df.withColumn("_content", content).withColumn("_changed", F.coalesce(changed, F.lit(False)).cast("long"))
    return marked.withColumn(column, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_content", "_changed")


def missing_streak(df: DataFrame, key: str, order: list, seen: Column) -> DataFrame:
    """Runs in a row, up to now, without a sighting, and when the first of them was (order[0])."""
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    island = df.withColumn("_seen", seen.cast("long")).withColumn("_island", F.sum("_seen").over(upto))
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("_seen") == 0
    return island.withColumn("missing", F.sum(gap.cast("long")).over(inside)).withColumn("first_missing", F.min(F.when(gap, F.col(order[0]))).over(inside)).drop("_seen", "_island")


def forward_fill(df: DataFrame, key: str, order: list, value: Column, column: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(value, ignorenulls=True).over(w))


def look_ahead(df: DataFrame, key: str, order: list, heading: Column, rows: int = 4) -> DataFrame:
    """With group (number of headings so far): what follows within its group, at most so many rows."""
    w = Window.partitionBy(key).orderBy(*order)
    grouped = df.withColumn("section", F.sum(heading.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped, Window.partitionBy(key, "section").orderBy(*order).rowsBetween(1, rows)


def paced(df: DataFrame, host: str, arrival: Column, order: list[str], delay: Column, column: str = "start") -> DataFrame:
    """start_i = max(arrival_i, start_{i-1} + known_i), known_i being the largest delay that the host has asked for up to i; a null one asks for nothing.

    With D_i the sum of known delays up to i, start_i - D_i is the largest arrival_j - D_j so far: three running results, for delays that grow, too.
    """
    rows = scan.blocks(df.withColumns({"_a": arrival, "_d": F.greatest(F.coalesce(delay, F.lit(0)), F.lit(0))}), host, order)
    known = scan.running(rows, host, order, _known=("max", F.col("_d")))
    summed = scan.running(known, host, order, _sum=("sum", F.col("_known")))
    ahead = scan.running(summed, host, order, _most=("max", F.col("_a") - F.col("_sum")))
    return ahead.withColumn(column, F.col("_most") + F.col("_sum")).drop("_a", "_d", "_known", "_sum", "_most", scan.BLOCK)


def strictest_delay(df: DataFrame, host: str, order: list, delay: Column, column: str = "known_delay") -> DataFrame:
    """The largest delay that a host has asked for so far."""
    w = Window.partitionBy(host).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.max(delay).over(w))


def capped(df: DataFrame, key: str, order: list, size: Column, most: int, column: str = "taken") -> DataFrame:
    """How many of each row's items fit under a cap per key; the row that crosses it is taken in part."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(w), F.lit(0))
    return df.withColumn("_size", size).withColumn("_before", before).withColumn(column, F.greatest(F.least(F.col("_size"), F.lit(most) - F.col("_before")), F.lit(0)).cast("long")).drop("_size", "_before")
