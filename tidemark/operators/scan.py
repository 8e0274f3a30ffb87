"""Running sums and maxima over ordered rows of a key, in two levels, so that a key with very many rows is split.

Rows are dealt into ranges by key and order; each range has a running result of its own, and a second, small table has each range's
total for a key. What stands before a range is the running result of these totals, and is joined to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
TOTALS = {"sum": F.sum, "max": F.max}


def blocks(df: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """df in ranges of its rows by key and order, with their numbers; stored, as a range's borders are drawn from samples."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, key, *order).withColumn(BLOCK, F.spark_partition_id()).checkpoint()


def running(df: DataFrame, key: str, order: list[str], **columns: tuple[str, Column]) -> DataFrame:
    """df (from blocks) with each named column as the running "sum" or "max" of an expression, this row included. Nulls don't count."""
    inside = Window.partitionBy(key, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    valued = df.withColumns({f"_v_{name}": value for name, (_, value) in columns.items()})
    totals = valued.groupBy(key, BLOCK).agg(*[TOTALS[how](f"_v_{name}").alias(f"_t_{name}") for name, (how, _) in columns.items()])
    earlier = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("_k"), F.col(BLOCK).alias("_b"), *[TOTALS[how](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (how, _) in columns.items()])
    own = valued.withColumns({f"_r_{name}": TOTALS[how](f"_v_{name}").over(inside) for name, (how, _) in columns.items()})
    met = own.join(before, own[key].eqNullSafe(F.col("_k")) & (F.col(BLOCK) == F.col("_b")))

    def both(name: str, how: str) -> Column:
        here, there = F.col(f"_r_{name}"), F.col(f"_c_{name}")
        return F.greatest(here, there) if how == "max" else F.when(here.isNull() & there.isNull(), None).otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0)))

    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[both(name, how).alias(name) for name, (how, _) in columns.items()])
