"""What stays on local disks once a table is stored."""

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.llm import common


def shuffle_files(spark):
    return {f for top in Path(tempfile.gettempdir()).glob("blockmgr-*") for f in top.rglob("shuffle_*.data")}


def test_shuffles_of_what_was_cut_are_freed(spark):
    kept = [spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))]
    before = shuffle_files(spark)
    done = common.cut(kept[0].join(spark.range(50).withColumnRenamed("id", "k").repartition(3, "k"), "k"))
    assert sorted(r.n for r in done.collect()) == [142] * 1 + [143] * 6
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert kept[0].count() == 7  # what was cut can be computed again
