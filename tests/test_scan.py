import random

from pyspark.sql import functions as F

from tidemark.operators import history, scan


def test_running_results_cross_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    blocks = scan.blocks(df, "k", ["i"], 6)
    assert blocks.filter("k = 'hot'").select(scan.BLOCK).distinct().count() > 2
    got = {r.i: (r.s, r.m) for r in scan.running(blocks, "k", ["i"], s=("sum", F.col("v")), m=("max", F.col("v"))).collect()}
    for key in ("hot", "b", None):
        seen = []
        for k, i, v in rows:
            if k == key:
                seen += [] if v is None else [v]
                assert got[i] == (sum(seen) if seen else None, max(seen, default=None))
    assert scan.running(scan.blocks(df.limit(0), "k", ["i"]), "k", ["i"], s=("sum", F.col("v"))).count() == 0


def test_pacing_under_growing_delays(spark):
    rng = random.Random(4)
    rows = [("h" if rng.random() < 0.7 else "g", i, rng.randint(0, 4000), rng.choice([None, -3, 0, 1, 2, 5, 9])) for i in range(700)]
    got = {r.i: r.start for r in history.paced(spark.createDataFrame(rows, "host string, i long, a long, d long"), "host", F.col("a"), ["i"], F.col("d")).collect()}
    last, known = {}, {}
    for host, i, a, d in rows:
        known[host] = max(known.get(host, 0), d or 0)
        last[host] = max(a, last[host] + known[host]) if host in last else a
        assert got[i] == last[host]


def test_rows_are_numbered_in_ranges(spark):
    from tidemark.plans.operator_queries import _numbered

    got = _numbered(spark.range(1000).select((F.col("id") * 7919 % 1000 * 3).alias("key")), "key")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r.k) for r in got.collect()} == {(3 * i, i) for i in range(1000)}
