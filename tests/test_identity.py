"""Identity by components against one ordered fold over a whole source."""

import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import components, reconcile

SEEN = "source_id string, obs_ord long, source_event_uid string, source_x_id string, source_url string, title string, start timestamp, run_id string"


def test_components_are_those_of_a_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in list(parent) if root(x) != x}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_folds_by_component_and_by_source_agree(spark, seed):
    rng = random.Random(seed)
    some = lambda share, n, p: f"{p}{rng.randrange(n)}" if rng.random() < share else rng.choice([None, ""])
    rows, held = [], []
    for source in ("a", "b", "c"):
        full = {"a": 1.0, "b": 0.8, "c": 0.3}[source]
        for i in range(120):
            rows.append((source, i, some(full, 60, "u"), some(0.5, 60, "x"), some(0.6, 40, "https://x/"), f"T {rng.randrange(15)}", datetime(2026, 5, 1 + rng.randrange(3)), "r"))
        for kind, n, p in (("ics_uid", 60, "u"), ("x_id", 60, "x"), ("source_url", 40, "https://x/")):
            held += [(kind, f"{p}{v}", source, f"e{rng.randrange(25)}", datetime(2026, 1, 1)) for v in rng.sample(range(n), n // 3)]
    seen = spark.createDataFrame(rows, SEEN)
    prints = [r[0] for r in seen.select(text.weak_fingerprint(F.col("title"), F.date_format(dates.berlin_day(F.col("start")), "yyyy-MM-dd"))).collect()]
    held += [("fingerprint", f, r[0], f"e{rng.randrange(25)}", datetime(2026, 1, 1)) for f, r in dict(zip(zip(prints, [r[0] for r in rows]), rows)).items() for f in [f[0]] if rng.random() < 0.5]
    aliases = spark.createDataFrame(held, reconcile.ALIASES)
    whole = []
    for source in "abc":
        mine = [(r[0], r[1], r[2], r[3], r[4], f, r[7]) for r, f in zip(rows, prints) if r[0] == source]
        obs = pd.DataFrame(mine, columns=["source_id", "obs_ord", "source_event_uid", "source_x_id", "source_url", "fingerprint", "run_id"])
        stored = pd.DataFrame([h for h in held if h[2] == source], columns=["alias_type", "alias_value", "source_id", "event_id", "created_at"])
        whole += list(reconcile.fold(obs, stored).itertuples(index=False, name=None))
    got = [tuple(r) for r in reconcile.assign(seen, aliases).select("source_id", "obs_ord", "event_id", "is_new").collect()]
    assert sorted(got) == sorted(whole)


def test_no_group_is_larger_than_its_component(spark):
    rows = [("s", i, f"u{i // 2}", None, "https://x/list", "same title", datetime(2026, 5, 1), "r") for i in range(400)]
    seen = spark.createDataFrame(rows, SEEN)
    candidates = reconcile.candidate_aliases(seen.withColumn("event_id", F.lit(None).cast("string"))).select("source_id", "obs_ord", "alias_type", "alias_value")
    none = spark.createDataFrame([], reconcile.ALIASES)
    labels = components.components(reconcile._bonds(candidates, none))
    assert labels.groupBy("component").count().agg(F.max("count")).first()[0] == 2  # two observations and their alias
    got = reconcile.assign(seen, none)
    assert got.select("event_id").distinct().count() == 200 and got.filter("is_new").count() == 200


def test_only_shared_aliases_reach_the_components(spark):
    rows = [("s", i, f"u{i // 3}", f"x{i}", f"https://x/{i}", f"title {i}", datetime(2026, 5, 1), "r") for i in range(90)]
    seen = spark.createDataFrame(rows, SEEN)
    candidates = reconcile.candidate_aliases(seen.withColumn("event_id", F.lit(None).cast("string"))).select("source_id", "obs_ord", "alias_type", "alias_value")
    held = spark.createDataFrame([("x_id", "x0", "s", "e", datetime(2026, 1, 1)), ("ics_uid", "alone", "s", "other", datetime(2026, 1, 1))], reconcile.ALIASES)
    bonds = reconcile._direct(reconcile._bonds(candidates, held))
    nodes = seen.select(reconcile._node("o", "obs_ord").alias("a"), F.col("obs_ord").alias("n")).unionByName(held.select(reconcile._node("e", "event_id").alias("a"), F.lit(-1).cast("long").alias("n")))
    pairs = {frozenset((r[0], r[1])) for r in bonds.join(nodes, "a").join(nodes.toDF("b", "m"), "b").select("n", "m").collect()}
    assert bonds.count() == len(pairs) == 61 and frozenset((-1, 0)) in pairs
    assert all(a // 3 == b // 3 for a, b in map(tuple, pairs - {frozenset((-1, 0))}))
