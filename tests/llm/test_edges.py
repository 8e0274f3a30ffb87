import public_tokenizers as public
import pytest
from edge import documents

from tidemark.llm import byte_bpe, decontaminate, license_rules, licenses, line_dedup, lm_score, near_dup, neighbours, quality, substring_dedup, token_shards
from tidemark.llm.common import scratch
from pyspark.sql import functions as F

BENCH = "item_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int, score string"


def by_row(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("empty", [False, True])
def test_every_operator_takes_odd_rows(spark, empty):
    docs = documents(spark, empty)
    n = docs.count()
    bench = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "run1 run2 run3 run4 run5 run6 run7 run8", "x"), (None, "one", "x")], BENCH)
    labels = spark.createDataFrame([(5, 1, 0, "x"), (None, 1, 0, "x"), (7, None, 0, "x"), (4, 0, 0, "x"), (4, 0, 1, "x")], LABELS)
    text = lambda df, *more: by_row(df, "doc_id", *more)
    own = [(r.doc_id, r.text or "") for r in docs.collect()]
    each = lambda f: sorted(((i, *f(t)) for i, t in own), key=str)
    scanned = licenses.scan(docs)
    assert scanned.count() == n
    assert scanned.filter("doc_id <> 8 or doc_id is null").filter("labels <> '' or score <> 0.0 or size(detections) <> 0").count() == 0
    ids = byte_bpe.encode(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    assert text(byte_bpe.decode(ids, public.path("byte_bpe_50k.tiktoken")), "decoded") == sorted(((i, bytearray(t.encode())) for i, t in own), key=str)
    judged = quality.classify(docs, labels)
    assert judged.count() == n and judged.filter("score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    assert quality.classify(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert text(substring_dedup.dedup(docs), "n_words") == each(lambda t: (len(t.encode().split()),))
    assert text(line_dedup.dedup(docs), "n_lines") == each(lambda t: (sum(1 for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")),))
    classes = near_dup.classes(docs)
    assert classes.count() == n and classes.filter("kept").count() == (0 if empty else 7)
    assert near_dup.keep_one(docs).columns == docs.columns and near_dup.keep_one(docs).count() == (0 if empty else 7)
    scored = lm_score.score(docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)))
    assert text(scored, "n_tokens") == each(lambda t: (len(t.encode().split()) + 1,))
    assert lm_score.score(docs, F.lit(False)).filter("train_tokens <> 0 or n_known <> 0 or base_score <> 0.0").count() == 0
    cleaned = decontaminate.clean(docs, bench)
    assert cleaned.columns == docs.columns and by_row(cleaned, "doc_id") == ([] if empty else sorted([(1,), (2,), (3,), (4,), (None,), (8,), (9,)], key=str))
    assert decontaminate.find(docs, bench.limit(0)).count() == 0
    found = by_row(decontaminate.find(docs, bench), "doc_id", "item_id")
    assert found == ([] if empty else sorted([(5, 3), (5, 3), (6, 3), (None, 3), (7, None)], key=str))
    folder = scratch(spark, "edge")
    token_shards.write(docs, folder, public.path("word_bpe_49k.json"), 2)
    assert token_shards.fetch(docs, folder, public.path("word_bpe_49k.json")).count() == n
    strangers = spark.createDataFrame([(77,), (10**12,), (-5,)], "doc_id long")
    assert token_shards.fetch(strangers, folder, public.path("word_bpe_49k.json")).count() == 0


def test_repeats_are_found_and_named(spark):
    docs = documents(spark)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs).filter("doc_id is not null").collect()}
    assert removed[5] == 64 and removed[6] == 60 and removed[4] == 0 and removed[7] == 0
    lines = by_row(line_dedup.dedup(docs).filter("doc_id = 5 or doc_id is null"), "doc_id", "n_removed")
    assert lines == sorted([(5, 0), (5, 2), (None, 2), (None, 0)], key=str)
    same = near_dup.classes(docs).filter("class_id = 5")
    assert by_row(same, "doc_id", "class_size") == sorted([(5, 4), (5, 4), (6, 4), (None, 4)], key=str) and same.filter("kept").count() == 1


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("d", F.lit("clash")).withColumn("node", F.lit(1))
    got = by_row(neighbours.search(df, F.lit(True)), "query_id", "rank", "vec_id")
    assert got == [(1, 1, 7), (1, 2, 9), (7, 1, 1), (7, 2, 9), (9, 1, 1), (9, 2, 7)]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_license_rules_all_have_keywords():
    rules = license_rules.rules()
    assert len(rules) > 300 and all(k and p and x and 0 < w <= 1 for k, p, x, w in rules)


def test_license_rules_see_any_separator(spark):
    plain = ["cc by 4 0", "cc by sa 4 0", "placed in the public domain", "all rights reserved", "may be used for x", "neither the name of x may be used to endorse or promote", "not for commercial use", "machine executable object code generated by a source language processor", "altered source versions must be plainly marked as such", "creative commons attribution 4 0", "creative commons zero", "mozilla org mpl 2 0", "eclipse org legal epl v20", "all advertising materials mentioning features or use of this software", "proprietary and confidential", "unauthorized copying of this file"]
    rows = [(i, f"{a}{sep.join(p.split())}{z}") for i, p in enumerate(plain) for sep in (" ", "-", "  ", "\n * ", ".") for a, z in (("", ""), ("(", ")"), ("x\n", "\n"))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", F.size("detections").alias("n")).collect()
    assert [r.text for r in got if (r.n == 0) != (plain[r.doc_id] == "may be used for x")] == []


def test_license_detections(spark):
    text = "SPDX-License-Identifier: BSD-3-Clause\nsee the MIT  License; mit-license. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. GNU General\nPublic License v3"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.base_labels == "gpl,mit" and r.labels == "bsd-3-clause,gpl,gpl-3.0,isc,mit"
    assert [(b.i, b.l) for b in sorted(r.base, key=lambda b: b.i)] == [(8, "mit"), (10, "mit"), (33, "gpl")]
    spans = sorted((d.s, d.e) for d in r.detections)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_stages_of_the_pipeline_take_odd_rows(spark):
    import corpus_pipeline

    path = scratch(spark, "edge-tables")
    spark.createDataFrame([(3, "run1 run2 run3 run4 run5 run6 run7 run8"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for empty in (False, True):
        docs = documents(spark, empty)
        docs.write.parquet(f"{path}/{empty}")
        docs = spark.read.parquet(f"{path}/{empty}")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, path)
            out.write.parquet(f"{path}/{empty}-{k}")
            out = spark.read.parquet(f"{path}/{empty}-{k}")
            assert out.count() <= docs.count() and (name == "byte-level BPE" or out.columns == docs.columns)
            if k:
                docs = out
        assert (out.count() == 0) if empty else by_row(out, "doc_id") == sorted([(1,), (2,), (3,), (4,), (8,), (9,)], key=str) or out.count() >= 5


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from tidemark.llm import common

    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_folder(Elsewhere())


def test_pipeline_keeps_every_column_and_value(spark):
    import corpus_pipeline

    path = scratch(spark, "own-columns")
    spark.createDataFrame([(3, "run1 run2 run3 run4 run5 run6 run7 run8")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    own = ["score", "Held_Out", "predicted", "n_removed", "n_lines", "n_runs", "longest_run", "uid", "same", "kept", "class_id", "item_id", "key", "text2"]
    rows = [(i, f"alpha{i} beta{i % 3}\nthe same line here\nand this line too\ngamma{i} " + " ".join(f"w{i}x{j}" for j in range(20)), "en", "s", 1, *[f"{c}-{i}" for c in own]) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in own)).write.parquet(f"{path}/0")
    docs = spark.read.parquet(f"{path}/0")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{path}/{k + 1}")
        docs = spark.read.parquet(f"{path}/{k + 1}")
        kept = docs.collect()
        assert len(kept) >= 38 and all(r[c] == f"{c}-{r.doc_id}" for r in kept for c in own)
    assert {r.n_chars == 1 or r.n_chars == len(r.text) for r in kept} == {True} and sum(r.n_chars != 1 for r in kept) >= 37
