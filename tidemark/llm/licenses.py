"""License scan by ordered signature rules, with DataFrame functions only.

Each text that may hold a license (it has a word that some rule needs) meets the rules whose own keyword it has. Overlapping
detections are resolved: one inside a longer one goes (of two with the same span the later rule's), and of two that overlap
otherwise the one of the earlier rule stays. Two sweeps over a text's detections, by start and by end, find these: each
detection meets those that are still open only, so the work grows with the text. Every step works on one row at a time, so
nothing is shuffled and a source of any size is no hot spot.

A null text counts as empty; empty texts and texts without words give no detections and score 0; texts of any length are
scanned whole; an empty table gives an empty one. Repeated rows give repeated results. Columns of the input stay; result
columns replace those of the same name.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_rules import rules

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]{1,12}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that count as base detections, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: What a base detection is worth to the score.
BASE_WEIGHT = 0.9

DETECTIONS = "array<struct<s:int,e:int,o:int,l:string,w:double>>"
MARKED = "array<struct<k:int,s:int,e:int,o:int,l:string,w:double,lost:boolean>>"


def compiled(pattern: str) -> str:
    return rf"(?<!{WORD})(?:{pattern.replace(',?', '').replace(' ?', '~').replace(' ', BETWEEN).replace('~', f'(?:{BETWEEN})?')})(?!{WORD})"


def gate(text: Column) -> Column:
    """Whether a text may match a rule or a phrase: it has a word that one of them needs, whatever separates its words."""
    needed = [k for k, *_ in rules()] + [p.split() for p in PHRASES]
    words = ["license"]
    for k in sorted(needed, key=len):
        if "cc" not in k and not any(w in x for w in words for x in k):
            words.append(max(k, key=len))
    has = F.lit(False)
    for w in words:
        has = has | F.contains(text, F.lit(w))
    # names that start with cc, which alone is in too many words
    return has | (F.contains(text, F.lit("cc")) & F.regexp_like(text, F.lit(rf"(?<!{WORD})cc{BETWEEN}by")))


def rule_column() -> Column:
    found = [{"o": i, "k": k, "r": compiled(p), "l": label, "w": w} for i, (k, p, label, w) in enumerate(rules())]
    return F.from_json(F.lit(json.dumps(found)), "array<struct<o:int,k:array<string>,r:string,l:string,w:double>>")


def spans(text: Column, rule: Column) -> Column:
    """All matches of a rule, as (first character, end, order, label, weight)."""
    hits = F.regexp_extract_all(text, rule["r"], F.lit(0))
    gaps = F.split(text, rule["r"], -1)
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    # places are collected in a string: to append to it costs less than to copy an array
    step = lambda a, x: F.struct((a["at"] + x["g"] + x["h"]).alias("at"), F.concat(a["out"], (a["at"] + x["g"]).cast("string"), F.lit(",")).alias("out"))
    starts = F.split(F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: a["out"]), ",", -1)
    found = F.zip_with(F.slice(starts, 1, F.size(hits)).cast("array<int>"), hits, lambda s, h: F.struct(s.alias("s"), (s + F.length(h)).alias("e"), rule["o"].alias("o"), rule["l"].alias("l"), rule["w"].alias("w")))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(DETECTIONS))


def phrase_places(words: Column) -> Column:
    """Where each phrase starts, as (word, label)."""
    return F.concat(*[places_of(words, phrase.split(), label) for phrase, label in PHRASES.items()])


def places_of(words: Column, parts: list[str], label: str) -> Column:
    def mark(w: Column, i: Column) -> Column:
        here = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            here = here & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return F.when(here, F.struct(i.cast("long").alias("i"), F.lit(label).alias("l")))

    return F.filter(F.transform(words, mark), lambda x: x.isNotNull())


def word_count(text: Column) -> Column:
    parts = F.split(text, NO_WORD, -1)
    blank = lambda x: (x == "").cast("long")
    return F.size(parts).cast("long") - blank(F.get(parts, F.lit(0))) - F.when(F.size(parts) > 1, blank(F.get(parts, F.size(parts) - 1))).otherwise(F.lit(0))


def sweep(sorted_: Column, open_: Callable[[Column, Column], Column]) -> Column:
    """Sorted detections, marked as lost if an earlier one beats them; open_(e, d): whether e, before d, may reach d or a later one.

    What is lost stays in the sequence, as it beats others still.
    """

    def step(state: Column, d: Column) -> Column:
        near = F.filter(state["near"], lambda e: open_(e, d))
        lost = d["lost"] | F.exists(near, lambda e: beats(e, d))
        return F.struct(F.array_append(near, d).alias("near"), F.concat(state["marks"], F.when(lost, F.lit("1")).otherwise(F.lit("0"))).alias("marks"))

    start = F.struct(F.array().cast(MARKED).alias("near"), F.lit("").alias("marks"))
    marks = F.regexp_extract_all(F.aggregate(sorted_, start, step, lambda state: state["marks"]), F.lit("."), F.lit(0))
    return F.zip_with(sorted_, marks, lambda d, m: F.struct(*[d[c].alias(c) for c in "kseolw"], (m == "1").alias("lost")))


def beats(e: Column, d: Column) -> Column:
    """Whether detection e removes d, where the two overlap."""
    long_e, long_d = e["e"] - e["s"], d["e"] - d["s"]
    inside = (e["s"] <= d["s"]) & (e["e"] >= d["e"]) & ((long_e > long_d) | (e["o"] < d["o"]))
    covers = (d["s"] <= e["s"]) & (d["e"] >= e["e"]) & (long_d > long_e)
    return inside | ((e["o"] < d["o"]) & ~covers)


def resolved(found: Column) -> Column:
    """The detections that stay, by place.

    One that starts after d and ends before it is inside d and can't beat it. So whatever beats d starts no later, and is met
    in the sweep by start, or ends no earlier, and is met in the sweep by end.
    """
    def keyed(rows: Column, key: Callable[[Column], Column], lost: Callable[[Column], Column]) -> Column:
        return F.array_sort(F.transform(rows, lambda d: F.struct(key(d).alias("k"), *[d[c].alias(c) for c in "seolw"], lost(d).alias("lost"))))

    starts = sweep(keyed(found, lambda d: d["s"], lambda _: F.lit(False)), lambda e, d: e["e"] > d["s"])
    ends = sweep(keyed(starts, lambda d: -d["e"], lambda d: d["lost"]), lambda e, d: e["s"] < d["e"])
    return F.array_sort(F.transform(F.filter(ends, lambda d: ~d["lost"]), lambda d: F.struct(*[d[c].alias(c) for c in "seolw"])))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, base (places of phrases), detections (those that stay), base_labels, labels, score."""
    whole = F.coalesce(F.col(text), F.lit(""))
    first = docs.withColumn("n_words", word_count(whole)).withColumn("_tm_low", F.when(gate(F.lower(whole)), F.translate(whole, UPPER, LOWER)))
    low = F.col("_tm_low")
    words = F.when(F.contains(low, F.lit("license")), F.regexp_extract_all(low, F.lit(WORD + "+"), F.lit(0)))
    second = first.withColumn("_tm_words", words)
    base = F.coalesce(phrase_places(F.col("_tm_words")), F.array().cast("array<struct<i:bigint,l:string>>"))
    found = F.flatten(F.transform(F.filter(rule_column(), lambda r: F.forall(r["k"], lambda k: F.contains(low, k))), lambda r: spans(low, r)))
    third = second.withColumn("base", F.when(F.col("_tm_words").isNotNull(), base)).withColumn("_tm_found", F.when(low.isNotNull(), found))
    all_of = F.col("_tm_found")

    fourth = third.withColumn("detections", F.when(F.size(all_of) < 2, all_of).otherwise(resolved(all_of)))
    fourth = fourth.withColumn("detections", F.coalesce("detections", F.array().cast(DETECTIONS)))
    base_labels = F.coalesce(F.array_distinct(F.transform(F.col("base"), lambda b: b["l"])), F.array().cast("array<string>"))
    own = F.transform(F.col("detections"), lambda d: d["l"])
    best = F.coalesce(F.array_max(F.transform(F.col("detections"), lambda d: d["w"])), F.lit(0.0))
    return (
        fourth.withColumn("base_labels", F.array_join(F.array_sort(base_labels), ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ","))
        .withColumn("score", F.greatest(best, F.when(F.size(base_labels) > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0))))
        .withColumn("base", F.coalesce(F.col("base"), F.array().cast("array<struct<i:bigint,l:string>>")))
        .drop("_tm_low", "_tm_words", "_tm_found")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    place = F.transform(F.col("base"), lambda b: b["i"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        "base_labels", "labels", "score", F.size("detections").alias("n_detections"),
    )
