"""Removal of repeated runs of lines, by a suffix array over line ids; DataFrame functions only.

Each line that isn't blank is a symbol (its 128-bit digest); a document is a sequence of symbols. Prefix doubling ranks all
suffixes by their first 1, 2, 4 ... symbols: a suffix's new rank is that of the pair of old ranks at its start and further
on, and the pairs get their order from a range partitioning, so no group of equal suffixes has to meet in one task. A
suffix whose prefix occurs nowhere else leaves the array at once, as no longer prefix of it can. The array is sorted as deep
as asked for; suffixes of equal rank are then its intervals with a longest common prefix of that depth or more, and
overlapping ones make up the maximal repeated runs.

A run counts if it has ``LEAST_LINES`` lines, or one line of ``LEAST_WORDS`` words. Its first occurrence (by id, then place in
the input) stays, every line that a later occurrence covers goes; where occurrences overlap, what the later one covers goes.
Blank lines stay. A null text stays null, an empty one empty; rows without an id come after those with one, of equal ids the one
first in the input; repeated rows lose the runs of all but the first. Texts of any length are read whole; an empty table
gives an empty one. Columns of the input stay; result columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_LINES = 2
LEAST_WORDS = 50
SPACE = r"[\x09-\x0D ]+"


def word_count(line: Column) -> Column:
    return F.size(F.filter(F.split(line, SPACE), lambda w: w != ""))


def filled(text: Column) -> Column:
    """Of each line that has a word: its place among all lines."""
    marked = F.transform(F.split(text, "\n", -1), lambda line, i: F.when(line.rlike(r"[^\x09-\x0D ]"), i))
    return F.filter(marked, lambda i: i.isNotNull())


def line_symbols(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(uid, id, k, symbol, long): the k-th line that isn't blank of each document, numbered by _tm_uid."""
    whole = rows.select(F.col("_tm_uid").alias("uid"), F.col(key).alias("id"), F.split(F.col(text), "\n", -1).alias("lines"))
    lines = whole.select("uid", "id", F.posexplode(F.filter("lines", lambda x: x.rlike(r"[^\x09-\x0D ]"))).alias("k", "line"))
    return lines.select("uid", "id", "k", F.unhex(F.md5("line")).alias("symbol"), (word_count(F.col("line")) >= LEAST_WORDS).alias("long"))


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """rows whose value of ``by`` isn't alone, with rank: a number that orders the values as they order themselves."""
    values = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").select(*by)
    order = values.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
    return rows.join(common.cut(order), list(by)).drop(*by)


def suffix_array(symbols: DataFrame, depth: int) -> DataFrame:
    """(uid, id, k, long, rank) of all suffixes whose first ``depth`` symbols occur elsewhere too, ranked by these."""
    return deepen(common.cut(ranked(symbols, "symbol")), depth)


def deepen(rows: DataFrame, depth: int) -> DataFrame:
    """From ranks by one symbol to ranks by ``depth`` symbols."""
    deep = 1
    while deep < depth:
        step = min(deep, depth - deep)
        further = rows.select("uid", (F.col("k") - step).alias("k"), F.col("rank").alias("second"))
        rows = common.cut(ranked(rows.withColumnRenamed("rank", "first").join(further, ["uid", "k"]), "first", "second"))
        deep += step
    return rows


def later(rows: DataFrame) -> DataFrame:
    """Of suffixes of equal rank, all but the first."""
    place = F.struct(F.col("id").isNull(), "id", "uid", "k")
    first = rows.groupBy("rank").agg(F.min(place).alias("head")).select("rank", F.col("head.uid").alias("head_uid"), F.col("head.k").alias("head_k"))
    return rows.join(first, "rank").filter("uid <> head_uid or k <> head_k").select("uid", "k")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_lines: int = LEAST_LINES, repeatable: bool = False) -> DataFrame:
    """docs with their texts as they are after removal, n_lines (not blank, before), n_removed, n_runs and longest_run (of lines
    that aren't blank and go one after the other). repeatable: as in common.numbered."""
    numbered = common.numbered(docs.drop("n_lines", "n_removed", "n_runs", "longest_run"), "_tm_uid", repeatable)
    single = suffix_array(line_symbols(numbered, key, text), 1)
    runs = later(deepen(single, least_lines)).select("uid", F.explode(F.sequence("k", F.col("k") + least_lines - 1)).alias("k"))
    gone = runs.unionByName(later(single.filter("long"))).groupBy(F.col("uid").alias("_tm_found")).agg(F.array_sort(F.collect_set("k")).alias("_tm_gone"))
    rows = numbered.join(gone, F.col("_tm_uid") == F.col("_tm_found"), "left").drop("_tm_uid", "_tm_found")
    lines, places, out = F.split(F.col(text), "\n", -1), filled(F.col(text)), F.col("_tm_gone")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(out, lambda k: F.get(places, k)))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    # a line goes on with a run if the one before it goes too; each run ends where the next one starts
    starts = F.filter(F.transform(out, lambda k, i: F.when((i == 0) | (F.get(out, i - 1) != k - 1), i)), lambda i: i.isNotNull())
    lengths = F.transform(F.col("_tm_starts"), lambda a, i: F.coalesce(F.get("_tm_starts", i + 1), F.size(out)) - a)
    counted = rows.withColumn("n_lines", size(places)).withColumn("n_removed", size(out)).withColumn("_tm_starts", starts).withColumn("n_runs", size(F.col("_tm_starts")))
    whole = counted.withColumn("longest_run", F.coalesce(F.array_max(lengths), F.lit(0)).cast("long"))
    return whole.withColumn(text, F.when(out.isNull(), F.col(text)).otherwise(kept)).drop("_tm_gone", "_tm_starts")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(common.read(spark, sf_dir, "documents").select("doc_id", "text"), repeatable=True)
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
words as (select *, len(list_filter(regexp_split_to_array(line, '[\\x09-\\x0D ]+'), lambda w: w <> '')) as n from lines),
filled as (select *, row_number() over (partition by doc_id order by i) as k from words where n > 0),
pairs as (select a.doc_id, a.k, a.line as x, b.line as y from filled a join filled b on a.doc_id = b.doc_id and b.k = a.k + 1),
later_pairs as (select doc_id, k from pairs qualify row_number() over (partition by x, y order by doc_id, k) > 1),
later_long as (select doc_id, k from filled where n >= {LEAST_WORDS} qualify row_number() over (partition by line order by doc_id, k) > 1),
gone as (select doc_id, k from later_pairs union select doc_id, k + 1 from later_pairs union select doc_id, k from later_long),
runs as (
  select doc_id, count(*) as n from (select doc_id, k - row_number() over (partition by doc_id order by k) as run from gone) group by doc_id, run),
of_doc as (select doc_id, count(*) as n_runs, max(n) as longest_run from runs group by doc_id),
marked as (select w.doc_id, w.i, w.line, f.k is not null as is_filled, g.k is not null as is_gone
  from words w left join filled f on w.doc_id = f.doc_id and w.i = f.i left join gone g on f.doc_id = g.doc_id and f.k = g.k)
select m.doc_id, count(*) filter (is_filled) as n_lines, count(*) filter (is_gone) as n_removed,
  coalesce(any_value(r.n_runs), 0)::bigint as n_runs, coalesce(any_value(r.longest_run), 0)::bigint as longest_run,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not is_gone), '')) as kept_sha256
from marked m left join of_doc r on m.doc_id = r.doc_id group by m.doc_id
"""
