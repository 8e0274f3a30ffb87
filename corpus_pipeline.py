"""A corpus pipeline: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents. Benchmark and labels come from sf_dir.

In every stage a null text counts as empty (and stays null where it isn't changed), repeated rows are documents of their own, texts
of any length are read whole, other columns stay (but in the last stage), whatever their names, and an empty table gives an
empty one. Ties: of documents in one class of near-duplicates that of the smallest id stays, of those without an id or with
equal ones the first in the files; of equal line runs the first occurrence by id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, common, decontaminate, line_dedup, near_dup, quality


def with_own_columns(docs: DataFrame, operator, *results: str) -> DataFrame:
    """What an operator makes of docs, whose columns come out as they went in where a result column has the same name (in any case)."""
    aside = {c: f"_tm_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in results}
    out = operator(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns], *[F.col(c).alias(f"_tm_{c}") for c in results])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "quality")
    judged = with_own_columns(docs, lambda d: quality.classify(d, labels), "held_out", "score", "predicted")
    return judged.filter("_tm_predicted = 1").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs; one of which nothing is left is dropped."""
    found = with_own_columns(docs, lambda d: line_dedup.dedup(d, repeatable=True), "n_lines", "n_removed", "n_runs", "longest_run").filter("_tm_n_removed = 0 or _tm_n_removed < _tm_n_lines")
    return found.withColumn("n_chars", F.when(F.col("_tm_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.keep_one(docs, repeatable=True).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"), repeatable=True).select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and digests of its ids and of the text decoded from them."""
    return byte_bpe.digest(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL can't express the classifier, the signatures, the alignment or the merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents, each stage's result stored in the shared folder."""
    docs, folder = common.read(spark, sf_dir, "documents"), common.scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            common.drop(spark, f"{folder}/{k - 1}")
    return docs
