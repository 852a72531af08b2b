"""The training-corpus pipeline: stages over ``documents``, each reading the table that the one before wrote."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_broadcast, materialise
from tessera.llm.decontam import find_leaks
from tessera.llm.mixing import mix_sources
from tessera.llm.simhash import near_duplicates
from tessera.llm.substrings import remove_repeats
from tessera.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


REST = ("lang", "source", "n_chars")

#: Rows of an Arrow batch: executors hold each whole, as do their Python workers, which look at so many at a time anyway.
ARROW_ROWS = 500


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but the rows with the id and text of one of ``gone(doc_id, tid)``."""
    keys = materialise(gone.select(F.col("doc_id").alias("key_id"), F.col("tid").alias("key_text")).distinct(), "gone", True)
    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.xxhash64("text") == F.col("key_text"))
    return docs.join(bounded_broadcast(keys), same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, carry=("text", *REST)).where("score < 0.3").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (five-word shingles, similarity 0.8) stays: the one with the
    smallest id; in a group without any id, the one whose text has the smallest hash. Of rows with the same id and text
    the first by their other columns stays."""
    groups = materialise(near_duplicates(docs, shingle_words=5, similarity=0.8), "groups")
    head = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tid") == F.col("component_tid"))
    kept = _without(docs.select(COLUMNS), groups.where(~head))
    again = materialise(groups.where(head).groupBy("doc_id", "tid").agg(F.count("*").alias("n")).where("n > 1"), "again", True)
    if again.isEmpty():
        return kept
    keys = bounded_broadcast(again.select(F.col("doc_id").alias("key_id"), F.col("tid").alias("key_text")))
    repeated = kept.join(keys, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.xxhash64("text") == F.col("key_text")))
    one = repeated.groupBy("key_id", "key_text").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return _without(kept, again).union(one.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that start in a document with a smaller id go; what is left is joined by single
    spaces. A document that loses nothing keeps its text as it is; one that loses all its words goes."""
    out = remove_repeats(docs, window=50, carry=REST).where("n_removed = 0 or n_removed < n_words")
    lost = F.col("n_removed") > 0
    return out.select(
        "doc_id", F.when(lost, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(lost, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like a benchmark item (five-word shingles, similarity 0.8) go."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle_words=5, similarity=0.8)
    return _without(docs.select(COLUMNS), leaks)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once each, with ``copies`` (how many times), their ``size`` in words, what that
    makes together (``taken``) and their source's ``target``; those it doesn't take go."""
    out = mix_sources(docs, carry=("text", "lang", "n_chars"))
    return out.where("copies > 0").select(*COLUMNS, "size", "target", "copies", "taken")


def _in_small_batches(stage):
    """``stage`` with the session's Arrow batches of ``ARROW_ROWS``, as what it returns is written after it has returned."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _in_small_batches(toxicity)),
    ("near_dedup", _in_small_batches(near_dedup)),
    ("substring_dedup", _in_small_batches(substring_dedup)),
    ("decontamination", _in_small_batches(decontamination)),
    ("mixing", _in_small_batches(mixing)),
]

#: Trained scores and hashes are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
