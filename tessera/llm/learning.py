"""What the trained operators share: held-out folds, labelled rows, bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, fold_of

#: Rows whose crc32(id as text) has this remainder modulo FOLDS are never learnt from.
FOLDS, HELD_OUT = 4, 2


def with_fold(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``(doc_id, text, held_out, ...)``; no other column of ``docs`` is read."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (fold_of(id_col, FOLDS) == HELD_OUT).alias("held_out"), *more
    )


def labelled(rows: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """Rows outside the held-out fold that have a label (0 or 1), with it as ``y``. Several labels of an id: the largest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(fold_of("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.where(~F.col("held_out")).join(bounded_broadcast(known), "doc_id")


def sample(rows: DataFrame, n: int, most: int, salt: str) -> DataFrame:
    """About ``most`` of the ``n`` rows (all, if fewer), the same on every run: those with small hashes of their id."""
    if n <= most:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(salt)), 1) < int(most / n * 2**63))
