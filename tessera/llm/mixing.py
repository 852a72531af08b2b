"""Mixing sources to target weights by hash-threshold histograms: no document is ever sorted or gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, materialise

#: Bits of the document hash that each histogram tells apart, and bits in all (15 hexadecimal digits).
STEP, BITS = 12, 60


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops
    at ``limit`` times its source's size and the excess is shared by weight among the others, until none is above.
    That fixed point is one level per unit of weight, found with sums over the sources in the order in which they
    reach their limit. The windows hold a row per source, never a document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn.cast("int")).cast("double"))
    per = per.withColumn("full", F.col("source_size") * limit / F.col("weight"))
    line = Window.orderBy("full", F.col("source").asc_nulls_last())
    per = per.withColumns({
        "all": F.sum("source_size").over(Window.partitionBy()),
        "capped": F.coalesce(F.sum(F.col("source_size") * limit).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("all") - F.col("capped")) / F.col("open")
    per = per.withColumn("level", F.min(F.when(level <= F.col("full"), F.struct("full", level.alias("level")))).over(Window.partitionBy())["level"])
    return per.select("source", "source_size", F.coalesce(F.least(F.col("weight") * F.col("level"), (F.col("source_size") * limit).cast("double")), F.lit(0.0)).alias("target"))


def _thresholds(sizes: DataFrame, parts: DataFrame) -> DataFrame:
    """``(source, last)``: documents of the source with ``h`` up to ``last`` have sizes that sum to about ``part``.

    Each round sums sizes by source and hash prefix inside the bucket where the budget ends, and keeps only the
    bucket where it ends now, until that holds a single hash value.
    """
    open_, done, shift = parts.where("part > 0").select("source", "part", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")), [], BITS
    done.append(parts.where("part <= 0").select("source", F.lit(-1).cast("long").alias("last")))
    while True:
        at, shift = shift, max(0, shift - STEP)
        inside = open_ if at == BITS else bounded_broadcast(open_)
        d = sizes.select(F.col("source").alias("s"), "h", "size").join(
            inside, F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("h", at) == F.col("prefix"))
        )
        hist = d.groupBy("source", "part", "before", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("size"), (F.min("h") == F.max("h")).alias("single"))
        line = Window.partitionBy("source").orderBy("prefix")
        hist = hist.withColumn("upto", F.col("before") + F.sum("size").over(line))
        ends = F.col("upto") >= F.col("part")
        hist = hist.where(ends & (F.col("upto") - F.col("size") < F.col("part")) & (F.col("size") > 0))
        hist = materialise(hist.select("source", "part", "prefix", (F.col("upto") - F.col("size")).alias("before"), "size", "single"), "boundary", True)
        nearer = F.col("part") - F.col("before") > F.col("size") / 2
        single = F.col("single") | F.lit(shift == 0)
        done.append(hist.where(single).select("source", (F.shiftleft("prefix", shift) + F.when(nearer, (1 << shift) - 1).otherwise(-1)).alias("last")))
        open_ = hist.where(~single).select("source", "part", "prefix", "before")
        if shift == 0 or open_.isEmpty():
            break
        open_ = materialise(open_, "open", True)
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def _hash(id_: Column, text: Column) -> Column:
    """BITS bits of the MD5 of id, line feed and text; null counts as empty."""
    whole = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), limit: int = 3,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` and the columns ``carry`` per row of ``docs``.

    A document's size is its number of words (null: 0). A target of several times its source's size takes all its
    documents so many times over, and the rest of it those whose hash is up to the source's threshold, so ``taken`` is
    ``size`` times a whole number, ``limit`` at most, and reruns agree. The hash, a part of the MD5, is of id and text, so
    rows without an id or with a shared one are told apart. A source misses its target by at most half the document
    (rows that share id and text count as one) on which its budget ends. A null source is a source; sources of size 0
    have target 0. Other columns are not read. No rows, no result.
    """
    given = docs.select(
            *carry, F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _hash(F.col(id_col).cast("long"), F.col(text_col)).alias("h"),
        )
    sizes = materialise(given.select("doc_id", "source", "size", "h"), "sizes")
    targets = materialise(
        source_targets(sizes, weights, limit)
        .withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("part", F.col("target") - F.col("times") * F.col("source_size")),
        "targets",
        True,
    )
    cuts = _thresholds(sizes, targets.select("source", "part"))
    plan = materialise(targets.join(cuts.withColumnRenamed("source", "c"), F.col("source").eqNullSafe(F.col("c"))).drop("c", "part"), "plan", True)
    out = (given if carry else sizes).withColumnRenamed("source", "s").join(bounded_broadcast(plan), F.col("s").eqNullSafe(F.col("source")))
    out = out.withColumn("copies", F.col("times") + (F.col("h") <= F.col("last")).cast("long"))
    return out.select("doc_id", *carry, "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
