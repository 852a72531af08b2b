"""Benchmark decontamination with DataFrame functions alone: SimHash of item-sized windows, a multi-index over blocks
of their bits, and exact weighted-shingle similarity of what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise

#: Two windows at similarity 0.8 differ in 10 of 64 bits; 25 bits or more are five standard deviations away.
RADIUS = 24


def _words(text: str) -> Column:
    """Lower-cased words; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _shingles(words: str, k: int) -> Column:
    """The runs of ``k`` words as an array of structs; empty, if there are fewer words."""
    n = f"greatest(size({words}) - {k - 1}, 0)"
    return F.expr(f"arrays_zip({', '.join(f'slice({words}, {i + 1}, {n})' for i in range(k))})")


def _hash(shingle: str, k: int) -> Column:
    return F.xxhash64(*[F.col(f"{shingle}.{i}") for i in range(k)])


def _exploded(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``keys``, position and hash of each shingle of ``rows(..., words)``."""
    return rows.select(*keys, F.posexplode(_shingles("words", k)).alias("pos", "s")).select(*keys, "pos", _hash("s", k).alias("h"))


def _least_overlap(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that n and m must share for the similarity: o / (n + m - o) >= s."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9).cast("int")


def fingerprint(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``fp``: SimHash of the rows ``(keys, h)``: a bit is 1 if set in over half of the hashes."""
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    bits = windows.groupBy(*keys).agg(F.count("*").alias("n_h"), *sums)
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.shiftleft((F.col(f"b{b}") * 2 > F.col("n_h")).cast("long"), b))
    return bits.select(*keys, fp.alias("fp"))


def block_masks(radius: int) -> list[int]:
    """Masks of radius + 1 blocks of the 64 bits, as signed longs: fingerprints within the radius agree on one at least."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    masks = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def multi_index(windows: DataFrame, items: DataFrame, radius: int, of: str | None = None) -> DataFrame:
    """Rows of ``windows(fp, size)`` with the ``item_id`` of each of ``items(item_id, item_fp, size)`` of the same size whose
    fingerprint is within the radius: all of them, each once. They meet where a block's bits are equal, and a pair is
    kept in the first such block only. ``of`` names a column of ``windows`` with the one item that a window may meet."""
    masks = block_masks(radius)

    def blocks(fp):
        return F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.col(fp).bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]))

    left = windows.withColumn("block", blocks("fp"))
    right = items.select("item_id", "item_fp", F.col("size").alias("item_size"), blocks("item_fp").alias("item_block"))
    same = (F.col("size") == F.col("item_size")) & (F.col("block") == F.col("item_block"))
    met = left.join(right, same if of is None else same & (F.col(of) == F.col("item_id")))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)])
    return met.where((F.bit_count(differ) <= radius) & (first == F.col("block.no"))).withColumn("distance", F.bit_count(differ)).drop("block", "item_block", "item_size", "item_fp")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shingle_words: int = 5, similarity: float = 0.8, radius: int = RADIUS,
) -> DataFrame:
    """``(doc_id, tid, item_id, start, n_words, similarity, distance)``: each document with each item that a window of it,
    as many words long as the item (the whole document, if shorter), resembles: the most similar window, the first of
    equals. ``tid`` hashes the text, ``start`` counts words from 0.

    The similarity is the weighted Jaccard of the multisets of ``shingle_words``-word shingles, lower-cased. A window
    that reaches it shares a known number of shingles with the item, and still does when moved on to where the first
    of these begins; so the windows to fingerprint begin at a shared shingle that is followed closely by enough others.
    Items of fewer words than a shingle are found as equal runs of words. Null or blank items and documents match
    nothing. Repeated rows, of documents or items, give one row. A null id is an id. Other columns are not read.
    """
    k = shingle_words
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    given = given.select("doc_id", F.xxhash64("text").alias("tid"), _words("text").alias("words"))
    items = materialise(benchmark.select(F.col(item_col).cast("long").alias("item_id"), _words(item_text_col).alias("item_words")).where("size(item_words) > 0").distinct(), "items", True)
    long_items = items.where(F.size("item_words") >= k).withColumn("item_no", F.xxhash64("item_id", "item_words"))
    item_shingles = _exploded(long_items.select("item_no", F.col("item_words").alias("words")), ["item_no"], k)
    item_counts = materialise(item_shingles.groupBy("item_no", "h").agg(F.count("*").alias("n_item")), "item_counts", True)
    size = materialise(
        fingerprint(item_shingles, ["item_no"]).withColumnRenamed("fp", "item_fp").join(long_items.select("item_no", "item_id", (F.size("item_words") - (k - 1)).alias("size")), "item_no"),
        "item_sizes",
        True,
    )
    key = ["doc_id", "tid"]

    # Where does a document share shingles with an item, and where closely enough?
    places = given.select(*key, F.size("words").alias("n_doc"), F.posexplode(_shingles("words", k)).alias("pos", "s")).select(*key, "n_doc", "pos", _hash("s", k).alias("h"))
    anchors = places.join(bounded_broadcast(item_counts.select("h", "item_no")), "h")
    anchors = anchors.groupBy(*key, "item_no").agg(F.max("n_doc").alias("n_doc"), F.sort_array(F.collect_set("pos")).alias("at"))  # a document's positions at most
    anchors = anchors.join(bounded_broadcast(size.select("item_no", "size")), "item_no").withColumn("n_doc", F.col("n_doc") - (k - 1))
    anchors = anchors.withColumn("span", F.least("size", "n_doc")).withColumn("need", _least_overlap(F.col("size"), F.col("span"), similarity))
    starts = F.expr("transform(filter(sequence(1, size(at) - need + 1), i -> at[i + need - 2] - at[i - 1] < span), i -> least(at[i - 1], n_doc - span))")
    windows = anchors.where("size(at) >= need").select(*key, "item_no", "size", "span", F.explode(F.array_distinct(starts)).alias("start"))
    windows = materialise(windows, "windows", True)

    # Their shingles, once more from the text: only of documents that have such windows.
    texts = given.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), "words").join(
        bounded_broadcast(materialise(windows.select(*key).distinct(), "suspects", True)), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid")), "left_semi"
    )
    hashes = texts.groupBy("d", "t").agg(F.first("words").alias("words")).select("d", "t", F.transform(_shingles("words", k), lambda s: F.xxhash64(*[s[str(i)] for i in range(k)])).alias("hs"))
    own = [*key, "size", "span", "start"]
    inside = windows.select(*own).distinct().join(hashes, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")))
    inside = inside.select(*own, F.explode(F.slice("hs", F.col("start") + 1, F.col("span"))).alias("h"))
    inside = materialise(inside.groupBy(*own, "h").agg(F.count("*").alias("n_window")), "inside", True)
    repeated = inside.withColumn("h", F.explode(F.array_repeat("h", F.col("n_window").cast("int"))))
    prints = materialise(fingerprint(repeated, own), "prints", True)

    # A window meets the items whose shingles it begins with and no others of its size.
    same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) if c == "doc_id" else F.col(f"{x}.{c}") == F.col(f"{y}.{c}") for c in own]
    meeting = prints.alias("p").join(windows.alias("w"), same("p", "w")).select("p.*", "w.item_no")
    found = multi_index(meeting, bounded_broadcast(size.select(F.col("item_no").alias("item_id"), "item_fp", "size")), radius, of="item_no").drop("item_id")
    found = materialise(found.drop("fp"), "pairs", True)
    shared = found.alias("f").join(inside.alias("i"), same("f", "i")).select("f.*", "i.h", "i.n_window").join(bounded_broadcast(item_counts), ["item_no", "h"])
    shared = shared.groupBy(*own, "item_no", "distance").agg(F.sum(F.least("n_window", "n_item")).alias("o"))
    alike = F.col("o") / (F.col("size") + F.col("span") - F.col("o"))
    alike = shared.withColumn("similarity", alike).where(F.col("similarity") >= similarity).join(bounded_broadcast(size.select("item_no", "item_id")), "item_no")
    best = F.row_number().over(Window.partitionBy(*key, "item_id").orderBy(F.desc("similarity"), "start", "span"))
    out = alike.withColumn("best", best).where("best = 1").select(*key, "item_id", "start", (F.col("span") + (k - 1)).alias("n_words"), "similarity", "distance")

    lengths = [r.n for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < k).distinct().orderBy("n").collect()]
    if lengths:
        short = items.where(F.size("item_words") < k).select("item_id", F.size("item_words").alias("n"), F.xxhash64("item_words").alias("h"))
        runs = lambda n: F.transform(_shingles("words", n), lambda s, i: F.struct(F.lit(n).alias("n"), i.alias("pos"), F.xxhash64(F.array(*[s[str(j)] for j in range(n)])).alias("h")))
        places = given.select(*key, F.explode(F.concat(*map(runs, lengths))).alias("x")).select(*key, "x.*")
        runs = places.join(bounded_broadcast(materialise(short, "short", True)), ["n", "h"]).groupBy(*key, "item_id", "n").agg(F.min("pos").alias("start"))
        out = out.union(runs.select(*key, "item_id", "start", F.col("n").alias("n_words"), F.lit(1.0).alias("similarity"), F.lit(0).alias("distance")))
    return out
