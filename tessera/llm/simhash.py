"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of a bucket are stored vertically, one 64-lane word per bit plane. A carry-save counter adds the
planes of (query xor stored) for 64 stored fingerprints at a time, and a word whose lanes all exceed the radius
is abandoned. Buckets come from blocking that loses no pair (``bands``), or from minimal shingles where the
radius is too wide for any blocking of bits (``anchors``); a hot bucket is cut into tiles that are compared two
by two, so no task holds an unbounded group, and a tile gives the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, materialise, partitions, runs, shingle_hashes, small, texts
from .components import connected_components, merge_labels

#: Fingerprints in a tile; pairs of tiles share a task's memory of a few MB.
TILE = 4096
#: Words of 64 lanes whose pairs are spelt out at a time (65,536 pairs, a few MB).
HITS = 1024
#: Shingles whose bits are counted at a time (3 MB).
SHINGLES = 10_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bits(x: np.ndarray) -> np.ndarray:
    """(n, 64): the bits of 64-bit numbers."""
    return np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit fingerprint for each array of shingle hashes: a bit is 1 if set in over half of them; none: 0."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes])
    at = 0
    while at < len(hashes):  # so many shingles at a time, as their bits are counted as int32; a longer text in pieces
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SHINGLES, "right")))
        keep = np.flatnonzero(sizes[at:to]) + at
        if len(keep):
            if sizes[at] > SHINGLES:
                ones = sum(_bits(hashes[at][k : k + SHINGLES]).sum(0, dtype=np.int64, keepdims=True) for k in range(0, sizes[at], SHINGLES))
            else:
                ones = np.add.reduceat(_bits(np.concatenate([hashes[i] for i in keep])), np.cumsum(sizes[keep]) - sizes[keep], axis=0, dtype=np.int32)
            out[keep] = np.packbits(ones * 2 > sizes[keep][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        at = to
    return out


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit planes of the fingerprints, 64 lanes a word, the last word padded with zero lanes."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(counter: list[np.ndarray], over: np.ndarray, carry: np.ndarray, bit: int) -> None:
    """Ripple ``carry`` of weight 2**bit into the bit-sliced counter; what leaves the top stays in ``over``."""
    for k in range(bit, len(counter)):
        counter[k], carry = counter[k] ^ carry, counter[k] & carry
    over |= carry


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius."""
    more, same = over.copy(), ~over
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def neighbours(a: np.ndarray, b: np.ndarray, radius: int, step: int = 256):
    """Yield arrays ``(i, j)`` of all pairs of ``a[i]``, ``b[j]`` with at most ``radius`` differing bits."""
    if len(a) * len(b) <= 64 * 64:  # less than a block of lanes: slicing costs more than it saves
        yield np.nonzero(np.bitwise_count(a[:, None] ^ b) <= radius)
        return
    planes, width = _planes(b), max(1, radius.bit_length())
    flips = np.where(np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool), FULL, np.uint64(0))
    words = planes.shape[1]
    for at in range(0, len(a), step):
        flip = flips[:, at : at + step]
        n = flip.shape[1]
        query, word = np.repeat(np.arange(n), words), np.tile(np.arange(words), n)
        counter = [np.zeros(n * words, np.uint64) for _ in range(width)]
        over = np.zeros(n * words, np.uint64)
        whole = True
        for p in range(0, 64, 4):
            if whole:
                x = [(planes[p + k][None, :] ^ flip[p + k][:, None]).reshape(-1) for k in range(4)]
            else:
                x = [planes[p + k][word] ^ flip[p + k][query] for k in range(4)]
            half = x[0] ^ x[1]  # carry-save: three planes give a sum and a carry, the fourth joins the sum
            one, two = half ^ x[2], (x[0] & x[1]) | (half & x[2])
            _add(counter, over, one, 0)
            _add(counter, over, x[3], 0)
            if width > 1:
                _add(counter, over, two, 1)
            else:
                over |= two
            if p % 8 == 4 and p >= max(12, 2 * radius - 8) and p < 60:
                live = np.flatnonzero(_exceeds(counter, over, radius) != FULL)
                if len(live) < 0.7 * len(query):
                    query, word, over, whole = query[live], word[live], over[live], False
                    counter = [c[live] for c in counter]
                    if not len(live):
                        break
        if not len(query):
            continue
        near = ~_exceeds(counter, over, radius)
        hits = np.flatnonzero(near)
        for k in range(0, len(hits), HITS):  # among near copies every lane is a hit: a million pairs a step
            hit = hits[k : k + HITS]
            lanes = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            i, j = query[hit[row]] + at, word[hit[row]] * 64 + lane
            ok = j < len(b)
            yield i[ok], j[ok]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct shingle hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFF)).astype(np.uint16)


def _may_reach(own: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of ``others`` may be so similar to ``own``; never leaves out one that is. Of each shingle hash its ``_low``
    bits are given; shingles count as shared where these are, which is as often or more often than they are."""
    size = np.array([len(x) for x in others])
    mark = np.zeros(1 << 16, bool)
    mark[own] = True
    shared = np.append(0, np.cumsum(mark[np.concatenate(others)], dtype=np.int32))
    end = np.cumsum(size)
    common = shared[end] - shared[end - size]
    rest = len(own) + size - common
    return (rest == 0) | (common >= similarity * (1 - 1e-9) * rest)


def _link_tile(ids, fps, own, radius, sets=None, similarity=0.0):
    """Star edges of the forest that the links of a tile form. ``own``: which of the two chunks a row is from.

    With ``sets``, a pair within the radius is a link only if its shingle sets are at least so similar; pairs that
    are joined already are not looked at again. A row's sets are compared with one pass over those it may be joined to,
    so only pairs that are similar, but for chance, are compared one by one.
    """
    label = np.arange(len(ids))
    low = [_low(x) for x in sets or ()]
    a = np.flatnonzero(own == own.min())
    b = np.flatnonzero(own != own.min())
    one = not len(b)
    b = a if one else b
    for i, j in neighbours(fps[a], fps[b], radius):
        i, j = a[i], b[j]
        i, j = i[(keep := i < j if one else i != j)], j[keep]
        if sets is None:
            merge_labels(label, i, j)
            continue
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        edges = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for x, y in zip(edges, np.append(edges[1:], len(i))):
            row, others = i[x], j[x:y]
            others = others[label[others] != label[row]]
            for at in range(0, len(others), 512):
                part = others[at : at + 512]
                if len(part) > 4:
                    part = part[_may_reach(low[row], [low[k] for k in part.tolist()], similarity)]
                for k in part.tolist():
                    if label[row] != label[k] and _jaccard(sets[row], sets[k]) >= similarity:
                        merge_labels(label, np.array([row]), np.array([k]))
    leaf = np.flatnonzero(label != np.arange(len(ids)))
    return ids[leaf], ids[label[leaf]]


def _tiles(batches, of_tile):
    """Call ``of_tile(table)`` for each run of rows with the same bucket and tile in sorted Arrow batches."""
    for run in runs(batches, ("bucket", "t0", "t1")):
        if len(run) > 1 or run[0].num_rows > 1:
            yield from of_tile(pa.Table.from_batches(run))


def _in_tiles(rows: DataFrame) -> DataFrame:
    """Deal rows ``(bucket, id, fp, ...)`` out by bucket; a bucket above TILE rows is cut into chunks, and each
    pair of its chunks is a tile. Buckets of one row can link nothing and go."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("id", "bucket"), F.col("c"))
    cut = (
        rows.join(sizes, "bucket")
        .withColumn("c", F.ceil(F.col("n") / TILE).cast("long"))
        .withColumn("own", F.when(F.col("c") > 1, own).otherwise(0).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("c") - 1).cast("int"))))
        .withColumns({"t0": F.least("own", "other"), "t1": F.greatest("own", "other")})
        .drop("n", "c", "other")
    )
    return cut.repartition(partitions(rows.sparkSession), "bucket", "t0", "t1").sortWithinPartitions("bucket", "t0", "t1")


def bands_for(n: int, radius: int) -> list[tuple[int, ...]]:
    """The bits of each band. Of k blocks, two fingerprints within the radius agree on k - radius at least, so every
    choice of k - radius blocks is a band: nothing is lost. k grows until a band tells n fingerprints apart."""
    k = radius + 1
    while k < radius + 4 and 64 * (k - radius) // k < np.log2(max(2, n)) - 8:
        k += 1
    cuts = [round(64 * i / k) for i in range(k + 1)]
    return [tuple(b for x in pick for b in range(cuts[x], cuts[x + 1])) for pick in combinations(range(k), k - radius)]


def _band_key(fp, bits: tuple[int, ...]):
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of each row's whole text, A-Z lower-cased; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for b in small(batches):
            fps = fingerprints([shingle_hashes(t.lower().split(), shingle_words) for t in texts(b)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def link_fingerprints(fps: DataFrame, radius: int) -> DataFrame:
    """``(fp, root)`` for every distinct ``fps.fp`` that has another within ``radius`` bits, by reachability."""
    bands = bands_for(fps.count(), radius)
    rows = fps.select(
        F.col("fp").alias("id"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("band"), _band_key(F.col("fp"), b).alias("value")) for i, b in enumerate(bands)])).alias("x"),
    ).select("id", F.xxhash64("x.band", "x.value").alias("bucket"))

    def run(batches):
        def of_tile(t):
            ids = t.column("id").to_numpy()
            u, v = _link_tile(ids, ids.view(np.uint64), t.column("own").to_numpy(), radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

        yield from _tiles(batches, of_tile)

    return connected_components(_in_tiles(rows).mapInArrow(run, "a long, b long")).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: documents whose fingerprints differ in ``radius`` bits or fewer are
    linked; ``component_id`` is the smallest doc_id reachable, itself included.

    Equal fingerprints meet in an aggregation before any comparison, so copies cost nothing more. Null or empty
    texts have fingerprint zero and are linked like any other. Repeated rows stay rows. A null doc_id keeps its row
    and names no component, unless no id there is known (then null). Other columns are not read. No rows, no result.
    """
    fps = materialise(fingerprint_documents(docs, id_col, text_col, shingle_words), "fps")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes", True)
    named = nodes.join(link_fingerprints(nodes, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, "named", True)
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "least", True)
    names = materialise(named.join(least, "root").select("fp", "component_id"), "names", True)
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


def _digest(words: list[bytes]) -> bytes:
    import hashlib

    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _sketch(docs: DataFrame, shingle_words: int, anchors: int) -> DataFrame:
    """``(doc_id, tid, digest, fp, anchors)``: of the lower-cased words; ``fp`` is of the distinct shingles, whose sets decide; ``anchors`` are minimal shingles under as many hashes."""
    salts = np.random.default_rng(7).integers(1, 2**63, anchors, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for b in small(batches):
            words = [t.lower().split() for t in texts(b)]
            hashes = [np.unique(shingle_hashes(w, shingle_words)) for w in words]
            picks = [[int(h[np.argmin(h * s ^ (h * s >> np.uint64(29)))].view(np.int64)) for s in salts] if len(h) else [] for h in hashes]
            digests = [_digest(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tid"), pa.array(digests, pa.binary()), pa.array(fingerprints(hashes).view(np.int64)), pa.array(picks, pa.list_(pa.int64()))],
                ["doc_id", "tid", "digest", "fp", "anchors"],
            )

    return docs.mapInArrow(run, "doc_id long, tid long, digest binary, fp long, anchors array<long>")


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """Rows ``(bucket, ...)`` with the size ``n`` of each bucket of two members or more, with its rows. Of buckets with the
    same members one stays: the count and two sums of hashes stand for the set."""
    members = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("s2")).where("n > 1")
    kept = members.groupBy("n", "s", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return rows.join(kept, "bucket")


def _buckets(rep: DataFrame) -> DataFrame:
    """``(bucket, id, fp)`` of classes ``(id, fp, anchors)``: a bucket for each anchor, whatever its size; ``_in_tiles`` deals
    out those that boilerplate makes large."""
    return materialise(_distinct_buckets(rep.select("id", "fp", F.explode("anchors").alias("bucket"))).select("bucket", "id", "fp"), "buckets", True)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 22, anchors: int = 8
) -> DataFrame:
    """``(doc_id, tid, component_id, component_tid)`` per row: documents are linked when the Jaccard similarity of their
    sets of word shingles is at least ``similarity``. ``tid`` hashes the text: it tells apart rows that share an id. The
    component is named by its smallest doc_id, and of rows that share it the smallest tid.

    Texts with the same lower-cased words are one class from the start. Two documents are compared where they share
    one of ``anchors`` minimal shingles, which a pair of the least similarity fails to do with probability
    (1 - similarity)**anchors (0.2**8 = 3e-6), however many others share it: a large bucket is compared tile by tile. Bit-sliced SimHash then leaves pairs within
    ``radius`` bits (a pair at 0.8 differs in 10 bits, one in 10,000 in over 20), and their shingle sets decide. Null and
    empty texts are copies of one another. Repeated rows stay rows; a null doc_id keeps its row and names a component
    (as null, with its tid) only where no row has an id. Other columns are not read. No rows, no result.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tid"))
    sketch = materialise(_sketch(given, shingle_words, anchors), "sketch")
    named = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")
    rep = materialise(sketch.groupBy("digest").agg(F.min(named).alias("least"), F.first("fp").alias("fp"), F.first("anchors").alias("anchors")).withColumn("id", F.xxhash64("digest")), "rep", True)
    rows = _buckets(rep.select("id", "fp", F.array_sort(F.array_distinct("anchors")).alias("anchors")))

    def partners(batches):
        def of_tile(t):
            ids, fps, own = (t.column(c).to_numpy() for c in ("id", "fp", "own"))
            near = np.zeros(len(ids), bool)
            a, b = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
            b = b if len(b) else a
            for i, j in neighbours(fps[a].view(np.uint64), fps[b].view(np.uint64), radius):
                i, j = a[i], b[j]
                near[i[i != j]] = near[j[i != j]] = True
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(t.column("bucket").to_numpy()[near])], ["id", "bucket"])

        yield from _tiles(batches, of_tile)

    # First by fingerprint alone: who has a partner at all. Only those bring their shingles.
    close = materialise(_in_tiles(rows).mapInArrow(partners, "id long, bucket long").distinct().join(rows, ["id", "bucket"]), "close", True)
    wanted = close.select("id").distinct().join(rep.select("id", F.col("digest").alias("want"), F.col("least.doc_id").alias("rep_id"), F.col("least.tid").alias("rep_tid")), "id")
    wanted = materialise(wanted, "wanted", True)

    def shingles(batches):
        for b in small(batches):
            sets = [np.unique(shingle_hashes(t.lower().split(), shingle_words)).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    # The row that stands for a class: by id and text, as ids may be null or shared.
    sets = given.join(bounded_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("tid") == F.col("rep_tid"))).select("id", "text")
    sets = materialise(sets.mapInArrow(shingles, "id long, shingles binary").groupBy("id").agg(F.max("shingles").alias("shingles")), "shingles")

    def links(batches):
        def of_tile(t):
            ids, fps, own = (t.column(c).to_numpy() for c in ("id", "fp", "own"))
            own_sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            u, v = _link_tile(ids, fps.view(np.uint64), own, radius, own_sets, similarity)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

        yield from _tiles(batches, of_tile)

    roots = connected_components(_in_tiles(close.join(sets, "id")).mapInArrow(links, "a long, b long"))
    discard(rows, close, wanted, sets)
    rooted = materialise(rep.select("digest", "least", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "named", True)
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component")), "least", True)
    names = materialise(rooted.join(least, "root").select("digest", "component"), "names", True)
    return sketch.join(names, "digest").select("doc_id", "tid", F.col("component.doc_id").alias("component_id"), F.col("component.tid").alias("component_tid"))
