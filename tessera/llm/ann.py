"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_broadcast, materialise, partitions

#: Rows of a bucket that meet queries at once; larger buckets are cut into chunks, each with all queries of the bucket.
CHUNK = 8192
#: Rows of a bucket, at most, if rows are evenly spread.
BUCKET = 8192
#: So few rows are compared at less cost than hashed.
FEW = 1000
#: Queries, at most, that tune the probes, and the recall they must reach.
TUNING, AIM = 64, 0.97
#: Probes a table, at most.
PROBES = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    n, width, h = *x.shape, 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width) / np.sqrt(width)


class Rotations:
    """``tables`` times ``hashes`` pseudo-rotations: three rounds of random signs and a Hadamard transform."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int = 17):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.tables, self.hashes, self.axes = tables, hashes, 2 * self.width
        self.signs = np.random.default_rng(seed + dim).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def scores(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """(hashes, n, axes): how near each unit vector is to every signed axis."""
        x = np.zeros((len(vectors), self.width))
        x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        out = []
        for signs in self.signs[table]:
            y = x
            for s in signs:
                y = hadamard(y * s)
            out.append(np.concatenate([y, -y], axis=1))
        return np.array(out)

    def bucket(self, vectors: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(vectors), np.int64)
        for s in self.scores(vectors, table):
            code = code * self.axes + s.argmax(1)
        return code

    def probes(self, vectors: np.ndarray, table: int, most: int) -> np.ndarray:
        """(n, most) buckets of each vector, the likeliest first. The likeliest of several hashes begin with the likeliest
        of the first ones, so only ``most`` are kept from hash to hash."""
        cost, code = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), np.int64)
        for s in self.scores(vectors, table):
            c = (s.max(1, keepdims=True) - s) ** 2
            cost = (cost[:, :, None] + c[:, None, :]).reshape(len(c), -1)
            code = (code[:, :, None] * self.axes + np.arange(self.axes)).reshape(len(c), -1)
            order = np.argsort(cost, axis=1, kind="stable")[:, :most]
            cost, code = np.take_along_axis(cost, order, 1), np.take_along_axis(code, order, 1)
        return code


def _vectors(column) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(x.flatten()).astype(np.float64).reshape(len(x), -1)


def nearest(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int):
    """Rows ``(query, id, distance, row)`` of each query's ``k`` nearest with another id, ties to the smaller id; rows that
    share an id count once, as the nearest of them. Products pick out what may be among them; the distances are those of
    the differences in double precision."""
    square = (vectors**2).sum(1)
    by_id = np.argsort(ids, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(ids[by_id]) != 0)) if len(ids) else np.empty(0, int)
    for at in range(0, len(queries), 512):
        q = queries[at : at + 512]
        rough = square[None, :] + (q**2).sum(1)[:, None] - 2 * q @ vectors.T
        rough[own[at : at + 512, None] == ids[None, :]] = np.inf
        least = np.minimum.reduceat(rough[:, by_id], start, axis=1) if len(start) < len(ids) else rough
        for i, row in enumerate(rough):
            bound = np.partition(least[i], k - 1)[k - 1] if len(start) > k else np.inf
            near = np.flatnonzero((row <= bound * (1 + 1e-9) + 1e-9 * (1 + square.max())) & np.isfinite(row))
            exact = np.sqrt(((vectors[near] - q[i]) ** 2).sum(1))
            order = np.lexsort((ids[near], exact))
            for j in order[np.sort(np.unique(ids[near[order]], return_index=True)[1])[:k]]:
                yield at + i, int(ids[near[j]]), float(exact[j]), int(near[j])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    line = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _truth(rows: DataFrame, queries: DataFrame, k: int):
    """Vectors of up to TUNING queries; for each of their true ``k`` nearest, by brute force over all rows, which query's
    it is and its vector."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(TUNING).toArrow()
    if not some.num_rows:
        return None
    q_ids, q = some.column("id").to_numpy(), _vectors(some.column("v"))

    def brute(batches):
        for b in batches:
            ids, v = b.column(0).to_numpy(), _vectors(b.column(1))
            out = [(int(q_ids[i]), d, s, v[row].tolist()) for i, d, s, row in nearest(q, ids, v, q_ids, k)] if len(ids) else []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))], ["query_id", "vec_id", "score", "v"])

    found = rows.mapInArrow(brute, "query_id long, vec_id long, score double, v array<double>").groupBy("query_id", "vec_id").agg(F.min_by("v", "score").alias("v"), F.min("score").alias("score"))
    line = Window.partitionBy("query_id").orderBy("score", "vec_id")
    true = found.withColumn("r", F.row_number().over(line)).where(F.col("r") <= k).select("query_id", "v").toArrow()
    if not true.num_rows:
        return None
    pos = {x: i for i, x in enumerate(q_ids.tolist())}
    return q, np.array([pos[x] for x in true.column("query_id").to_pylist()]), _vectors(true.column("v"))


def _tune(truth: tuple, rot: Rotations, of: int) -> int | None:
    """Probes a table, ``of`` at most, that find AIM of the true neighbours; none if ``of`` don't."""
    q, who, v = truth
    first = np.full(len(who), of)
    for t in range(rot.tables):
        order, code = rot.probes(q, t, of), rot.bucket(v, t)
        hit = order[who] == code[:, None]
        first = np.minimum(first, np.where(hit.any(1), hit.argmax(1), of))
    last = int(np.sort(first)[math.ceil(AIM * len(first)) - 1])
    return last + 1 if last < of else None


def hashes_for(n: int, axes: int) -> int:
    """Rotations a bucket: so many that a bucket of ``n`` evenly spread rows has BUCKET or less."""
    hashes = 1
    while n / axes**hashes > BUCKET:
        hashes += 1
    return hashes


def search(rows: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tables: int = 6, wider: int = 2) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query (default: rows whose id is divisible by 100) the ``k`` nearest
    rows found, by Euclidean distance of the original vectors, ties to the smaller id.

    Every row is hashed into one bucket a table: the signed axis nearest to its rotated unit vector, of as many rotations
    as keep evenly spread buckets small. Queries look into so many buckets a table as find nearly all true neighbours of
    a bounded sample of them; where PROBES don't do, tables are doubled, ``wider`` times, and at last all rows are compared.
    Only the buckets' rows are compared, exactly, in chunks that no bucket size outgrows. Few rows are all compared. Null ids, null vectors and those that are zero or hold nulls or non-finite
    numbers take no part; vectors meet only those of the same length. Rows that share an id count once, as the
    nearest of them, and never as their own neighbour. Other columns are not read.
    """
    spark, wide = rows.sparkSession, isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType)

    def clean(df):
        v = F.col(vector_col)
        known = df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>" if wide else "array<double>").alias("v")).where("id is not null and v is not null")
        fine = known.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        return fine.where(F.exists("v", lambda x: x != 0))

    given = clean(rows)
    asked = given.where(F.col("id") % 100 == 0) if queries is None else clean(queries)
    sizes = {r.d: r.n for r in given.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = None
    for dim, n in sorted(sizes.items()):
        one = _search(given.where(F.size("v") == dim), asked.where(F.size("v") == dim), dim, n, k, tables, wider)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _ranked(found, k)


def _search(rows: DataFrame, queries: DataFrame, dim: int, n: int, k: int, tables: int, wider: int) -> DataFrame:
    spark = rows.sparkSession
    rot = Rotations(dim, tables, 1)
    hashes, truth, probes = hashes_for(n, rot.axes), _truth(rows, queries, k) if n > FEW else None, None
    for step in range(wider + 1 if truth else 0):
        rot = Rotations(dim, tables << step, hashes)
        buckets = rot.axes**rot.hashes
        probes = _tune(truth, rot, min(buckets, PROBES))
        if probes is not None:
            break
    every = probes is None or probes >= buckets
    if every:  # all rows are one bucket of one table
        rot.tables = 1
    kind, store = ("binary", np.float32) if dict(rows.dtypes)["v"] == "array<float>" else ("binary", np.float64)

    def place(batches):
        for b in batches:
            v = _vectors(b.column(1))
            for t in range(rot.tables):
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(np.zeros(len(v), np.int64) if every else rot.bucket(v, t)), b.column(0), pa.array([x.tobytes() for x in v.astype(store)], pa.binary())], ["table", "bucket", "id", "v"])

    def probe(batches):
        for b in batches:
            v = _vectors(b.column(1))
            raw = pa.array([x.tobytes() for x in v.astype(store)], pa.binary())
            for t in range(rot.tables):
                for p in (np.zeros((1, len(v)), np.int64) if every else rot.probes(v, t, probes).T) if b.num_rows else ():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(np.ascontiguousarray(p)), b.column(0), raw], ["table", "bucket", "id", "v"])

    def meet(batches):
        for key, part in _runs(batches):
            side = part.column("side").to_numpy()
            own, ids = part.column("id").to_numpy()[side == 0], part.column("id").to_numpy()[side == 1]
            if not len(own) or not len(ids):
                continue
            v = np.frombuffer(b"".join(part.column("v").to_pylist()), store).reshape(len(side), dim).astype(np.float64)
            out = [(int(own[i]), d, s) for i, d, s, _ in nearest(v[side == 0], ids, v[side == 1], own, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    schema = f"table int, bucket long, id long, v {kind}"
    placed = materialise(rows.mapInArrow(place, schema), "placed")
    chunks = placed.groupBy("table", "bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunks = bounded_broadcast(materialise(chunks, "chunks", True))
    there = placed.join(chunks, ["table", "bucket"]).select("table", "bucket", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "id", "v")
    asked = queries.mapInArrow(probe, schema).join(chunks, ["table", "bucket"])
    asked = asked.select("table", "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "id", "v")
    key = ["table", "bucket", "chunk"]
    met = there.union(asked).repartition(partitions(spark), *key).sortWithinPartitions(*key, "side")
    return met.mapInArrow(meet, "query_id long, vec_id long, score double")


def _runs(batches):
    """Tables of the rows with the same table, bucket and chunk, from sorted Arrow batches."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if not part.num_rows:
            continue
        key = [part.column(c).to_numpy() for c in ("table", "bucket", "chunk")]
        edges = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1).tolist()]
        for x, y in zip(edges[:-1], edges[1:]):
            yield x, part.slice(x, y - x)
        rest = part.slice(edges[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield 0, rest
