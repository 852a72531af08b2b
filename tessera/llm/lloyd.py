"""Delta Lloyd: k-means in exact integers whose rounds look only at what changed."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions

#: Vectors of a block, and blocks that one bucket should hold.
BLOCK, BLOCKS = 1024, 64
#: Scaled components beyond this are taken as this, so that a squared distance of 64 components is a long.
LARGEST = 1 << 27
STATE = "block long, owner binary, distance binary, inertia array<decimal(38,0)>, cluster int, n long, delta array<long>, kind int"


def kept_vectors(rows: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """``(vec_id, vec)``: vectors of exactly ``dims`` components, none null or non-finite, as doubles."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("vec") == dims) & ~F.coalesce(odd, F.lit(False)))


def to_integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors * scale), -LARGEST, LARGEST).astype(np.int32)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (longs) of each row to each centroid."""
    if not len(centroids):
        return np.empty((len(x), 0), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most * most * 4 * x.shape[1] < 1 << 53:  # every term and sum is exact in doubles, and BLAS has those
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids.astype(np.int64)], axis=1)


def reassign(x: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owner: np.ndarray, distance: np.ndarray):
    """New owners and distances. A vector whose owner stays in place meets the changed centroids only, as it was nearest
    to its owner of all others; one whose owner moved (or that has none: -1) meets all. Ties: the smaller number."""
    far = np.iinfo(np.int64).max
    lost = (owner < 0) | changed[owner]
    every = np.full((len(x), len(centroids)), far, np.int64)
    every[:, changed] = distances(x, centroids[changed])
    rest = np.flatnonzero(~changed)
    if len(rest):
        if lost.any():
            every[np.ix_(lost, rest)] = distances(x[lost], centroids[rest])
        still = np.flatnonzero(~lost)
        every[still, owner[still]] = distance[still]
    new = every.argmin(1)
    return new, every[np.arange(len(x)), new]


def _pack(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """Blocks ``(block, ids, vecs)`` of up to BLOCK vectors."""

    def run(batches):
        import pyarrow as pa

        part, at, ids, vecs, held = TaskContext.get().partitionId(), 0, [], [], 0

        def cut(n):
            nonlocal ids, vecs, held, at
            all_ids, x = [i for b in ids for i in b], np.concatenate(vecs)
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + at], pa.int64()), pa.array([all_ids[:n]], pa.list_(pa.int64())), pa.array([x[:n].tobytes()], pa.binary())], ["block", "ids", "vecs"])
            ids, vecs, at, held = [all_ids[n:]], [x[n:]], at + 1, held - n
            return out

        for b in batches:
            if b.num_rows:
                ids.append(b.column(0).to_pylist())
                vecs.append(to_integers(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale))
                held += b.num_rows
            while held >= BLOCK:
                yield cut(BLOCK)
        if held:
            yield cut(held)

    return vectors.mapInArrow(run, "block long, ids array<long>, vecs binary")


def _round(blocks: DataFrame, dims: int, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """A row of kind 0 for each block, with what it holds now; rows of kind 1: what a task's vectors take from a cluster
    (negative) or bring to it."""
    k = len(centroids)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("block", pa.int64()), ("owner", pa.binary()), ("distance", pa.binary()), ("inertia", pa.list_(pa.decimal128(38, 0))), ("cluster", pa.int32()), ("n", pa.int64()), ("delta", pa.list_(pa.int64())), ("kind", pa.int32())])
        count, delta = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["vecs"], np.int32).reshape(-1, dims)
                old = np.frombuffer(r["owner"], np.int32) if r["owner"] is not None else np.full(len(x), -1, np.int32)
                was = np.frombuffer(r["distance"], np.int64) if r["distance"] is not None else np.zeros(len(x), np.int64)
                new, near = reassign(x, centroids, changed, old, was)
                went = np.flatnonzero(new != old)
                left = went[old[went] >= 0]
                np.add.at(count, new[went], 1)
                np.subtract.at(count, old[left], 1)
                for c in range(k):
                    delta[c] += x[went[new[went] == c]].sum(0, dtype=np.int64) - x[left[old[left] == c]].sum(0, dtype=np.int64)
                inertia = [sum(near[new == c].tolist()) for c in range(k)]
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "owner": new.astype(np.int32).tobytes(), "distance": near.tobytes(), "inertia": inertia, "kind": 0}], schema)
        rows = [{"cluster": c, "n": int(count[c]), "delta": delta[c].tolist(), "kind": 1} for c in range(k) if count[c] or delta[c].any()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return blocks.mapInArrow(run, STATE)


def lloyd(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid``: k-means of the rows' vectors after ``rounds``.

    A vector's component x counts as floor(scale * x); distances, sums and centroids (floor(sum / count)) are exact
    integers. The first centroids are the k vectors with the smallest sha256 of ``<seed>:<id>``. Ties go to the smaller
    cluster number; a cluster without vectors keeps its centroid.

    The vectors are written once, in blocks, bucketed by block. Owners and distances are tables of their own, bucketed
    alike, so a round joins the two without a shuffle: it compares vectors with the centroids that changed, and with all
    where their own centroid did, writes the new owners and, from each task, the sums that went from one cluster to
    another; these signed transfers (at most k rows a task) update the global sums. Only k centroids reach the driver.
    Rounds end early when no centroid changes, as nothing would change any more. Blocks hold BLOCK vectors and fall on
    buckets by hash, so no group of equal vectors is ever in one task.

    Rows with other lengths, nulls or non-finite components are left out. Repeated rows are a vector each; a null id
    counts as empty text in the hash; of equal hashes the vector that is smaller comes first. Fewer than k vectors: as
    many clusters. No vectors: no rows. Components beyond LARGEST / scale count as that. Other columns are not read.
    """
    spark = rows.sparkSession
    vectors = kept_vectors(rows, id_col, vec_col, dims)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(order.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    out_schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], out_schema)
    centroids = to_integers(np.array([r.vec for r in first], np.float64), scale).astype(np.int64)
    k = len(centroids)
    buckets = min(100_000, max(partitions(spark), -(-rows.count() // (BLOCK * BLOCKS))))
    made: list[tuple[str, str]] = []

    def save(df: DataFrame, kinds: bool) -> DataFrame:
        name, path = f"tessera_{uuid.uuid4().hex}", new_path(spark, "lloyd")
        writer = df.write.partitionBy("kind") if kinds else df.write
        writer.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
        made.append((name, path))
        return spark.table(name)

    def forget(which: list[tuple[str, str]]) -> None:
        for name, path in which:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)

    blocks = save(_pack(vectors, dims, scale).repartition(buckets, "block"), False)
    state, sums = None, np.zeros((k, dims + 1), object)  # the last of a cluster's sums is how many vectors it has
    changed = np.ones(k, bool)
    for at in range(rounds + 1):
        if state is None:
            have = blocks.select("block", "vecs", F.lit(None).cast("binary").alias("owner"), F.lit(None).cast("binary").alias("distance"))
        else:
            have = blocks.select("block", "vecs").join(state.where("kind = 0").select("block", "owner", "distance").hint("shuffle_hash"), "block")
        state = save(_round(have, dims, centroids, changed), True)
        if len(made) > 2:
            forget([made.pop(1)])
        if at == rounds:
            break
        moved = state.where("kind = 1").select("cluster", F.posexplode(F.concat("delta", F.array("n"))).alias("i", "x"))
        for r in moved.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            sums[r.cluster][r.i] += int(r.x)
        new = np.array([[int(x // own[-1]) for x in own[:-1]] if own[-1] else centroids[c].tolist() for c, own in enumerate(sums)], np.int64)
        changed, centroids = (new != centroids).any(1), new
        if not changed.any():
            break
    of = state.where("kind = 0").agg(*[F.sum(F.get("inertia", F.lit(c))).cast("long").alias(f"c{c}") for c in range(k)]).first()
    own = [of[c] for c in range(k)]

    def spread(batches):
        import pyarrow as pa

        for b in batches:
            for ids, owner, distance in zip(*(b.column(i).to_pylist() for i in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.frombuffer(owner, np.int32)), pa.array(np.frombuffer(distance, np.int64))], ["vec_id", "cluster", "distance"])

    told = blocks.select("block", "ids").join(state.where("kind = 0").select("block", "owner", "distance").hint("shuffle_hash"), "block")
    out = told.select("ids", "owner", "distance").mapInArrow(spread, "vec_id long, cluster int, distance long")
    clusters = spark.createDataFrame([(c, own[c], sum(own), centroids[c].tolist()) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    path = new_path(spark, "lloyd")
    out.write.parquet(path)
    forget(made)
    done = spark.read.schema("vec_id long, cluster int, distance long").parquet(path)
    return done.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
