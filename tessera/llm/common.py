"""Shared pieces of the corpus operators: words, tables in the shared folder, learning splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise, new_path, shared_dir  # noqa: F401

#: A word is a run of anything but the ASCII white space below; ``bytes.split()`` cuts at exactly these.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_broadcast(table: DataFrame, most_rows: int = 300_000) -> DataFrame:
    """A hint to broadcast a materialised table of fixed-width rows, only if it has at most ``most_rows``; else it is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= most_rows else table


def partitions(spark: SparkSession) -> int:
    """How many partitions a repartition before CPU-bound Python code makes: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: str, of: int):
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text (crc32 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def small(batches, rows: int = 500, size: int = 8 << 20):
    """Arrow batches cut to few rows and bytes (or one row): what Python makes of a batch's texts is many times their size."""
    for b in batches:
        rest = [b.slice(at, rows) for at in range(0, b.num_rows, rows)][::-1]
        while rest:
            part = rest.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                rest += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def runs(batches, keys: tuple[str, ...]):
    """The rows with the same ``keys``, run by run, of sorted Arrow batches: a list of slices, as a run may begin in one batch
    and end in another. Slices are kept as they came, so a long run is copied by no batch that adds to it."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cut = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()
        for x, y in zip([0, *cut], [*cut, b.num_rows]):
            key = tuple(c[x] for c in columns)
            if held and key != last:
                yield held
                held = []
            held.append(b.slice(x, y - x))
            last = key
    if held:
        yield held


def texts(batch, column: str = "text") -> list[bytes]:
    """The UTF-8 texts of an Arrow batch; null is empty."""
    import pyarrow as pa

    i = batch.schema.get_field_index(column)
    return [x or b"" for x in batch.column(i).cast(pa.binary()).to_pylist()]


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``k`` words joined by one space, repeats included; fewer words: of the whole sequence; none: empty."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, seed)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - k + 1].tolist()
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)
