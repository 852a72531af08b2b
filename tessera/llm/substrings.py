"""Exact removal of repeated passages by super-k-mer partitioning over words."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_broadcast, discard, materialise, partitions, runs, small, texts

#: The filter of shared minimisers has at most so many bits (32 MB): a proven bound for what is broadcast.
FILTER_BITS = 28
#: A minimiser of more super-k-mers than this is hot and goes in parts of about so many. All tasks know which are hot, so
#: there are MOST_HOT at most (16 MB): past HOT * MOST_HOT shared super-k-mers (a TB or so of text) parts are larger.
HOT, MOST_HOT = 2000, 1_000_000


class _Hashes(dict):
    """XXH64 of a word, remembered; emptied before it grows large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 5)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def minimisers(docs: list[list[bytes]], window: int, gram: int, hashes: _Hashes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each document ``(value, first, last)`` of every run of consecutive windows with the same minimiser, the
    least hash of the ``gram``-word runs in a window; ``first`` and ``last`` are window starts. All documents are one
    array here, whose windows across a border are left out."""
    sizes = np.array([len(d) for d in docs])
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(docs)), np.uint64, int(sizes.sum()))
    begin, windows = np.cumsum(sizes) - sizes, np.maximum(sizes - window + 1, 0)
    out = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))] * len(docs)
    if not windows.any():
        return out
    g = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g += h[k : len(h) - gram + 1 + k]
    least, span, width = _mix(g), 1, window - gram + 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    for i in np.flatnonzero(windows):
        b, n = int(begin[i]), int(windows[i])
        new[b] = True
        first = np.flatnonzero(new[b : b + n])
        out[i] = (least[b + first], first, np.append(first[1:], n) - 1)
    return out


def _spots(mini, bits: int):
    """Three positions of a minimiser in a filter of 2**bits bits; numpy and Columns alike."""
    return [(mini >> s) & ((1 << bits) - 1) for s in (1, 17, 33)]


def _shared_filter(shared: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bits set for every shared minimiser. Past its bound the filter passes more than it must; never less."""
    bits = int(min(FILTER_BITS, max(16, np.ceil(np.log2(max(1, n) * 12)))))
    spot = F.explode(F.array(*[F.shiftright("mini", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (1, 17, 33)]))
    words = shared.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("word"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("word").to_numpy()
    return bits, out


def _passes(mini: np.ndarray, bits: int, words: np.ndarray) -> np.ndarray:
    ok = np.ones(len(mini), bool)
    for spot in _spots(mini, bits):
        ok &= (words[spot >> 6] >> (spot & 63) & 1).astype(bool)
    return ok


def _runs(batch, window: int, gram: int, hashes: _Hashes):
    """For each document of a batch with a known id and a window: ``(doc_id, tid, words, minis, first, last)``."""
    import zlib

    held, size = [], 0

    def flush():
        for (doc, tid, words), (mini, first, last) in zip(held, minimisers([x[2] for x in held], window, gram, hashes)):
            yield doc, tid, words, mini.view(np.int64), first, last

    for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
        words = text.split()
        if doc is not None and len(words) >= window:
            held.append((doc, zlib.crc32(text) - (1 << 31), words))
            size += len(words)
            if size > 100_000:
                yield from flush()
                held, size = [], 0
    yield from flush()


def _groups(batches):
    """Runs of rows with the same minimiser and salt, of sorted Arrow batches, that hold more than one document or are
    part of a hot minimiser's."""
    for run in runs(batches, ("mini", "salt")):
        if run[0]["doc_id"][0] != run[-1]["doc_id"][-1] or run[0]["salt"][0].as_py():
            yield pa.Table.from_batches(run)


def _windows(packed: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the word sequences of all windows of a packed string begin and end in it."""
    spaces = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).astype(np.int32)
    starts, ends = np.append(np.int32(0), spaces + np.int32(1)), np.append(spaces, np.int32(len(packed)))
    return starts[: len(starts) - window + 1], ends[window - 1 :]


def _repeats(group, window: int):
    """Rows ``(doc_id, tid, start, stop, digest)``: runs of window starts whose words also start in a smaller document
    of the group. The windows are sorted by a 128-bit digest of their words and then by document, so equal ones are
    neighbours; that their words are equal is checked. Windows are cut out of the packed strings when they are looked at, as
    all of them are some 50 times the text. A part of a hot minimiser's group also gives, with its digest,
    each window of the least document here that has it: whether another part has a smaller one is left to tell."""
    import xxhash

    docs, tids, starts = (group.column(c).to_numpy() for c in ("doc_id", "tid", "start"))
    part, packed = group.column("salt")[0].as_py() > 0, group.column("packed").to_pylist()
    found = [_windows(x, window) for x in packed]
    sizes = np.array([len(x) for x, _ in found])
    digests = bytearray()
    for text, (x, y) in zip(packed, found):
        digests += b"".join([xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(x.tolist(), y.tolist())])
    digest = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    row = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
    at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
    order = np.lexsort((docs[row], digest[:, 1], digest[:, 0]))
    digest, row, at = digest[order], row[order], at[order]
    cut_out = lambda i: packed[row[i]][found[row[i]][0][at[i]] : found[row[i]][1][at[i]]]
    new = np.ones(len(row), bool)
    new[1:] = (digest[1:] != digest[:-1]).any(1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    later = docs[row] > docs[row[first]]
    if part:
        for i in np.flatnonzero(~later):
            yield int(docs[row[i]]), int(tids[row[i]]), int(starts[row[i]] + at[i]), int(starts[row[i]] + at[i]) + 1, digest[i].tobytes()
    later = np.flatnonzero(later)
    for i, j in zip(later, first[later]):
        if cut_out(i) != cut_out(j):
            raise ArithmeticError("two word sequences have one 128-bit digest")
    row, at = row[later], at[later]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))) if len(row) else np.empty(0, int)
    for x, y in zip(cut.tolist(), np.append(cut[1:], len(row)).tolist()):
        r = row[x]
        yield int(docs[r]), int(tids[r]), int(starts[r] + at[x]), int(starts[r] + at[y - 1]) + 1, None


def _batch(rows: list, names: list[str], types: list):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)


def repeated_ranges(docs: DataFrame, window: int = 50, gram: int = 8, hot_from: int = HOT) -> DataFrame:
    """``(doc_id, tid, start, stop)``: runs of window starts in ``docs(doc_id, text)`` whose word sequence also starts in
    a document with a smaller doc_id. ``tid`` is the CRC of the text, which tells rows apart that share an id."""
    spark = docs.sparkSession

    def survey(batches):
        hashes = _Hashes()
        for b in small(batches):
            seen = [(doc, m) for doc, _, _, m, _, _ in _runs(b, window, gram, hashes)]
            if seen:
                mini = np.concatenate([m for _, m in seen])
                doc = np.repeat([d for d, _ in seen], [len(m) for _, m in seen])
                order = np.argsort(mini, kind="stable")
                mini, doc = mini[order], doc[order]
                at = np.concatenate([[0], np.flatnonzero(mini[1:] != mini[:-1]) + 1])
                n = np.diff(np.concatenate([at, [len(mini)]]))
                cols = [mini[at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at), n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["mini", "lo", "hi", "n"])

    # Which minimisers do several documents share? All others travel no further.
    counts = docs.mapInArrow(survey, "mini long, lo long, hi long, n long").groupBy("mini").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    shared = materialise(counts.where("lo < hi").select("mini", "n"), "shared", True)
    total, n_shared = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = max(hot_from, total / MOST_HOT)
    hot = shared.where(F.col("n") > most).select("mini", F.ceil(F.col("n") / most).cast("long").alias("parts")).orderBy("mini").toArrow()
    bits, words = _shared_filter(shared, n_shared)
    sent = spark.sparkContext.broadcast((bits, words, hot.column("mini").to_numpy(), hot.column("parts").to_numpy()))
    discard(shared)

    names, types = ["mini", "salt", "doc_id", "tid", "start", "packed"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def pack(batches):
        hashes, (bits, filt, hot, parts) = _Hashes(), sent.value
        for b in small(batches):
            rows = []
            for doc, tid, words, mini, first, last in _runs(b, window, gram, hashes):
                ok = _passes(mini, bits, filt)
                mini, first, last = mini[ok], first[ok], last[ok]
                salt = np.zeros(len(mini), np.int64)
                if len(hot) and len(mini):  # a hot minimiser's super-k-mers are dealt out by document
                    at = np.minimum(np.searchsorted(hot, mini), len(hot) - 1)
                    salt = np.where(hot[at] == mini, hash((doc, 11)) % parts[at] + 1, 0)
                rows += [(m, s, doc, tid, x, b" ".join(words[x : y + window])) for m, s, x, y in zip(mini.tolist(), salt.tolist(), first.tolist(), last.tolist())]
                if len(rows) > 20_000:
                    yield _batch(rows, names, types)
                    rows = []
            yield _batch(rows, names, types)

    out_names, out_types = ["doc_id", "tid", "start", "stop", "digest"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def sort_and_count(batches):
        rows = []
        for group in _groups(batches):
            for row in _repeats(group, window):
                rows.append(row)
                if len(rows) > 20_000:
                    yield _batch(rows, out_names, out_types)
                    rows = []
        yield _batch(rows, out_names, out_types)

    packed = docs.mapInArrow(pack, "mini long, salt int, doc_id long, tid int, start int, packed binary")
    packed = packed.repartition(partitions(spark), "mini", "salt").sortWithinPartitions("mini", "salt", "doc_id")
    found = materialise(packed.mapInArrow(sort_and_count, "doc_id long, tid int, start int, stop int, digest binary"), "found")
    marks = found.where("digest is null").drop("digest")
    if not hot.num_rows:
        return marks
    # At most one document for each window and part of a hot group is left: the least of them all stays unmarked.
    later = found.where("digest is not null").withColumn("least", F.min("doc_id").over(Window.partitionBy("digest"))).where("doc_id > least")
    return marks.union(later.select("doc_id", "tid", "start", "stop"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, hot_from: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text, n_words, n_removed, kept)`` and the columns ``carry`` per row: ``kept`` is the text's words, joined by one space, without
    those in a window of ``window`` words whose sequence also starts in a document with a smaller doc_id.

    Windows are judged on the input. Null texts have no words. Rows that share an id never repeat one another; a null
    id is neither smaller nor larger than any, so its row keeps all words and takes none from others. Other columns
    are not read. No rows, no result.
    """
    import zlib

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    found = repeated_ranges(given.select("doc_id", "text"), window, hot_from=hot_from)
    # All ranges of a row: as many as its words at most.
    ranges = found.distinct().groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    ranges = materialise(ranges.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tid", "ranges"))).alias("by_tid")), "by_doc", True)
    most = 300_000 if found.count() <= 1_000_000 else 0
    own = ["doc_id", "text", *carry]
    joined = given.where("doc_id is not null").join(bounded_broadcast(ranges, most), "doc_id", "left").select(*own, "by_tid")
    # Rows without an id lose nothing; in the join they would all be in one task.
    joined = joined.union(given.where("doc_id is null").select(*own, F.lit(None).cast(ranges.schema["by_tid"].dataType)))

    def run(batches):
        for b in small(batches):
            out = []
            for text, by_tid in zip(texts(b), b.column("by_tid").to_pylist()):
                words = text.split()
                gone = np.zeros(len(words), bool)
                for r in dict(by_tid or ()).get(zlib.crc32(text) - (1 << 31), ()):
                    gone[r["start"] : r["stop"] + window - 1] = True
                removed = int(gone.sum())
                out.append((len(words), removed, b" ".join(words if not removed else [words[i] for i in np.flatnonzero(~gone).tolist()])))
            n, removed, kept = zip(*out) if out else ((), (), ())
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*map(b.column, own), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), kept], [*own, "n_words", "n_removed", "kept"])

    schema = T.StructType([*given.schema.fields, *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])
    return joined.mapInArrow(run, schema)
