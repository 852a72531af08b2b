"""Katz backoff language model over words, with Good-Turing discounts and exactly normalised backoff weights.

Unigram and bigram counts cover every training token; unseen words share what the discounts set aside, so the model is a
distribution over an open vocabulary. Every task knows the commonest words by short ids; all others go by 62 bits of a
hash, and their unigram counts are joined to where they follow a history. Counts are tables in the shared folder, dealt
out by history, a history of very many tokens by its followers too; documents are scored where the counts of their
histories and words are, and only sums travel back.

With a ``vocabulary`` given, bigrams are counted between so many of the commonest words only: all other words, seen or
not, are one class there, whose share is divided among its members by their discounted unigram counts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, materialise, partitions, small, texts

#: Class of words outside a given vocabulary, and the history of a text's first token; word ids start after these, codes
#: of words without an id at HASHED.
RARE, BEGIN, FIRST, HASHED = 0, 1, 2, 1 << 62
#: Words, at most, that have an id if no vocabulary is given.
CACHE = 1 << 18
#: The token that ends a text; no word is empty.
END = b""
#: Where codes are numbered, a bigram is history << SHIFT | word. Counts up to MOST_DISCOUNTED are discounted.
SHIFT, MOST_DISCOUNTED = 31, 5
LOW = (1 << SHIFT) - 1
#: Tokens that a task gathers before it sends them off.
CHUNK = 2_000_000


def discounts(of_counts: dict[int, int], most: int = MOST_DISCOUNTED) -> np.ndarray:
    """d[r] for r = 0..most (d[0] unused), by Katz from counts of counts; where Good and Turing give no ratio in (0, 1),
    as on little data, r - 1/2 of r."""
    r = np.arange(most + 1)
    fallback = np.where(r > 0, 1 - 0.5 / np.maximum(r, 1), 1.0)
    n = np.array([of_counts.get(i, 0) for i in range(most + 2)], float)
    if not n[1:].all():
        return fallback
    common = (most + 1) * n[most + 1] / n[1]
    ratio = np.append(1.0, (r[1:] + 1) * n[2:] / (r[1:] * n[1:-1]))
    d = (ratio - common) / (1 - common) if common != 1 else fallback
    return np.where((d > 0) & (d < 1) & (r > 0), d, fallback)


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


class _Codes(dict):
    """Codes of words: their ids; of others by hash."""

    def __init__(self, words: list[bytes]):
        import xxhash

        super().__init__((w, i + FIRST) for i, w in enumerate(words))
        self.hash = xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        return self.hash(word, 42) >> 2 | HASHED


def _code(token):
    """The code by hash as a column."""
    return F.shiftrightunsigned(F.xxhash64(token), 2).bitwiseOR(F.lit(HASHED))


class Unigrams:
    """What every task knows of the unigram model: words with ids, their counts and probabilities, of bounded size."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, of_counts: dict[int, int], classed: bool):
        self.words, self.n, self.v, self.d, self.classed = words, n, v, discounts(of_counts), classed
        small = {r: c for r, c in of_counts.items() if r <= MOST_DISCOUNTED}
        aside = sum((1 - self.d[r]) * r * c for r, c in small.items())
        self.whole = n if aside else n + 1  # something is always set aside for unseen words
        self.unseen = (aside or 1) / self.whole
        self.p = np.empty(FIRST + len(words))
        self.p[FIRST:] = _discounted(counts, self.d) / self.whole
        self.p[BEGIN] = 0.0
        self.p[RARE] = max(self.unseen, 1 - self.p[FIRST:].sum())
        self.counts = counts

    def codes(self) -> _Codes:
        return _Codes(self.words)

    def of_count(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words that occur so often."""
        return np.where(c == 0, self.unseen, _discounted(c, self.d) / self.whole)

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def hot(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Histories of over half the tokens that a bucket has on average, sorted, and into how many parts their followers
        go; twice as many as there are buckets at most."""
        texts = self.counts[self.words.index(END)] if END in self.words else 0  # the texts' first tokens follow BEGIN
        counts = np.concatenate([[self.n - self.counts.sum() if self.classed else 0, texts], self.counts])
        parts = np.minimum(buckets, np.ceil(counts * 2 * buckets / max(1, self.n)).astype(np.int64))
        return np.flatnonzero(parts > 1), parts[parts > 1]

    def of(self, word: np.ndarray, rare: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probabilities of codes. ``rare``, ``count``: sorted codes by hash, with all that are in ``word``, and their counts."""
        hashed = word >= HASHED
        out = self.p[np.where(hashed, RARE, word)]
        if hashed.any():
            out[hashed] = (_discounted(count, self.d) / self.whole)[np.searchsorted(rare, word[hashed])]
        return out


class _Sent:
    """A unigram model that all tasks have. What is broadcast is plain data, as a class is found only by its path there."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self) -> Unigrams:
        model = Unigrams.__new__(Unigrams)
        model.__dict__.update(self.broadcast.value)
        return model


def _sums(history: np.ndarray, p: np.ndarray, count: np.ndarray, d: np.ndarray):
    """Of bigrams sorted by history: where each history starts, the number of each bigram's, and by history the sums of
    counts, of discounted counts and of the unigram probabilities ``p`` of its followers."""
    start = np.flatnonzero(np.append(True, history[1:] != history[:-1])) if len(history) else np.empty(0, int)
    own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(history))))
    return start, own, *(np.bincount(own, weights=x, minlength=len(start)) for x in (count, _discounted(count, d), p))


def _weights(total: np.ndarray, kept: np.ndarray, p: np.ndarray):
    """From sums by history: the total to divide by, log10 of the backoff weight, and whether every word has followed it.
    What the followers leave is shared by the unigram probabilities of all others, so the two parts sum to one. A history
    whose counts leave nothing counts one event more; one that every word has followed keeps its counts whole."""
    every = 1 - p < 1e-9
    left = np.where(every, 0.0, total - kept)
    none = ~every & (left < 1e-9 * np.maximum(total, 1))
    total, left, others = np.where(none, total + 1, total), np.where(none | every, 1.0, left), np.where(every, 1.0, 1 - p)
    return total, np.log10(left / total / others), every


def backoff(history: np.ndarray, p: np.ndarray, count: np.ndarray, d: np.ndarray, hot: np.ndarray | None = None):
    """Per bigram, sorted by history, ``p`` its word's unigram probability: log10 of its discounted probability; sorted
    histories, log10 of their backoff weights. ``hot``: sorted rows (history, total, kept, p) of the sums of histories
    whose followers are not all here."""
    start, own, *sums = _sums(history, p, count, d)
    histories, sums = history[start], np.array(sums)
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot["history"], histories), len(hot) - 1)
        known = hot["history"][at] == histories
        for x, name in zip(sums, ("total", "kept", "p")):
            x[known] = hot[name][at[known]]
    total, log_alpha, every = _weights(*sums)
    log_p = np.log10(np.where(every[own], count, _discounted(count, d)) / total[own])
    if hot is not None and len(hot):  # those without any follower here
        more = np.setdiff1d(hot["history"], histories)
        rows = hot[np.searchsorted(hot["history"], more)]
        at = np.searchsorted(histories, more)
        histories, log_alpha = np.insert(histories, at, more), np.insert(log_alpha, at, _weights(rows["total"], rows["kept"], rows["p"])[1])
    return log_p, histories, log_alpha


def _pack(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(x.tobytes(), asbytes=True)


def _unpack(blob: bytes, n: int, kind) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec("zstd").decompress(blob, size, asbytes=True), kind) if n else np.empty(0, kind)


def _pack_pairs(history: np.ndarray, word: np.ndarray) -> bytes:
    """Of pairs sorted by history, then word: differences, small numbers, byte by byte, which compress well."""
    gaps = word.copy()
    gaps[1:] -= np.where(history[1:] == history[:-1], word[:-1], 0)
    return _pack(np.ascontiguousarray(np.concatenate([np.diff(history, prepend=np.int64(0)), gaps]).view(np.uint8).reshape(-1, 8).T))


def _unpack_pairs(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(_unpack(blob, 16 * n, np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]
    history, word = np.cumsum(both[:n]), np.cumsum(both[n:])  # sums of words may wrap, their differences are right
    start = np.flatnonzero(np.append(True, history[1:] != history[:-1]))
    before = word[start] - both[n:][start]
    return history, word - np.repeat(before, np.diff(np.append(start, n)))


class _Deal:
    """Where bigrams are: the bucket of their history, of hot ones a bucket for each part of their followers."""

    def __init__(self, buckets: int, hot: np.ndarray, parts: np.ndarray):
        self.buckets, self.hot, self.parts = buckets, hot, parts

    def split(self, history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by bucket that leaves rows of a bucket in theirs, and where each bucket's begin and end."""
        bucket = history % self.buckets
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, history), len(self.hot) - 1)
            part = ((word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % self.parts[at]
            bucket = np.where(self.hot[at] == history, (bucket + part) % self.buckets, bucket)
        bucket = bucket.astype(np.uint16 if self.buckets <= 1 << 16 else np.int32)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(self.buckets + 1))


def count_tokens(train: DataFrame) -> DataFrame:
    """``(token, c)`` of all training texts, the end of each included."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
            seen.clear()

        for b in small(batches):
            for t in texts(b):
                seen.update(t.lower().split())
                seen[END] += 1
                if len(seen) > 300_000:
                    yield from flush()
        yield from flush()

    return train.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def unigrams(counts: DataFrame, vocabulary: int | None) -> tuple[Unigrams, int]:
    """The unigram model and the least count of a word with an id. Counts of counts have at most sqrt(2 N) rows."""
    by = sorted((r.c, r.n) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect())
    n, v, least, words = sum(c * k for c, k in by), sum(k for _, k in by), 1, 0
    for c, k in reversed(by):
        if words + k > (CACHE if vocabulary is None else vocabulary):
            least = c + 1
            break
        words += k
    hot = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "token").toArrow()
    return Unigrams([t.encode() for t in hot.column("token").to_pylist()], hot.column("c").to_numpy(), n, v, dict(by), vocabulary is not None), least


def _chunks(batches, codes: _Codes):
    """Chunks ``(codes, numbers, lengths, doc_ids, held_out)`` of the texts of batches ``(doc_id, text, held_out)``: sorted
    distinct codes; BEGIN, the words and the end of each text, end to end, as numbers of these; how many each text has."""
    get, docs, held, parts, size = codes.__getitem__, [], [], [], 0
    end = get(END)

    def chunk():
        known, number = np.unique(np.concatenate(parts), return_inverse=True)
        return known, number, np.array([len(x) for x in parts]), docs, held

    for b in small(batches):
        for doc, text, out in zip(b.column(0).to_pylist(), texts(b), b.column(2).to_pylist()):
            words = text.lower().split()
            seq = np.empty(len(words) + 2, np.int64)
            seq[0], seq[-1] = BEGIN, end
            seq[1:-1] = np.fromiter(map(get, words), np.int64, len(words))
            parts.append(seq)
            docs.append(doc)
            held.append(out)
            size += len(words)
            if size > CHUNK:
                yield chunk()
                docs, held, parts, size = [], [], [], 0
    if parts:
        yield chunk()


def _pairs(known: np.ndarray, number: np.ndarray, lengths: np.ndarray, classed: bool):
    """Sorted distinct codes, where words without an id are one class if ``classed``; the bigrams of numbers of these, and
    the document of each."""
    if classed:
        known, again = np.unique(np.where(known >= HASHED, RARE, known), return_inverse=True)
        number = again[number]
    ends = np.cumsum(lengths)
    first, last = np.ones(len(number), bool), np.ones(len(number), bool)
    first[ends - 1] = False
    last[np.append(0, ends[:-1])] = False
    return known, number[first] << SHIFT | number[last], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths - 1)


def _sum_pairs(history: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((word, history))
    history, word, counts = history[order], word[order], counts[order]
    at = np.flatnonzero(np.append(True, (history[1:] != history[:-1]) | (word[1:] != word[:-1])))
    return history[at], word[at], np.add.reduceat(counts, at)


def count_bigrams(train: DataFrame, model, deal: _Deal) -> DataFrame:
    """``(bucket, n, keys, counts, of_counts)``: sorted distinct bigrams of a bucket of histories and their counts, one
    row a bucket; ``of_counts[r]`` bigrams of it occur r times."""

    def run(batches):
        own = model.value.codes()
        for known, number, lengths, *_ in _chunks(batches, own):
            codes, pairs, _ = _pairs(known, number, lengths, model.value.classed)
            pairs, n = np.unique(pairs, return_counts=True)
            history, word = codes[pairs >> SHIFT], codes[pairs & LOW]
            order, cut = deal.split(history, word)
            history, word, n = history[order], word[order], n[order].astype(np.int32)
            rows = [(i, int(y - x), _pack_pairs(history[x:y], word[x:y]), _pack(n[x:y])) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "n", "keys", "counts"])

    def merge(batches):
        now, parts = None, []

        def total():
            return _sum_pairs(*map(np.concatenate, zip(*parts)))

        def row():
            h, w, c = total()
            of = np.bincount(np.minimum(c, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[: MOST_DISCOUNTED + 2]
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([_pack_pairs(h, w)], pa.binary()), pa.array([_pack(c)], pa.binary()), pa.array([of.tolist()], pa.list_(pa.int64()))],
                ["bucket", "n", "keys", "counts", "of_counts"],
            )

        for b in batches:
            for bucket, n, k, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                if now is not None and bucket != now:
                    yield row()
                    parts = []
                now = bucket
                parts.append((*_unpack_pairs(k, n), _unpack(c, n, np.int32).astype(np.int64)))
                if sum(len(x[0]) for x in parts) > 4_000_000 + 2 * len(parts[0][0]):  # what is held stays near the distinct ones
                    parts = [total()]
        if now is not None:
            yield row()

    sent = train.mapInArrow(run, "bucket int, n long, keys binary, counts binary")
    dealt = sent.repartition(min(deal.buckets, partitions(train.sparkSession)), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "bucket int, n long, keys binary, counts binary, of_counts array<long>")


def _packed_counts(rows: DataFrame) -> DataFrame:
    """``(bucket, n, keys, counts)`` from rows ``(bucket, code, c)``: packed, in rows of bounded size."""

    def pack(batches):
        for b in batches:
            bucket, words, c = (b.column(i).to_numpy() for i in range(3))
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            out = [(int(bucket[x]), y - x, _pack(words[x:y]), _pack(c[x:y])) for x, y in zip(edges[:-1], edges[1:]) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "n", "keys", "counts"])

    dealt = rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(pack, "bucket int, n long, keys binary, counts binary")


def _rare_followers(bigrams: DataFrame, rare: DataFrame) -> DataFrame:
    """``(bucket, n, keys, counts)``: the words by hash that follow a history of a bucket, and their unigram counts."""

    def followers(batches):
        for b in batches:
            for bucket, n, keys in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = np.unique((w := _unpack_pairs(keys, n)[1])[w >= HASHED])
                for at in range(0, len(words), 100_000):
                    part = words[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket, np.int32)), pa.array(part)], ["bucket", "code"])

    there = bigrams.select("bucket", "n", "keys").mapInArrow(followers, "bucket int, code long")
    return _packed_counts(there.join(rare, "code").select("bucket", "code", "c"))


#: What comes to a bucket, in this order: counts of words that follow its histories, its bigrams, questions about bigrams,
#: counts of its own words, questions about words, and who the documents of a chunk are.
FOLLOWERS, BIGRAMS, ASK_BIGRAMS, WORDS, ASK_WORDS, WHO = range(6)


class _Counts:
    """Counts of words by hash, gathered in parts."""

    def __init__(self):
        self.parts, self.sorted = [], None

    def add(self, n: int, keys: bytes, counts: bytes):
        self.parts.append((_unpack(keys, n, np.int64), _unpack(counts, n, np.int64)))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        if self.sorted is None:
            codes, counts = map(np.concatenate, zip(*self.parts)) if self.parts else (np.empty(0, np.int64),) * 2
            order = np.argsort(codes)
            self.sorted = codes[order], counts[order]
        return self.sorted

    def of(self, words: np.ndarray) -> np.ndarray:
        codes, counts = self.table()
        if not len(codes):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(codes, words), len(codes) - 1)
        return np.where(codes[at] == words, counts[at], 0)


def _hot_sums(stored: DataFrame, model, d2: np.ndarray, deal: _Deal) -> np.ndarray:
    """Rows ``(history, total, kept, p)``, sorted: the sums of hot histories over the buckets that have their followers."""
    kind = np.dtype([("history", np.int64), ("total", float), ("kept", float), ("p", float)])
    if not len(deal.hot):
        return np.empty(0, kind)

    def run(batches):
        now, found = None, _Counts()
        for b in batches:
            for bucket, side, n, keys, other in zip(*(b.column(i).to_pylist() for i in range(5))):
                if bucket != now:
                    now, found = bucket, _Counts()
                if side == FOLLOWERS:
                    found.add(n, keys, other)
                    continue
                history, word = _unpack_pairs(keys, n)
                mine = np.isin(history, deal.hot)
                history, word, count = history[mine], word[mine], _unpack(other, n, np.int64)[mine]
                start, _, total, kept, p = _sums(history, model.value.of(word, *found.table()), count, d2)
                yield pa.RecordBatch.from_arrays([pa.array(history[start]), *(pa.array(x, pa.float64()) for x in (total, kept, p))], list(kind.names))

    dealt = stored.repartition(partitions(stored.sparkSession), "bucket").sortWithinPartitions("bucket", "side")
    sums = dealt.select("bucket", "side", "n", "keys", "other").mapInArrow(run, "history long, total double, kept double, p double")
    got = sums.groupBy("history").agg(*[F.sum(c).alias(c) for c in ("total", "kept", "p")]).orderBy("history").collect()
    return np.array([tuple(r) for r in got], kind)


def _scored(docs: DataFrame, stored: DataFrame, model, d2: np.ndarray, deal: _Deal, hot) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, base, lp)`` per row of ``docs``. A chunk of documents sums what all tasks know of its words, and asks
    each bucket once for all its tokens: of histories for what the history adds to a token's unigram log probability (the
    ratio of bigram to unigram where the bigram was seen, the backoff weight where not), of words for the unigrams of
    those without an id. It gets packed lists of sums by document."""

    def ask(batches):
        from pyspark import TaskContext

        m, chunk = model.value, (TaskContext.get().partitionId() + 1) << 24
        own, log_p, base_of = m.codes(), np.log10(np.maximum(m.p, 1e-300)), m.log_base(m.counts)
        for known, number, lengths, docs, held in _chunks(batches, own):
            chunk += 1
            codes, pairs, doc = _pairs(known, number, lengths, m.classed)
            order = np.argsort(pairs)
            history, word, doc = codes[pairs[order] >> SHIFT], codes[pairs[order] & LOW], doc[order]
            order, cut = deal.split(history, word)
            history, word, doc = history[order], word[order], doc[order]
            rows = [(i, ASK_BIGRAMS, int(y - x), _pack_pairs(history[x:y], word[x:y]), _pack(doc[x:y])) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]

            doc = np.repeat(np.arange(len(lengths)), lengths)
            rare, hot_word = known[number] >= HASHED, (known[number] >= FIRST) & (known[number] < HASHED)
            at, of = known[number[hot_word]], doc[hot_word]
            sums = [np.bincount(of, weights=w, minlength=len(lengths)) for w in (np.ones(len(of)), base_of[at - FIRST], log_p[at])]
            asked, times = np.unique(number[rare] * len(lengths) + doc[rare], return_counts=True)
            word, doc = known[asked // len(lengths)], asked % len(lengths)
            bucket = word % deal.buckets
            order = np.argsort(bucket, kind="stable")
            word, doc, times, cut = word[order], doc[order].astype(np.int32), times[order].astype(np.int32), np.searchsorted(bucket[order], np.arange(deal.buckets + 1))
            rows += [(i, ASK_WORDS, int(y - x), _pack(word[x:y]), _pack(np.concatenate([doc[x:y], times[x:y]]))) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]

            named = np.array([[i is not None, i or 0] for i in docs], np.int64)
            rows.append((chunk % deal.buckets, WHO, len(docs), _pack(named), _pack(np.concatenate([np.array(held, float), lengths - 1.0, *sums]))))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(rows), chunk))], ["bucket", "side", "n", "keys", "other", "chunk"])

    def answer(batches):
        m, now = model.value, None
        for b in batches:
            rows = []
            for bucket, side, n, keys, other, chunk in zip(*(b.column(i).to_pylist() for i in range(6))):
                if bucket != now:
                    now, followers, own, table = bucket, _Counts(), _Counts(), np.empty(0, np.int64)
                    _, histories, log_alpha = backoff(*(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), d2, hot)
                if side == FOLLOWERS:
                    followers.add(n, keys, other)
                elif side == WORDS:
                    own.add(n, keys, other)
                elif side == WHO:  # on its way to where the sums of the chunk meet
                    rows.append((chunk, 0, n, keys, other))
                elif side == BIGRAMS:
                    h, w = _unpack_pairs(keys, n)
                    p = m.of(w, *followers.table())
                    log_p, histories, log_alpha = backoff(h, p, _unpack(other, n, np.int64), d2, hot)
                    gain = log_p - np.log10(p)
                    words, number = np.unique(w, return_inverse=True)
                    table = np.searchsorted(histories, h) << SHIFT | number
                elif side == ASK_BIGRAMS:
                    h, w = _unpack_pairs(keys, n)
                    value = np.zeros(n)
                    if len(histories):
                        at = np.minimum(np.searchsorted(histories, h), len(histories) - 1)
                        there = histories[at] == h
                        value = np.where(there, log_alpha[at], 0.0)  # a history never seen: the unigram alone
                    if len(table):
                        number = np.minimum(np.searchsorted(words, w), len(words) - 1)
                        there &= words[number] == w
                        pairs = at << SHIFT | number
                        at = np.minimum(np.searchsorted(table, pairs), len(table) - 1)
                        value = np.where(there & (table[at] == pairs), gain[at], value)
                    doc = _unpack(other, n, np.int32)
                    there = np.flatnonzero(np.bincount(doc)).astype(np.int32)
                    rows.append((chunk, 1, len(there), _pack(there), _pack(np.bincount(doc, weights=value)[there])))
                else:
                    c, both = own.of(_unpack(keys, n, np.int64)), _unpack(other, 2 * n, np.int32)
                    doc, times = both[:n], both[n:]
                    there = np.flatnonzero(np.bincount(doc)).astype(np.int32)
                    sums = [np.bincount(doc, weights=times * x)[there] for x in (c > 0, m.log_base(c), np.log10(m.of_count(c)))]
                    rows.append((chunk, 2, len(there), _pack(there), _pack(np.concatenate(sums))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["chunk", "kind", "n", "a", "b"])

    def gather(batches):
        ids = None

        def known():
            held, tokens, seen, base, lp = sums
            cols = [pa.array(ids[:, 1], mask=ids[:, 0] == 0), pa.array(held > 0), *(pa.array(np.rint(x).astype(np.int64)) for x in (tokens, seen)), pa.array(base), pa.array(lp)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base", "lp"])

        for b in batches:
            for kind, n, x, y in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                if kind == 0:
                    if ids is not None:
                        yield known()
                    ids, sums = _unpack(x, 2 * n, np.int64).reshape(n, 2), _unpack(y, 5 * n, np.float64).reshape(5, n).copy()
                elif kind == 1:
                    sums[4, _unpack(x, n, np.int32)] += _unpack(y, n, np.float64)
                else:
                    sums[2:, _unpack(x, n, np.int32)] += _unpack(y, 3 * n, np.float64).reshape(3, n)
        if ids is not None:
            yield known()

    some = partitions(docs.sparkSession)
    asked = docs.mapInArrow(ask, "bucket int, side int, n long, keys binary, other binary, chunk long")
    met = stored.union(asked).repartition(min(deal.buckets, some), "bucket").sortWithinPartitions("bucket", "side")
    sums = met.mapInArrow(answer, "chunk long, kind int, n long, a binary, b binary")
    return sums.repartition(some, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, vocabulary: int | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    Learns from the rows whose crc32(id as text) modulo ``folds`` is not ``held_out``. Tokens are the words, A-Z
    lower-cased, and one end. ``base_score`` sums log10((c + 1) / (N + V + 1)) over the tokens, ``score`` the Katz
    bigram log10 probabilities; with a ``vocabulary``, words outside it are one class in bigrams. Null texts are empty: their only token is the end. Repeated rows stay rows and count
    as often in training; a null id hashes as an empty text. Without training tokens the model knows nothing: all
    probability is that of the one unseen class. Other columns are not read. No rows, no result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (fold_of(id_col, folds) == held_out).alias("held_out"))
    train, buckets = rows.where(~F.col("held_out")), partitions(spark)
    counts = materialise(count_tokens(train), "tokens", True)
    uni, least = unigrams(counts, vocabulary)
    model, deal = _Sent(spark.sparkContext.broadcast(vars(uni))), _Deal(buckets, *uni.hot(buckets))
    bigrams = materialise(count_bigrams(train, model, deal), "bigrams")
    of = bigrams.select(F.posexplode("of_counts").alias("r", "k")).groupBy("r").agg(F.sum("k").alias("k")).collect()
    d2 = discounts({x.r: x.k for x in of})
    rare = counts.where(F.col("c") < least).select(_code("token").alias("code"), "c")

    def side(table, no):
        return table.select("bucket", F.lit(no).alias("side"), "n", "keys", F.col("counts").alias("other"), F.lit(0).cast("long").alias("chunk"))

    stored = side(bigrams, BIGRAMS)
    if vocabulary is None:
        stored = stored.union(side(materialise(_rare_followers(bigrams, rare), "followers"), FOLLOWERS))
    hot = _hot_sums(stored, model, d2, deal)
    words = side(_packed_counts(rare.select(F.pmod("code", F.lit(buckets)).cast("int").alias("bucket"), "code", "c")), WORDS)
    out = _scored(rows, stored.union(words), model, d2, deal, hot)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(uni.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"))
