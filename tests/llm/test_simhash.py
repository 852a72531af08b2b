import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import simhash as s
from tessera.llm.common import runs
from tessera.llm.components import connected_components, merge_labels

from .conftest import clash


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def plain_fingerprint(text, k):
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    label = list(range(n))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 9, 22, 40, 64])
def test_bit_sliced_neighbours_are_all_neighbours(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 30, dtype=np.uint64)[rng.integers(0, 30, 400)]
    for _ in range(8):
        a = a ^ ((np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) * (rng.random(400) < 0.5))
    for b in (a, a[:333], a[:5]):
        got = [p for i, j in s.neighbours(a, b, radius) for p in zip(i.tolist(), j.tolist())]
        want = list(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(a[:, None] ^ b) <= radius))))
        assert sorted(got) == want


def test_bands_lose_nothing():
    rng = np.random.default_rng(1)
    for n in (10, 1 << 24, 1 << 32):
        bands = s.bands_for(n, 4)
        masks = [np.uint64(sum(1 << b for b in bits)) for bits in bands]
        for _ in range(300):
            differ = np.uint64(0)
            for bit in rng.choice(64, 4, replace=False):
                differ |= np.uint64(1) << np.uint64(bit)
            assert any(differ & m == 0 for m in masks)


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = np.arange(3000)
    merge_labels(label, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert got == {n: label[n] for p in pairs if p[0] != p[1] for n in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [4096, 3])
def test_components_of_documents(spark, docs, corpus, tile, monkeypatch):
    monkeypatch.setattr(s, "TILE", tile)
    fps = [plain_fingerprint(t, 4) for _, t, *_ in corpus]
    top = classes(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    name = {}
    for c, (doc, *_) in zip(top, corpus):
        name[c] = min((x for x in (name.get(c), doc) if x is not None), default=None)
    want = sorted(((d, f, name[c]) for (d, *_), f, c in zip(corpus, fps, top)), key=str)
    for given in (docs, clash(docs)):
        got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in s.simhash_components(given).collect()]
        assert sorted(got, key=str) == want


def test_near_duplicates(spark, docs, corpus):
    sets = [set(shingles(t, 5)) for _, t, *_ in corpus]
    alike = lambda i, j: (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
    top = classes(len(sets), alike)
    name = {}
    for c, (doc, *_) in zip(top, corpus):
        name[c] = min((x for x in (name.get(c), doc) if x is not None), default=None)
    want = sorted(((d, name[c]) for (d, *_), c in zip(corpus, top)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in s.near_duplicates(clash(docs)).collect()), key=str) == want


def test_near_duplicates_that_repeat_a_line_differently_often(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        body, line = [f"b{i}x{k}" for k in range(400)], " ".join(f"l{i}x{k}" for k in range(12))
        other = list(body)
        for k in rng.choice(400, 6, replace=False):
            other[k] = "edited"
        rows += [(2 * i, " ".join([*body, *[line] * 2])), (2 * i + 1, " ".join([*other, *[line] * 20]))]
        a, b = (set(shingles(t, 5)) for _, t in rows[-2:])
        assert len(a & b) >= 0.8 * len(a | b)
    got = {r.doc_id: r.component_id for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(80)}


def test_empty_tables(docs):
    assert s.simhash_components(docs.limit(0)).count() == 0 == s.near_duplicates(docs.limit(0)).count()


def test_near_duplicates_without_ids(spark):
    rng = np.random.default_rng(6)
    body = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(40):
        other = list(body)
        other[int(rng.integers(60))] = f"edit{i}"
        rows.append((None, " ".join(other)))
    rows += [(None, "one two"), (None, "one two"), (None, None), (7, "three four five six")]
    got = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.component_id == r.doc_id for r in got)
    assert len({r.component_tid for r in got}) == 4 and {r.component_tid for r in got} <= {r.tid for r in got}


@pytest.mark.parametrize("tile", [4096, 4])
def test_near_duplicates_under_a_common_line(spark, tile, monkeypatch):
    """Most documents begin with one line, and many are near copies: hot buckets are split by a second anchor."""
    monkeypatch.setattr(s, "TILE", tile)
    rng, line = np.random.default_rng(8), " ".join(f"l{k}" for k in range(40))
    rows = []
    for i in range(60):
        body = [f"b{i // 3 if i < 30 else 99}x{k}" for k in range(60)]
        body[int(rng.integers(60))] = f"e{i}"
        rows.append((i, (line + " " if i % 5 else "") + " ".join(body)))
    sets = [set(shingles(t, 5)) for _, t in rows]
    want = classes(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r.doc_id: r.component_id for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))


def test_buckets_do_not_depend_on_their_size(spark, monkeypatch):
    """Classes that share one anchor alone meet, however many have it."""
    rep = spark.createDataFrame([(i, i, [1, 100 + i]) for i in range(20)] + [(50, 50, [2, 3]), (51, 51, [3, 4])], "id long, fp long, anchors array<long>")
    got = []
    for tile in (4096, 3):
        monkeypatch.setattr(s, "TILE", tile)
        got.append({(r.bucket, r.id) for r in s._buckets(rep).select("bucket", "id").collect()})
    assert got[0] == got[1] == {(1, i) for i in range(20)} | {(3, 50), (3, 51)}


def test_only_pairs_that_may_be_similar_are_compared_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    base, sets = rng.integers(0, 2**63, 100, dtype=np.uint64), []
    for _ in range(300):  # near copies, few of which are similar enough
        x = base.copy()
        n = rng.integers(0, 40)
        x[rng.choice(100, n, replace=False)] = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets.append(np.unique(x[: rng.integers(90, 101)]))
    sets[7] = sets[9] = np.empty(0, np.uint64)
    fps, ids = s.fingerprints(sets), rng.permutation(300).astype(np.int64)
    jaccard, calls = s._jaccard, []
    monkeypatch.setattr(s, "_jaccard", lambda a, b: calls.append(1) or jaccard(a, b))
    for own in (np.zeros(300, int), np.arange(300) % 2):
        calls.clear()
        leaf, root = s._link_tile(ids, fps, own, 22, sets, 0.8)
        assert len(calls) < 2 * 300
        label = np.arange(300)
        for i in range(300):
            for j in range(i):
                meet = own[i] != own[j] or not own.any()
                if meet and np.bitwise_count(fps[i] ^ fps[j]) <= 22 and jaccard(sets[i], sets[j]) >= 0.8:
                    merge_labels(label, np.array([i]), np.array([j]))
        want = np.flatnonzero(label != np.arange(300))
        assert 50 < len(want) < 250
        assert (leaf.tolist(), root.tolist()) == (ids[want].tolist(), ids[label[want]].tolist())


def test_pairs_of_near_copies_are_spelt_out_in_pieces():
    a = np.arange(4096, dtype=np.uint64)  # all within 12 bits of one another
    most = total = 0
    for i, j in s.neighbours(a, a, 12):
        most, total = max(most, len(i)), total + len(i)
    assert total == 4096 * 4096 and most <= s.HITS * 64


def test_runs_across_batches():
    bucket = np.repeat([1, 2, 3, 3, 4, 9], [3, 1, 5, 1, 40, 2])
    rows = pa.record_batch({"bucket": bucket, "t0": np.arange(52) // 26, "t1": np.zeros(52, int), "id": np.arange(52)})
    want = []
    for key in sorted(set(zip(bucket.tolist(), (np.arange(52) // 26).tolist()))):
        want.append([i for i in range(52) if (bucket[i], i // 26) == key])
    for step in (1, 3, 7, 60):
        batches = [rows.slice(0, 0), *[rows.slice(i, step) for i in range(0, 52, step)], rows.slice(52)]
        got = [[i for b in run for i in b["id"].to_pylist()] for run in runs(batches, ("bucket", "t0", "t1"))]
        assert got == want
        tiles = [t["id"].to_pylist() for t in s._tiles(batches, lambda t: [t])]
        assert tiles == [x for x in want if len(x) > 1]
    assert list(runs([], ("bucket",))) == list(s._tiles([rows.slice(0, 0)], lambda t: [t])) == []


def test_fingerprints_count_the_bits_of_few_shingles_at_a_time():
    rng = np.random.default_rng(3)
    hashes = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in [400] * 300 + [0, 1, 9_999, 10_000, 10_001, 250_000, 0, 7]]
    tracemalloc.start()
    got = s.fingerprints(hashes).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    assert got == [sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) for h in hashes]
