import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, katz, mixing, substrings

from .conftest import DOCS, clash, prose


def removed(rows, window):
    first = {}
    for doc, text in rows:
        if doc is not None:
            w = (text or "").split()
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                first[x] = min(first.get(x, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[k : k + window])] < doc:
                gone[k : k + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize(("window", "hot"), [(50, 2000), (50, 2), (10, 2000), (10, 1)])
def test_substrings_equal_brute_force(docs, corpus, window, hot):
    want = removed([(d, t) for d, t, *_ in corpus], window)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(clash(docs), window=window, hot_from=hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[2] for x in want) > 100


def test_substrings_of_nothing(docs):
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_saturated_filter_loses_nothing(docs, corpus, monkeypatch):
    monkeypatch.setattr(substrings, "FILTER_BITS", 6)
    monkeypatch.setattr(substrings, "max", lambda *x: min(x) if x[0] == 16 else max(*x), raising=False)
    want = removed([(d, t) for d, t, *_ in corpus], 50)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_katz(rows, vocabulary):
    train = [(t or "").lower().split() for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    uni = Counter(x for w in train for x in [*w, ""])
    n, by = sum(uni.values()), Counter(uni.values())

    def discounts(of):
        k = 5
        if not all(of.get(i) for i in range(1, k + 2)):
            return {r: 1 - 0.5 / r for r in range(1, k + 1)}
        a = (k + 1) * of[k + 1] / of[1]
        d = {r: ((r + 1) * of[r + 1] / (r * of[r]) - a) / (1 - a) for r in range(1, k + 1)}
        return {r: x if 0 < x < 1 else 1 - 0.5 / r for r, x in d.items()}

    d1 = discounts(by)
    aside = sum((1 - d1[r]) * r * by.get(r, 0) for r in d1)
    whole, unseen = (n, aside / n) if aside else (n + 1, 1 / (n + 1))
    p = {w: c * d1.get(c, 1) / whole for w, c in uni.items()}
    least, held = 1, 0
    for c in sorted(by, reverse=True):
        if held + by[c] > vocabulary:
            least = c + 1
            break
        held += by[c]
    cls = lambda w: w if uni.get(w, 0) >= least else None
    p1 = {w: x for w, x in p.items() if uni[w] >= least}
    p1[None] = max(unseen, 1 - sum(p1.values()))
    after = defaultdict(Counter)
    for w in train:
        s = ["<", *map(cls, w), cls("")]
        for a, b in zip(s, s[1:]):
            after[a][b] += 1
    d2 = discounts(Counter(c for x in after.values() for c in x.values()))

    def prob(h, w):
        q = cls(w)
        inner = p.get(w, unseen) / p1[None] if q is None else 1
        seen = after.get(h)
        if not seen:
            return p1[q] * inner
        total, others = sum(seen.values()), 1 - sum(p1[x] for x in seen)
        if others < 1e-9:
            return seen[q] / total * inner
        left = total - sum(c * d2.get(c, 1) for c in seen.values())
        if left < 1e-9 * total:
            total, left = total + 1, 1
        if q in seen:
            return seen[q] * d2.get(seen[q], 1) / total * inner
        return left / total / others * p1[q] * inner

    return uni, n, cls, prob, unseen


@pytest.mark.parametrize("vocabulary", [1 << 18, 60, 0])
def test_katz_equals_brute_force_and_sums_to_one(docs, corpus, vocabulary):
    rows = [(d, t) for d, t, *_ in corpus]
    uni, n, cls, prob, unseen = brute_katz(rows, vocabulary)
    want = []
    for d, t in rows:
        w = [*(t or "").lower().split(), ""]
        h = ["<", *map(cls, w)]
        want.append((d, len(w), sum(uni.get(x, 0) > 0 for x in w), sum(math.log10((uni.get(x, 0) + 1) / (n + len(uni) + 1)) for x in w), sum(math.log10(prob(a, b)) for a, b in zip(h, w))))
    got = katz.score_texts(clash(docs), vocabulary=vocabulary).collect()
    assert {r.train_tokens for r in got} == {n}
    key = lambda x: (str(x[0]), x[1], round(x[3], 3))
    for g, w in zip(sorted([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)
    for h in ["<", cls("w1"), cls("w5"), "no such word"]:
        assert sum(prob(h, w) for w in uni) + prob(h, "unheard of") == pytest.approx(1)


def katz_like_brute_force(rows, got):
    uni, n, _, prob, _ = brute_katz(rows, 1 << 62)
    want = []
    for d, t in rows:
        w = [*(t or "").lower().split(), ""]
        want.append((d, len(w), sum(math.log10((uni.get(x, 0) + 1) / (n + len(uni) + 1)) for x in w), sum(math.log10(prob(a, b)) for a, b in zip(["<", *w], w))))
    key = lambda x: (str(x[0]), x[1], round(x[2], 3))
    for g, w in zip(sorted([(r.doc_id, r.n_tokens, r.base_score, r.score) for r in got], key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9)


@pytest.mark.parametrize("cache", [1 << 18, 60, 0])
def test_katz_of_all_words_whatever_has_an_id(docs, corpus, cache, monkeypatch):
    monkeypatch.setattr(katz, "CACHE", cache, raising=False)
    katz_like_brute_force([(d, t) for d, t, *_ in corpus], katz.score_texts(clash(docs)).collect())


def test_katz_counts_bigrams_of_all_of_many_words(spark):
    words = [f"w{i}" for i in range(280_000)]
    texts = [" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)]
    rows = list(enumerate([*texts, *texts, "w1 w2 w3 w2 w1"]))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(4)
    katz_like_brute_force(rows, katz.score_texts(docs).collect())


def test_katz_splits_the_followers_of_common_words(spark):
    """A third of all tokens is one word, another begins most texts: their followers are in several buckets."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["the", "the", "of", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(0, 90))) for _ in range(250)] + [None, "the", "the " * 3000]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
    uni, _ = katz.unigrams(katz.count_tokens(docs.selectExpr("doc_id", "text")), None)
    hot, parts = uni.hot(4)
    assert len(hot) >= 2 and parts.max() == 4
    katz_like_brute_force(list(enumerate(texts)), katz.score_texts(docs).collect())


def test_katz_without_training_rows(spark):
    none = katz.score_texts(spark.createDataFrame([], DOCS))
    assert none.count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = katz.score_texts(spark.createDataFrame([(held[0], "a b", None, None, None), (held[1], None, None, None, None)], DOCS)).orderBy("n_tokens").collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(True, 1, 0, 0), (True, 3, 0, 0)]


def test_mixing(docs, corpus):
    got = mixing.mix_sources(clash(docs)).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == sum(len((t or "").split()) for _, t, _, s, _ in corpus if s == r.source)
    total, level = sum(size.values()), target["s0"] / 1
    assert sum(target.values()) == pytest.approx(total) and len(got) == len(corpus)
    for s, w in zip(sorted(size, key=lambda x: (x is None, x)), (1, 2, 3, 1)):
        assert target[s] == pytest.approx(min(3 * size[s], w * level))
        largest = max(len((t or "").split()) for _, t, _, x, _ in corpus if x == s)
        assert abs(taken[s] - target[s]) <= max(1, 3 * largest)
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in got}


@pytest.mark.parametrize(("sizes", "wanted"), [
    ({"a": 100, "b": 100, "c": 100}, {"a": 50.0, "b": 100.0, "c": 150.0}),
    ({"a": 1000, "b": 1, "c": 1}, {"a": 996.0, "b": 3.0, "c": 3.0}),
    ({"a": 0, "b": 10}, {"a": 0.0, "b": 10.0}), ({"a": 0}, {"a": 0.0}), ({"a": 7}, {"a": 7.0}),
    ({"a": 10, "b": 10, "c": 10, None: 300}, {"a": 110.0 + 20 - 100, "b": 30.0, "c": 30.0, None: 240.0}),
])
def test_targets(spark, sizes, wanted):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert got == pytest.approx(wanted)


def brute_mix(rows, limit=3):
    """What is taken of each row: targets by sharing excess again and again, then documents in the order of their hashes."""
    sources = sorted({x for *_, x in rows}, key=lambda x: (x is None, x or ""))
    size = {x: sum(len((t or "").split()) for _, t, y in rows if y == x) for x in sources}
    weight, target, left, open_ = {x: i % 3 + 1 for i, x in enumerate(sources)}, {}, float(sum(size.values())), list(sources)
    while True:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = [x for x in open_ if share[x] > limit * size[x]]
        for x in full:
            target[x] = float(limit * size[x])
            left -= target[x]
            open_.remove(x)
        if not full:
            break
    target |= share if open_ else {}
    out = []
    for x in sources:
        docs = Counter()
        for d, t, y in rows:
            if y == x:
                docs[int(hashlib.md5(f"{'' if d is None else d}\n{t or ''}".encode()).hexdigest()[:15], 16), d, t] += len((t or "").split())
        times = int(target[x] // size[x]) if size[x] else 0
        part, upto, last = target[x] - times * size[x], 0, -1
        for h, n in sorted((k[0], n) for k, n in docs.items()):
            if part > 0 and n and upto < part <= upto + n:
                last = h if part - upto > n / 2 else h - 1
            upto += n
        out += [(d, x, len((t or "").split()) * (times + (k <= last))) for k, d, t in docs for y in [x] for _ in range(sum(1 for r in rows if r == (d, t, x)))]
    return target, out


def test_mixing_equals_brute_force(spark, docs, corpus):
    rng = random.Random(3)
    many = [(i if i % 5 else None, prose(rng, rng.randrange(0, 30)), rng.choice(["a", "b", "ç", "Z", None])) for i in range(800)]
    for rows in ([(d, t, x) for d, t, _, x, _ in corpus], many, many[:1], [(None, None, None)]):
        target, want = brute_mix(rows)
        got = mixing.mix_sources(spark.createDataFrame([(d, t, None, x, None) for d, t, x in rows], DOCS).repartition(3)).collect()
        assert {r.source: r.target for r in got} == pytest.approx(target)
        assert sorted(((r.doc_id, r.source, r.taken) for r in got), key=str) == sorted(want, key=str)


def test_mixing_tells_rows_without_ids_apart(spark):
    rows = [(None, f"x{i} " * 10, None, "a", None) for i in range(1000)] + [(i, "y " * 10, None, "b", None) for i in range(2000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 5 for r in got)


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 40)), None, rng.choice("abcde"), None) for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 20 for r in got)


def test_mixing_of_nothing(docs):
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs.where("text is null or trim(text) = ''")).collect()} == {0}


def brute_leaks(rows, items, k=5, least=0.8):
    out = {}
    words = lambda t: [x for x in (t or "").lower().split() if x]
    for d, t in rows:
        w = words(t)
        for item, it in items:
            iw = words(it)
            if not iw:
                continue
            n = min(k, len(iw))
            s, m = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)], Counter(tuple(iw[i : i + n]) for i in range(len(iw) - n + 1))
            size = sum(m.values())
            for p in range(max(1, len(s) - size + 1)):
                c = Counter(s[p : p + size])
                o = sum((c & m).values())
                j = o / (sum(c.values()) + size - o)
                if j >= least:
                    out[d, item] = max(out.get((d, item), 0), j)
    return out


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate([14, 20, 36, 36, 59, 5, 4, 1, 2])] + [(90, None), (91, " "), (3, prose(rng, 30)), (92, "w1 w2 w3 w1 w2 w3 w1 w2 w3 w1 w2 w3")]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items[:6])[1]).split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choice([[], ["x"], [w[at].upper()]])
            parts += [" ".join(w), prose(rng, rng.randrange(30))]
        rows.append((i, "\n".join(parts)))
    rows += [(100, items[4][1][:-8]), (101, None), (102, ""), (103, "w1 w2 w3 " * 8), (None, items[2][1]), (5, rows[5][1]), (6, items[1][1])]
    return rows, items, spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("radius", [24, 40])
def test_leaks_equal_brute_force(leaky, radius):
    rows, items, docs, bench = leaky
    got = {}
    for r in decontam.find_leaks(clash(docs), clash(bench), radius=radius).collect():
        got[r.doc_id, r.item_id] = max(got.get((r.doc_id, r.item_id), 0), r.similarity)
    want = brute_leaks(rows, items)
    assert got == pytest.approx(want) and len(want) > 40


def test_leaks_use_no_python(leaky):
    _, _, docs, bench = leaky
    plan = decontam.find_leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_leaks_of_nothing(leaky):
    _, _, docs, bench = leaky
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0 == decontam.find_leaks(docs, bench.limit(0)).count()


def test_multi_index_finds_all_within_the_radius(spark):
    rng = random.Random(4)
    items = [(i, rng.getrandbits(64) - (1 << 63), 7) for i in range(30)]
    windows = []
    for i in range(60):
        fp = items[i % 30][1]
        for b in rng.sample(range(64), rng.randrange(40)):
            fp = (fp ^ (1 << b)) if b < 63 else (fp ^ -(1 << 63))
        windows.append((i, fp, 7 if i % 5 else 8))
    got = decontam.multi_index(spark.createDataFrame(windows, "w long, fp long, size int"), spark.createDataFrame(items, "item_id long, item_fp long, size int"), 24)
    pairs = [(r.w, r.item_id, r.distance) for r in got.collect()]
    want = [(w, i, ((fp ^ g) % 2**64).bit_count()) for w, fp, n in windows for i, g, m in items if n == m and ((fp ^ g) % 2**64).bit_count() <= 24]
    assert sorted(pairs) == sorted(want)


def test_windows_of_a_group_are_not_all_cut_out_at_once():
    import tracemalloc

    import pyarrow as pa

    text = b" ".join(b"%d" % (i * 7919 % 10007) for i in range(650))
    n, windows = 100, 601
    group = pa.table({"mini": pa.array([1] * n), "salt": pa.array([1] * n, pa.int32()), "doc_id": pa.array(range(n)), "tid": pa.array([0] * n, pa.int32()), "start": pa.array([0] * n, pa.int32()), "packed": [text] * n})
    tracemalloc.start()
    found = sum((row[4] is None) * (row[3] - row[2]) for row in substrings._repeats(group, 50))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == (n - 1) * windows
    assert peak < 200 * n * windows
