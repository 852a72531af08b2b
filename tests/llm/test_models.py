import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, htmltext, langid, quality, queries, toxicity

from .conftest import DOCS, clash

LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


@pytest.fixture(scope="module")
def world(spark):
    """Documents of two languages, some toxic, some junk, with labels for half of them."""
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "ru", "te"], "bb": ["sch", "ung", "ver", "keit", "ein"]}
    rows, labels = [], []
    for i in range(900):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 90))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["filth", "vermin", "vermins", "scoundrel"]))
        text = " ".join(words) + "."
        if not good:
            text = " ".join(w + "***" for w in words).upper()
        rows.append((i, text, lang if i % 10 else None, "s", len(text)))
        if i % 2 == 0:
            labels.append((i, int(good), int(toxic)))
    odd = [(1000, None, "aa", None, None), (1001, "", "bb", None, 0), (1002, "12 345 !?", "aa", None, 9), (None, rows[1][1], "aa", "s", 1), (1, rows[1][1], "aa", "s", 1), (1003, "ka lo mi " * 20_000, "aa", "s", 1)]
    return rows, labels, spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels + [(4, None, None), (None, 1, 1), (0, labels[0][1], labels[0][2])], LABELS)


def test_language(world):
    rows, _, docs, _ = world
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(clash(docs)).collect()}
    assert len(got) == 905  # a repeated row
    right = [i for i, _, lang, *_ in rows if lang and held(i) and (i, lang) in got]
    assert len(right) >= 0.99 * sum(1 for i, _, lang, *_ in rows if lang and held(i))
    assert all((i, "und") in got and got[i, "und"].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got.values())


def test_language_equals_plain_bayes(world):
    """Counts, matrix and posteriors, n-gram by n-gram of each text."""
    _, _, docs, _ = world
    found = [(r.doc_id, r.text, r.lang) for r in docs.where("doc_id < 60 or doc_id > 900 or doc_id is null").collect()]

    def grams(text):
        low = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        plain = f" {' '.join(low)} " if low else ""
        return [plain[i : i + n] for n in (2, 3) for i in range(len(plain) - n + 1)]

    def column(gram):
        points = np.array([ord(c) for c in gram], np.uint32)
        return next(int(cols[0]) for n, cols, _ in langid._columns(points) if n == len(gram))

    learn = [(t, x) for d, t, x in found if x and not held(d)]
    langs = sorted({x for _, x in learn})
    count = {x: Counter(column(g) for t, y in learn if y == x for g in grams(t)) for x in langs}
    total = {x: sum(count[x].values()) + 0.5 * 2**langid.BITS for x in langs}
    share = Counter(x for _, x in learn)
    got = langid.identify(docs.sparkSession.createDataFrame([(d, t, x, None, None) for d, t, x in found], DOCS)).collect()
    assert len(got) == len(found)
    of = {(d, t): x for d, t, x in found}
    want = {}
    for d, t in of:
        g = Counter(column(x) for x in grams(t))
        log = {x: math.log(share[x] / len(learn)) + sum(n * math.log((count[x][c] + 0.5) / total[x]) for c, n in g.items()) for x in langs}
        best = max(langs, key=log.get)
        want[d, t] = (best, 1 / sum(math.exp(v - log[best]) for v in log.values())) if g else ("und", 0.0)
    for d in {r.doc_id for r in got}:
        mine, theirs = sorted((r.lang_pred, r.score) for r in got if r.doc_id == d), sorted(want[k] for k in want if k[0] == d)
        assert {x for x, _ in mine} == {x for x, _ in theirs} and [z for _, z in mine[: len(theirs)]] == pytest.approx([z for _, z in theirs], abs=1e-9)


def test_equally_likely_languages(spark):
    ids = [i for i in range(40) if not held(i)][:2]
    docs = spark.createDataFrame([(ids[0], "ka lo", "zz", None, 5), (ids[1], "ka lo", "aa", None, 5), (1000, "ka", None, None, 2), (1001, "\u0301\u0301", None, None, 2)], DOCS)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert {r.lang_pred for i, r in got.items() if i != 1001} == {"aa"} and got[1000].score == pytest.approx(0.5) and got[1001].lang_pred == "und"


def test_pieces_of_a_long_text_are_the_whole(monkeypatch):
    texts = [("ka lo mi ru te " * 40).encode(), b"", b"12", "é lo".encode(), b"x"]

    def counted():
        out = Counter()
        for text, cols, count in langid._counts(texts):
            out.update({k: n for *k, n in zip(text.tolist(), cols.tolist(), count.tolist()) for k in [tuple(k)]})
        return out

    whole = counted()
    assert {i for i, _ in whole} == {0, 3, 4}
    monkeypatch.setattr(langid, "PIECE", 7)
    assert counted() == whole


def test_batches_are_cut_by_rows_and_bytes():
    import pyarrow as pa

    from tessera.llm.common import small

    b = pa.RecordBatch.from_arrays([pa.array([str(i) * (20_000 if i % 90 == 0 else 1) for i in range(1200)])], ["text"])
    parts = list(small([b, b.slice(0, 0)], rows=500, size=100_000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == b.column(0).to_pylist()
    assert all(p.num_rows <= 500 and (p.nbytes <= 100_000 or p.num_rows == 1) for p in parts)


def test_language_without_labels_or_rows(spark):
    none = spark.createDataFrame([(1, "ka lo", None, None, 1)], DOCS)
    assert [r.lang_pred for r in langid.identify(none).collect()] == ["und"] and langid.identify(none.limit(0)).count() == 0


def accuracy(scored, labels, column, least):
    truth = {i: (q, t)[column] for i, q, t in labels if held(i)}
    said = {r.doc_id: r.score >= least for r in scored if r.doc_id in truth}
    return sum(said[i] == bool(y) for i, y in truth.items()) / len(truth)


def test_toxicity(world):
    rows, labels, docs, known = world
    got = toxicity.score_toxicity(clash(docs), clash(known)).collect()
    assert accuracy(got, labels, 1, 0.3) >= 0.97 and len(got) == 906
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got)
    plain = {r.doc_id: r.score for r in got}
    assert plain[1000] == plain[1001] == plain[1002] < 0.3 or plain[1000] == plain[1001]


def test_toxicity_ignores_labels_of_the_held_out_fold(world):
    _, labels, docs, known = world
    other = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda k: sorted((str(r.doc_id), r.score) for r in toxicity.score_toxicity(docs, k).collect())
    assert score(other) == score(known)


def test_nnpu_follows_a_negative_risk_backwards():
    p, u = (np.array([0, 0]), np.array([0, 1])), (np.array([1, 1, 0]), np.array([0, 1, 2]))
    w, bias = toxicity.nnpu(p, u, 2, 3, 2, 0.3)
    assert np.isfinite(w).all() and w[0] > w[1]
    wild, _ = toxicity.nnpu((np.arange(3), np.arange(3)), (np.arange(3, 6), np.arange(3)), 3, 3, 6, 0.5, decay=0.0)
    assert np.abs(wild).max() < 40


def test_nnpu_risk_has_its_numeric_gradient():
    rng = np.random.default_rng(5)
    p, u = (rng.integers(0, 6, 20), np.sort(rng.integers(0, 8, 20))), (rng.integers(0, 6, 50), np.sort(rng.integers(0, 30, 50)))
    w = rng.normal(size=7)
    positive, negative, up, down = toxicity.risk(w, p, u, 8, 30, 0.3)
    fp, fu = (np.array([w[-1] + sum(w[c] for c, d in zip(*x) if d == i) for i in range(n)]) for x, n in ((p, 8), (u, 30)))
    assert positive == pytest.approx(0.3 * np.log1p(np.exp(-fp)).mean()) and negative == pytest.approx(np.log1p(np.exp(fu)).mean() - 0.3 * np.log1p(np.exp(fp)).mean())
    for i in range(7):
        e = 1e-6 * np.eye(7)[i]
        more, less = toxicity.risk(w + e, p, u, 8, 30, 0.3), toxicity.risk(w - e, p, u, 8, 30, 0.3)
        assert (more[0] - less[0]) / 2e-6 == pytest.approx(up[i], abs=1e-6) and (more[1] - less[1]) / 2e-6 == pytest.approx(down[i], abs=1e-6)


def test_toxicity_scores_equal_brute_force(world):
    """Frequencies over all texts of the fold, and the scores, computed document by document."""
    rows, labels, docs, known = world
    from tessera.llm.learning import with_fold

    weights, bias = toxicity.train(with_fold(docs, "doc_id", "text"), known, "toxic", 4000, 8000)
    own = {c for t in ("filth", "vermin", "vermins", "scoundrel") for c in toxicity._columns(t)}
    assert weights and set(weights) <= own  # nothing else marks toxicity here
    n, counts = toxicity._occurrences(with_fold(docs, "doc_id", "text").where("not held_out"), np.array(sorted(own)))
    free = [(i, t) for i, t, *_ in docs.collect() if not held(i)]
    columns = [{c for w in (t or "").lower().replace(".", " ").replace("*", " ").split() for c in toxicity._columns(w)} for _, t in free]
    assert n == len(free) and {c: int(counts[c]) for c in own} == {c: sum(c in x for x in columns) for c in own}
    for r in toxicity.score_toxicity(docs, known).where("doc_id < 100").join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        f = bias + sum(weights.get(c, 0) for w in set(r.text.lower().replace(".", " ").replace("*", " ").split()) for c in toxicity._columns(w))
        assert r.score == pytest.approx(1 / (1 + math.exp(-f)))


def test_toxicity_without_positives_or_rows(world, spark):
    _, _, docs, known = world
    none = toxicity.score_toxicity(docs, known.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.0} and toxicity.score_toxicity(docs.limit(0), known).count() == 0


def test_quality(world):
    _, labels, docs, known = world
    got = quality.score_quality(clash(docs), clash(known)).collect()
    assert accuracy(got, labels, 0, 0.7) >= 0.97 and len(got) == 906
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_quality(docs, known.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), known).count() == 0


def test_quality_scores_are_density_differences(world):
    _, _, docs, known = world
    from tessera.llm.learning import labelled, with_fold

    rows = labelled(with_fold(docs, "doc_id", "text"), known, "quality")
    own = rows.select("text", "y").toPandas()
    x, y = np.array([quality.statistics(t.encode()) for t in own.text]), own.y.to_numpy()
    d, both = x.shape[1], sum((y == c).sum() * np.cov(x[y == c].T, bias=True) for c in (0, 1)) / len(y)
    for c, (base, mean, inv) in enumerate(quality.fit(rows)):
        n = (y == c).sum()
        a = 0.1 * min(1.0, 10 * d / n) + (d / (n + d)) * 0.9
        sigma = (1 - a) * np.cov(x[y == c].T, bias=True) + a * both + 0.02 * np.diag(np.diag(both)) + 1e-6 * np.eye(d)
        assert mean == pytest.approx(x[y == c].mean(0)) and inv @ sigma @ inv.T == pytest.approx(np.eye(d), abs=1e-6)
        assert base == pytest.approx(math.log(n / len(y)) - 0.5 * np.linalg.slogdet(sigma)[1])


def test_quality_scores_equal_brute_force(world):
    """The difference of two Gaussian log densities of each text, by determinants and inverses."""
    _, _, docs, known = world
    from tessera.llm.learning import labelled, with_fold

    model = quality.fit(labelled(with_fold(docs, "doc_id", "text"), known, "quality"))
    for r in quality.score_quality(docs, known).join(docs.select("doc_id", "text").distinct(), "doc_id").where("doc_id < 80 or doc_id >= 1000").collect():
        x, log = np.array(quality.statistics((r.text or "").encode())), []
        for base, mean, inv in model:
            sigma = np.linalg.inv(inv.T @ inv)
            log.append(base - 0.5 * (x - mean) @ np.linalg.solve(sigma, x - mean))
        assert r.score == pytest.approx(1 / (1 + math.exp(-np.clip(log[1] - log[0], -40, 40))), rel=1e-6, abs=1e-12)


def test_scores_of_long_texts_and_repeated_rows(world, spark):
    rows, labels, _, known = world
    long_ = "ka lo mi ru te filth. " * 60_000
    docs = spark.createDataFrame(rows + [(2000, long_, "aa", "s", None), (2001, long_ + "vermin", "aa", "s", None), (3, rows[3][1], "aa", "x", 1), (3, rows[3][1], "aa", "x", 1)], DOCS)
    for scored in (toxicity.score_toxicity(docs, known).collect(), quality.score_quality(docs, known).collect()):
        of = {}
        for r in scored:
            of.setdefault(r.doc_id, []).append(r.score)
        assert len(scored) == len(rows) + 4 and len(of[3]) == 3 and len(set(of[3])) == 1 and all(0 <= z <= 1 for x in of.values() for z in x)


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("n", "least"), [(7, 1.0), (900, 1.0), (4000, 0.9)])
def test_neighbours(spark, n, least):
    rng = np.random.default_rng(n)
    x = unit(rng, n, 24).astype(np.float32)
    x[n // 2 :: 7] = x[3]  # many copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, x[0].tolist()), (n, None), (n + 1, [0.0] * 24), (n + 2, [float("nan")] * 24), (n + 3, [float("inf")] + [1.0] * 23), (n + 4, [None] + [1.0] * 23), (n + 5, [1.0, 2.0]), (n + 6, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(clash(df)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d, hit, total = x.astype(float), 0, 0
    queries_ = [q for q in range(0, n, 100)]
    for q in queries_:
        s = np.sqrt(((d - d[q]) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(n), s)) if i != q][:10]
        mine = sorted(got.get(q, []))
        assert [r for r, *_ in mine] == list(range(1, len(mine) + 1)) and len(mine) == min(10, n - 1)
        assert [(z, i) for _, i, z in mine] == sorted((z, i) for _, i, z in mine) and all(abs(s[i] - z) < 1e-12 for _, i, z in mine)
        hit, total = hit + len({i for _, i, _ in mine} & set(true)), total + len(true)
    assert hit >= least * total and set(got) <= {*queries_, *(i for i in range(n, n + 7) if i % 100 == 0)}


@pytest.mark.parametrize(("dim", "hashes"), [(16, 1), (24, 2), (128, 1), (128, 2)])
def test_recall_of_queries_that_did_not_tune(spark, monkeypatch, dim, hashes):
    """Probes are tuned on few queries and hold for the others, with one rotation a bucket and with two."""
    monkeypatch.setattr(ann, "TUNING", 20)
    monkeypatch.setattr(ann, "hashes_for", lambda n, axes: hashes)
    n, rng = 6000, np.random.default_rng(dim + hashes)
    x = unit(rng, n, dim) + 2.0 * unit(rng, 40, dim)[rng.integers(0, 40, n)]
    got = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    true = {q: {int(i) for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:11]} - {q} for q in range(0, n, 100)}
    assert sum(len(got[q] & true[q]) for q in true) >= 0.9 * sum(map(len, true.values()))


def test_hashes_follow_from_the_rows():
    assert [ann.hashes_for(n, 128) for n in (0, 10, 1 << 20, (1 << 20) + 1, 1 << 27, 1 << 28)] == [1, 1, 1, 2, 2, 3]
    rot = ann.Rotations(8, 1, 3)
    x = unit(np.random.default_rng(4), 5, 8)
    s = rot.scores(x, 0)
    cost = sum(((h.max(1, keepdims=True) - h) ** 2)[:, i] for h, i in zip(s, np.unravel_index(np.arange(16**3), (16, 16, 16))))
    want = np.sort(cost, axis=1)[:, :50]
    assert np.take_along_axis(cost, rot.probes(x, 0, 50), 1) == pytest.approx(want) and (rot.probes(x, 0, 1)[:, 0] == rot.bucket(x, 0)).all()


@pytest.mark.parametrize("n", [600, 1500])
def test_neighbours_where_rows_repeat(spark, n):
    rng = np.random.default_rng(n)
    x = unit(rng, n, 16)
    near = {i + 1: x[i] + 1e-3 * rng.normal(size=16) for i in range(0, n, 100)}  # next to each query, in many rows
    rows = [(i, near.get(i, v).tolist()) for i, v in enumerate(x)]
    rows += [(i, (v + 1e-4 * (k % 3) * rng.normal(size=16)).tolist()) for i, v in near.items() for k in range(25)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    d, hit = np.array([v for _, v in rows]), 0
    for q in range(0, n, 100):
        best = {}
        for (i, _), s in zip(rows, np.sqrt(((d - d[q]) ** 2).sum(1))):
            best[i] = min(s, best.get(i, s))
        mine = sorted(got[q])
        assert len(mine) == len({i for _, i in mine}) == 10 and all(abs(best[i] - s) < 1e-12 for s, i in mine)
        hit += len({i for _, i in mine} & set(sorted(best.keys() - {q}, key=lambda i: (best[i], i))[:10]))
    assert hit >= (1.0 if n <= 1000 else 0.9) * 10 * (n // 100)
    q, v = np.zeros((1, 2)), np.array([[1.0, 0], [1, 0], [1, 0], [2, 0], [3, 0]])
    assert [z[1:3] for z in ann.nearest(q, np.array([7, 7, 7, 8, 9]), v, np.array([0]), 2)] == [(7, 1.0), (8, 2.0)]


def test_neighbours_are_exact_where_the_most_probes_miss_the_recall(spark):
    x = unit(np.random.default_rng(3), 1100, 520)  # 2,048 buckets
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id) for r in ann.search(df, tables=1, wider=0).collect()}
    assert got == {(q, r + 1, int(i)) for q in range(0, 1100, 100) for r, i in enumerate(np.argsort(((x - x[q]) ** 2).sum(1))[1:11])}


def test_neighbours_in_chunks_and_with_two_hashes(spark, monkeypatch):
    x = unit(np.random.default_rng(1), 1500, 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {(r.query_id, r.rank, r.vec_id) for r in ann.search(df).collect()}
    monkeypatch.setattr(ann, "CHUNK", 5)
    assert {(r.query_id, r.rank, r.vec_id) for r in ann.search(df).collect()} == want
    rot = ann.Rotations(16, 2, 2)
    assert (rot.probes(x[:50], 1, 1)[:, 0] == rot.bucket(x[:50], 1)).all()
    assert ann.hadamard(np.eye(16)) @ ann.hadamard(np.eye(16)).T == pytest.approx(np.eye(16))


def test_neighbours_of_nothing(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script><style>p{}</style></head><body><header><a href=/>Site</a><p>The best of all sites, every day anew.</p></header>
<div class="cookie-notice"><p>We use cookies to give you the best experience. Please accept them now.</p></div><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<article><h1>Head &amp; shoulders</h1><p>First  para with <a href=x>a link</a> and caf&eacute;&nbsp;text that goes on for a while.<p>Second, unclosed,
over two lines, with <b>bold</b> words in it.<div class="ad"><p>Buy this great product now, it is the best of them all!</p></div><p>Short.</p><section class="comments"><p>Bob: what a great article, thank you so much for it.</p></section></article>
<aside><p>Related: something else that is quite long and has many words. More of it here.</p></aside><form><p>Write your name and your address here.</p></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark):
    want = "Head & shoulders\nFirst para with a link and café text that goes on for a while.\nSecond, unclosed, over two lines, with bold words in it.\nShort."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", PAGE), (None, "u", "<p>a<p x='"), (5, "u", PAGE.replace("<article>", "<article>" + "<p>A paragraph of the long text, again.</p>" * 3000))]
    got = htmltext.extract(clash(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[4] == want and text[2] == text[3] == "" and len(got) == 6
    assert text[5].count("A paragraph of the long text, again.") == 3000 and text[5].endswith("Short.")
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 8)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def price(keep):
            return sum(max(0, c) for c, k in zip(costs, keep) if not k) + sum(max(0, -c) for c, k in zip(costs, keep) if k) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert price(htmltext.minimum_cut(costs, edges)) == pytest.approx(best)


def test_queries_return_their_columns(spark, world, docs, tmp_path):
    _, _, _, known = world
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(30)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = {
        "op1": "doc_id fingerprint component_id", "op2": "doc_id held_out n_tokens n_known train_tokens base_score score", "op3": "page_id url text n_chars", "op4": "doc_id held_out lang_pred score",
        "op5": "doc_id n_words n_removed kept_sha256", "op6": "query_id rank vec_id score", "op7": "doc_id size source_size target taken", "op8": "doc_id held_out score predicted", "op9": "doc_id item_id", "op10": "doc_id held_out score predicted",
    }
    for name, query in queries.QUERIES.items():
        out = query(spark, str(tmp_path))
        assert set(columns[name.split("_")[0]].split()) <= set(out.columns), name
        out.collect()
