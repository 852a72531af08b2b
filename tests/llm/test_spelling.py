import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spelling as S

from .conftest import DOCS, clash


def near_words(words):
    near, wild = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
            wild[i, cut].append(w)
    for group in wild.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def brute(words, ratio=10):
    near, form = near_words(words), {}
    for w, n in words.items():
        if near[w]:
            f = min(near[w], key=lambda x: (-words[x], x))
            if words[f] >= ratio * n:
                form[w] = f

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def found(out):
    rows = out.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def lexicon():
    """Short words over a small alphabet, where nearly all are near one another; long words with one beginning; ties."""
    rng = random.Random(8)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))): rng.choice([1, 2, 3, 30, 30, 400, 5000]) for _ in range(900)}
    long_ = "x" * 3000
    words |= {long_: 50, long_ + "y": 3, long_ + "z": 600, "y" + long_: 2, long_[1:]: 4, long_[:1500] + "é" + long_[1500:]: 5}
    words |= {"zustand": 2, "zustande": 25, "zustanden": 300, "zustandene": 4000, "zuständene": 4000, "zustandenen": 1}
    return words


@pytest.mark.parametrize("size", [1, 3, 50, 20_000])
def test_equals_all_pairs(spark, lexicon, monkeypatch, size):
    monkeypatch.setattr(S, "BLOCK_WORDS", size)
    rows = spark.createDataFrame(list(lexicon.items()), "word string, n long")
    assert found(S.spelling_variants(clash(rows.repartition(4)))) == brute(lexicon)


def test_long_words_share_a_block_by_code_points(spark, lexicon, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_POINTS", 2000)
    assert found(S.spelling_variants(spark.createDataFrame(list(lexicon.items()), "word string, n long"))) == brute(lexicon)


def test_counts(spark, docs, corpus):
    runs = Counter()
    for doc_id, text, *_ in corpus + [(900, "Straße STRASSE ÄRGERLICH ärgerlich x÷y don't " * 9, 0, 0, 0)]:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 3 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            runs[w] += 1
    more = docs.union(spark.createDataFrame([(900, "Straße STRASSE ÄRGERLICH ärgerlich x÷y don't " * 9, "", "", 0)], DOCS))
    got = {r.word: r.n for r in S.count_words(clash(more), shortest=5, least=2, damage=3).collect()}
    assert got == {w: n for w, n in runs.items() if len(w) >= 5 and n >= 2} and "Ärgerlich" in got


def test_words_are_passed_on_before_they_fill_memory(spark, docs, monkeypatch):
    whole = {r.word: r.n for r in S.count_words(docs, shortest=1, least=1).collect()}
    monkeypatch.setattr(S, "HELD", 5)
    assert {r.word: r.n for r in S.count_words(docs, shortest=1, least=1).collect()} == whole


def test_no_words(spark):
    out = S.spelling_variants(S.count_words(spark.createDataFrame([(1, None, None, None, None)], DOCS)))
    assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


words_of = st.lists(st.text(alphabet="ab", min_size=1, max_size=7), min_size=1, max_size=40, unique=True)


@settings(max_examples=200, deadline=None)
@given(words_of)
def test_nodes_are_where_words_part(words):
    words = sorted(words)
    got = {(depth, low, high) for depth, low, high, _ in S.branching_nodes(words)}
    want = set()
    for w in words:
        for d in range(len(w) + 1):
            below = [i for i, x in enumerate(words) if x[:d] == w[:d] and len(x) >= d]
            if len({words[i][d : d + 1] for i in below}) > 1:
                want.add((d, below[0], below[-1] + 1))
    assert got == want


@settings(max_examples=200, deadline=None)
@given(words_of)
def test_light_edges_give_each_near_pair_once(words):
    """A whole trie in one block: errata of light words, looked up or merged with one another, are the near pairs."""
    words = sorted(words)
    pairs = Counter()
    for depth, low, high, starts in S.branching_nodes(words):
        ranges = [(words[s][depth : depth + 1], s, e) for s, e in zip(starts, [*starts[1:], high])]
        heavy = min(((s - e, c) for c, s, e in ranges if c), default=(0, None))[1]
        merged = defaultdict(list)
        for c, s, e in ranges:
            if c != heavy:
                for w in words[s:e]:
                    pairs.update(frozenset((w, x)) for x in S.errata(w, depth, heavy, 1) if x in words)
                    if c:
                        merged[w[depth + 1 :]].append(w)
        pairs.update(frozenset((a, b)) for same in merged.values() for i, a in enumerate(same) for b in same[:i])
    near = near_words(dict.fromkeys(words, 1))
    assert pairs == Counter({frozenset((w, x)): 1 for w in words for x in near[w]})
