"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, texts
from .learning import labelled, sample, with_fold

#: Hashed columns: a word and its beginnings of these lengths, in code points.
BITS, BEGINNINGS = 20, (4, 5, 6)
WORDS = re.compile(r"[^\W_]+")
#: Words that a task remembers.
CACHE = 150_000


def _columns(word: str) -> list[int]:
    """Columns of a lower-cased word: itself and its beginnings."""
    import xxhash

    return [xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in [word + "\n", *(word[:n] for n in BEGINNINGS if len(word) >= n)]]


def _words(text: bytes) -> set[str]:
    return set(WORDS.findall(text.decode("utf-8", "replace").lower()))


class _Remembered(dict):
    """What ``of`` makes of a word, computed once while it is remembered."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.clear()
        x = self[word] = self.of(word)
        return x


def _features(rows: DataFrame) -> list[np.ndarray]:
    """Columns of every row's distinct words, one array a row; ``rows`` is a bounded sample."""

    def run(batches):
        columns = _Remembered(_columns)
        for b in small(batches):
            found = [np.array([c for w in _words(t) for c in columns[w]], np.uint32).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["columns"])

    got = rows.select("text").mapInArrow(run, "columns binary").toArrow()
    return [np.frombuffer(x, np.uint32) for x in got.column(0).to_pylist()]


def _occurrences(rows: DataFrame, known: np.ndarray) -> tuple[int, np.ndarray]:
    """Of all ``rows``: how many they are, and in how many each of the ``known`` columns occurs."""

    def run(batches):
        own, count, n = {c: c for c in known.tolist()}, np.zeros(1 << BITS, np.int64), 0
        columns = _Remembered(lambda w: tuple(own[c] for c in _columns(w) if c in own))
        for b in small(batches):
            found: list[int] = []
            for text in texts(b):
                found += {c for some in map(columns.__getitem__, _words(text)) if some for c in some}
            count += np.bincount(np.array(found, np.int64), minlength=1 << BITS)
            n += b.num_rows
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *count[at].tolist()], pa.int64())], ["slot", "n"])

    got = rows.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    counts = np.zeros(1 << BITS, np.int64)
    counts[slot[slot >= 0]] = n[slot >= 0]
    return int(n[slot < 0].sum()), counts


def _flat(docs: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept columns of all documents end to end, renumbered by ``at`` (-1: dropped), and the document of each."""
    kept = [x[x >= 0] for x in (at[d] for d in docs)]
    return np.concatenate(kept), np.repeat(np.arange(len(docs)), [len(x) for x in kept])


def _frequencies(docs: list[np.ndarray]) -> np.ndarray:
    """In how many documents each column occurs."""
    out = np.zeros(1 << BITS, np.int32)
    for d in docs:
        out[np.unique(d)] += 1
    return out


def risk(w: np.ndarray, p: tuple, u: tuple, n_p: int, n_u: int, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The parts of the PU risk with the logistic loss for weights and, last, bias: prior * E_p[l(f)], the corrected
    negative risk E_u[l(-f)] - prior * E_p[l(-f)], and their gradients."""

    def scores(x, n):
        return np.bincount(x[1], weights=w[x[0]], minlength=n) + w[-1]

    def slope(x, g):
        return np.append(np.bincount(x[0], weights=g[x[1]], minlength=len(w) - 1), g.sum())

    fp, fu = scores(p, n_p), scores(u, n_u)
    sp, su = 1 / (1 + np.exp(-np.clip(fp, -40, 40))), 1 / (1 + np.exp(-np.clip(fu, -40, 40)))
    positive, negative = prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return positive, negative, slope(p, prior * (sp - 1) / n_p), slope(u, su / n_u) - slope(p, prior * sp / n_p)


def nnpu(p: tuple, u: tuple, n_p: int, n_u: int, width: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float | None = None):
    """Weights and bias of a linear classifier that minimise the non-negative PU risk, positive + max(0, negative), by
    full-batch Adam until it stands still. Where the corrected negative risk is below zero, its gradient is followed
    backwards, so the model unlearns what it has learnt by heart; as that makes the last steps swing about the risk's
    edge, the result is the mean of the second half of them. Weights decay as under a prior of variance one (``decay``: one
    by the number of positives)."""
    decay = 1 / max(1, n_p) if decay is None else decay
    w, mean = np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, negative, up, down = risk(w, p, u, n_p, n_u, prior)
        g = up + down if negative >= 0 else -down
        g[:-1] += decay * w[:-1]
        if np.abs(g).max() < 1e-7:
            return w[:-1], w[-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if 2 * t > rounds:
            mean += w
    mean /= rounds - rounds // 2
    return mean[:-1], mean[-1]


def _telling(p_df: np.ndarray, n_p: int, u_df: np.ndarray, n_u: int, measure: float) -> np.ndarray:
    """Which columns occur in positives over 2 * measure times as often as in all, and 5 * measure deviations more."""
    chance = n_p * (u_df + 0.5) / max(1, n_u)
    return (p_df >= 3) & (p_df > 2 * measure * chance) & (p_df - chance >= 5 * measure * np.sqrt(chance + 0.5))


def train(rows: DataFrame, labels: DataFrame, label_col: str, most_positive: int, most_unlabelled: int) -> tuple[dict[int, float], float]:
    """Weights of the columns that have one and the bias, from confirmed positives and unlabelled texts of ``with_fold`` rows."""
    known = labelled(rows, labels, label_col)
    n = {r.y: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, prior = n.get(1, 0), 0.0
    if not n_pos:
        return {}, -40.0
    prior = min(0.95, n_pos / sum(n.values()))
    pos = _features(sample(known.where("y = 1"), n_pos, most_positive, "positive"))
    if not pos:
        return {}, float(np.log(prior / (1 - prior)))
    free = rows.where(~F.col("held_out"))
    unl = _features(sample(free, free.count(), most_unlabelled, "unlabelled"))
    if not unl:
        return {}, float(np.log(prior / (1 - prior)))
    # Columns more frequent in positives than chance lets them be; the rest carries no sign of toxicity. Those that are
    # by half the measure against the sample are counted in all texts.
    p_df = _frequencies(pos)
    some = np.flatnonzero(_telling(p_df, len(pos), _frequencies(unl), len(unl), 0.5))
    n_all, u_df = _occurrences(free, some)
    keep = some[_telling(p_df, len(pos), u_df, n_all, 1.0)[some]]
    at = np.full(1 << BITS, -1, np.int32)
    at[keep] = np.arange(len(keep))
    w, bias = nnpu(_flat(pos, at), _flat(unl, at), len(pos), len(unl), len(keep), prior)
    return dict(zip(keep.tolist(), w.tolist())), float(bias)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = 4000, most_unlabelled: int = 16_000, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``(doc_id, held_out, score)`` and the columns ``carry`` per row of ``docs``: the probability that the whole text is toxic.

    Learns outside the held-out fold: which words mark toxicity from about ``most_positive`` texts whose label is 1,
    held against all texts there, whose labels are not looked at; their weights from the same positives and about
    ``most_unlabelled`` of all texts. The class prior is the share of 1 among all labels there. Null and empty texts get the score of a text without words. Without any positive label all scores
    are near 0. Repeated rows stay rows, a null id is scored like any other; other columns are not read.
    """
    rows = with_fold(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, labels, label_col, most_positive, most_unlabelled))

    def run(batches):
        weights, bias = sent.value
        weight = _Remembered(lambda word: sum(weights.get(c, 0.0) for c in _columns(word)))
        for b in small(batches):
            f = np.array([math.fsum(map(weight.__getitem__, _words(t))) for t in texts(b)], np.float64) + bias
            own = ["doc_id", "held_out", *carry]
            yield pa.RecordBatch.from_arrays([*map(b.column, own), pa.array(1 / (1 + np.exp(-np.clip(f, -40, 40))))], [*own, "score"])

    given = with_fold(docs, id_col, text_col, *[c for c in carry if c != "text"])
    schema = T.StructType([*given.select("doc_id", "held_out", *carry).schema.fields, T.StructField("score", T.DoubleType())])
    return given.mapInArrow(run, schema)
