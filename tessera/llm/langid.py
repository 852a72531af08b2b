"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, texts
from .learning import with_fold

#: Character n-grams of these lengths, dealt out to 2**BITS columns of the log-probability matrix.
NGRAMS, BITS = (2, 3), 15
#: Characters that are scored at a time; a longer text is scored in pieces.
PIECE = 1 << 20


def _letters(text: bytes) -> np.ndarray:
    """Code points of the lower-cased text between two spaces; anything but letters and marks is a space, runs of it one.
    A text without a letter has none."""
    import regex

    low = text.decode("utf-8", "replace").lower()
    plain = (re.sub(r"[^a-z]+", " ", low) if low.isascii() else regex.sub(r"[^\p{L}\p{M}]+", " ", low)).strip()
    if not any(map(str.isalpha, plain)):
        return np.empty(0, np.uint32)
    return np.frombuffer(f" {plain} ".encode("utf-32-le", "replace"), np.uint32)


def _columns(points: np.ndarray):
    """Hashed columns of all n-grams, in pieces: their length, the columns, and where each begins."""
    for at in range(0, len(points), PIECE):
        x = points[at : at + PIECE + max(NGRAMS) - 1].astype(np.uint32)
        for n in NGRAMS:
            size = min(PIECE, len(points) - at - n + 1)
            if size > 0:
                h = x[:size] * np.uint32(0x9E3779B1) + np.uint32(n)
                for k in range(1, n):
                    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[k : size + k] * np.uint32(0x9E3779B1)
                yield n, ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS)).astype(np.int64), np.arange(at, at + size)


def _counts(texts: list[bytes]):
    """``(text, column, count)`` arrays, in pieces: how often each column's n-grams stand in each text."""
    points = [_letters(t) for t in texts]
    size = sum(map(len, points))
    if not size:
        return
    ends = np.cumsum([len(x) for x in points])
    whole = np.concatenate(points)
    for n, cols, place in _columns(whole):
        own = np.searchsorted(ends, place, "right")
        inside = place + n <= ends[own]  # all of it in one text
        keys, count = np.unique(own[inside] << BITS | cols[inside], return_counts=True)
        yield keys >> BITS, keys & ((1 << BITS) - 1), count


def _ngram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, slot, n)`` summed over all rows ``(lang, text)``; slot -1 counts documents."""

    def run(batches):
        seen: dict[str, np.ndarray] = {}
        docs: Counter = Counter()
        for b in small(batches):
            langs = b.column(0).to_pylist()
            docs.update(langs)
            row = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
            of = np.array([row[x] for x in langs], np.int64)
            for text, cols, count in _counts(texts(b)):
                into = np.bincount(of[text] << BITS | cols, weights=count, minlength=len(row) << BITS).reshape(len(row), -1)
                for lang, i in row.items():
                    seen[lang] = seen.get(lang, 0) + into[i]
        for lang, n in docs.items():
            counts = seen.get(lang, np.zeros(1 << BITS)).astype(np.int64)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *counts[at].tolist()], pa.int64())], ["lang", "slot", "n"]
            )

    return rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the matrix (2**BITS, languages) of log probabilities, from all ``rows(lang, text)``.

    Counts are summed on the executors; what comes to the driver has at most 2**BITS + 1 rows for each language."""
    got = _ngram_counts(rows).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    row = np.array([langs.index(x) for x in got.column("lang").to_pylist()], np.int64)
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    counts, docs = np.zeros((1 << BITS, len(langs))), np.ones(len(langs))
    docs[row[slot < 0]] = n[slot < 0]
    counts[slot[slot >= 0], row[slot >= 0]] = n[slot >= 0]
    matrix = np.log((counts + smoothing) / (counts.sum(0) + smoothing * (1 << BITS)))
    return langs, np.log(docs / docs.sum()), matrix


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row; ``score`` is the posterior probability of ``lang_pred``.

    Learns from the texts and non-null languages of the rows outside the held-out fold, all of them. A text that is
    null or has no letter is ``und`` with score 0, as is every text if no language is known. Texts count whole;
    equally likely languages: the first by code point. Repeated rows stay rows; other columns are not read.
    """
    rows = with_fold(docs, id_col, text_col, F.col(lang_col).alias("lang"))
    langs, prior, matrix = train(rows.where("not held_out and lang is not null").select("lang", "text"))
    sent = docs.sparkSession.sparkContext.broadcast((langs, prior, matrix))

    def run(batches):
        langs, prior, matrix = sent.value
        for b in small(batches):
            own = texts(b)
            log, known = np.tile(prior.astype(np.float64), (len(own), 1)), np.zeros(len(own), bool)
            for text, cols, count in _counts(own) if langs else ():
                start = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                log[text[start]] += np.add.reduceat(matrix[cols] * count[:, None], start)  # sparse rows times the matrix
                known[text[start]] = True
            best = log.argmax(1) if langs else np.zeros(len(own), int)
            names = [langs[i] if k else "und" for i, k in zip(best.tolist(), known.tolist())]
            scores = np.where(known, 1 / np.exp(log - log.max(1, keepdims=True)).sum(1), 0.0) if langs else np.zeros(len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
