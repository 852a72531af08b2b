"""Quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, texts
from .learning import labelled, with_fold

STATISTICS = (
    "log words", "bytes a word", "upper case", "digits", "beyond ASCII", "stops and commas", "other signs", "lines a word",
    "distinct words", "compressed size", "signs at word ends", "most frequent sign",
)


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text: shares go through a logarithm, so that small ones are told apart."""
    import zlib

    words, n = text.split(), max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, high = count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum()
    signs = count[33:127].sum() - upper - lower - digits
    stops = count[44] + count[46]
    others = np.concatenate([count[33:44], count[45:46], count[47:48], count[58:65], count[91:97], count[123:127]])
    k = max(1, len(words))
    share = [upper / max(1, upper + lower), digits / n, high / n, stops / k, (signs - stops) / n, count[10] / k]
    ends = sum(not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,") for w in words) / k
    more = [len(set(words)) / k, min(1.0, len(zlib.compress(text, 1)) / n), ends, others.max() / k]
    return [np.log1p(len(words)), np.log1p(n / k), *(np.log(x + 0.003) for x in share), *(np.log(x + 0.01) for x in more)]


def _matrix(batch) -> np.ndarray:
    return np.array([statistics(t) for t in texts(batch)]).reshape(batch.num_rows, len(STATISTICS))


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 0.02):
    """For each class its log prior, mean and the inverse Cholesky factor of its covariance, from all ``rows(text, y)``.

    Sums, cross products and counts are added up on the executors. Each covariance is shrunk towards that of both
    classes and by a ridge, so a class of few rows has a factor too. None if a class has no row."""

    def run(batches):
        n, s, x2 = np.zeros(2), np.zeros((2, len(STATISTICS))), np.zeros((2, len(STATISTICS), len(STATISTICS)))
        for b in small(batches):
            x, y = _matrix(b), b.column("y").to_numpy()
            for c in (0, 1):
                v = x[y == c]
                n[c], s[c], x2[c] = n[c] + len(v), s[c] + v.sum(0), x2[c] + v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([n, s.ravel(), x2.ravel()]).tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = rows.select("text", "y").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "part"))
    d = len(STATISTICS)
    total = np.zeros(2 + 2 * d * (1 + d))
    for r in parts.groupBy("at").agg(F.sum("part").alias("total")).collect():
        total[r["at"]] = r["total"]
    n, s, x2 = total[:2], total[2 : 2 + 2 * d].reshape(2, d), total[2 + 2 * d :].reshape(2, d, d)
    if not n.all():
        return None
    mean = s / n[:, None]
    cov = [x2[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    out = []
    for c in (0, 1):
        a = shrink * min(1.0, 10 * d / n[c]) + (d / (n[c] + d)) * (1 - shrink)
        sigma = (1 - a) * cov[c] + a * both + ridge * np.diag(np.diag(both)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(sigma)
        out.append((np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum(), mean[c], np.linalg.inv(factor)))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score)`` per row of ``docs``: the probability that the whole text is of quality 1.

    Learns from all labelled rows outside the held-out fold. A score is the logistic of the difference of the classes'
    log densities, each a Mahalanobis distance by a cached Cholesky factor. Null and empty texts are scored as texts
    without words. If a class has no label, all scores are 0.5. Repeated rows stay rows, a null id is scored like any
    other; other columns are not read.
    """
    rows = with_fold(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(fit(labelled(rows, labels, label_col)))

    def run(batches):
        model = sent.value
        for b in small(batches):
            f = np.zeros(b.num_rows)
            if model and b.num_rows:
                x = _matrix(b)
                log = [base - 0.5 * (((x - mean) @ inv.T) ** 2).sum(1) for base, mean, inv in model]
                f = np.clip(log[1] - log[0], -40, 40)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(1 / (1 + np.exp(-f)))], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
