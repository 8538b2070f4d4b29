"""Quality scores by regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import raw, slices, stored, text_rows
from millrace.llm.words import words

NAMES = ["length", "word_len", "distinct", "repeats", "top_word", "upper", "symbols", "bars", "digits", "stops", "lines", "short", "capital"]
SHRINKAGE = 0.05
THRESHOLD = 0.3

#: Short texts vary: each share is taken with so many more bytes and words of usual prose.
EXTRA_BYTES, EXTRA_WORDS = 60, 10
USUAL = {"upper": 0.025, "symbols": 0.0, "bars": 0.0, "digits": 0.0, "stops": 0.03, "repeats": 0.0, "top_word": 0.1, "lines": 0.02, "short": 0.4, "capital": 0.15}

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"!#$%&*+<=>@[]^_`{}~\\/"
_STOPS = b".,;:?"


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of the whole text, in the order of NAMES: roots of shares, logarithms of sizes."""
    found = words(text)
    n = len(found)
    size = max(len(text), 1)
    by_bytes = lambda name, chars: np.sqrt((size - len(text.translate(None, chars)) + EXTRA_BYTES * USUAL[name]) / (size + EXTRA_BYTES))
    by_words = lambda name, count: np.sqrt((count + EXTRA_WORDS * USUAL[name]) / (n + EXTRA_WORDS))
    if not n:
        return [0.0] * len(NAMES)
    counts: dict[bytes, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    values = [
        np.log1p(n) / 4,
        np.log1p((size + EXTRA_BYTES) / (n + EXTRA_WORDS)) / 2,
        (np.log(len(counts)) + 1) / (np.log(n) + 1),
        by_words("repeats", sum(a == b for a, b in pairwise(found))),
        by_words("top_word", max(counts.values())),
        by_bytes("upper", _UPPER),
        by_bytes("symbols", _SYMBOLS),
        by_bytes("bars", b"|"),
        by_bytes("digits", _DIGITS),
        by_bytes("stops", _STOPS),
        by_words("lines", text.count(b"\n")),
        by_words("short", sum(c for w, c in counts.items() if len(w) <= 3)),
        by_words("capital", sum(c for w, c in counts.items() if w[:1].isupper())),
    ]
    return [float(v) for v in values]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row of docs; null, empty and blank texts have zeros throughout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = [statistics(t) for t in raw(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return text_rows(docs).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """A Gaussian for each class: mean, inverse Cholesky factor of the shrunk covariance, log determinant, prior."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, from the difference of the log densities."""
        logs = []
        for mean, factor, log_det, prior in zip(self.means, self.factors, self.log_dets, self.log_priors, strict=True):
            z = (x - mean) @ factor.T
            logs.append(prior - 0.5 * (log_det + (z * z).sum(axis=1)))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(training: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From (label 0/1, x): sums and sums of products by class are made where the rows are, one row a class comes back.

    Rows of null label or x are left out. Without a row of some class, both classes get the same Gaussian, so
    every score is the share of label 1 (smoothed).
    """
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = lambda i: F.col("x")[i]
    sums = [F.sum(x(i)).alias(f"s{i}") for i in range(d)] + [F.sum(x(i) * x(j)).alias(f"p{i}_{j}") for i, j in pairs]
    rows = training.where("label in (0, 1) and x is not null").groupBy("label").agg(F.count("*").alias("n"), *sums).collect()
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        c = int(r["label"])
        n[c] = r["n"]
        s[c] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            p[c, i, j] = p[c, j, i] = r[f"p{i}_{j}"]
    total = max(n.sum(), 1)
    pooled_mean = s.sum(0) / total
    pooled = p.sum(0) / total - np.outer(pooled_mean, pooled_mean)
    # covariances shrink towards the pooled one's diagonal; a floor keeps statistics that never vary in training harmless
    target = np.diag(np.maximum(np.diag(pooled), 1e-4))
    means, factors, log_dets = [], [], []
    for c in (0, 1):
        if n.min() == 0:
            mean, cov = pooled_mean, pooled
        else:
            mean = s[c] / n[c]
            cov = p[c] / n[c] - np.outer(mean, mean)
        shrunk = (1 - shrinkage) * cov + shrinkage * target
        lower = np.linalg.cholesky(shrunk)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    priors = np.log((n + 1) / (n.sum() + 2))
    return Discriminant(np.array(means), np.array(factors), np.array(log_dets), priors)


def held_out(doc_id):
    """Whether crc32 of doc_id as text leaves no remainder by 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def score(features_: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of each row of features_; predicted is 1 from the threshold on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist(), float)
                s = model.scores(x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return features_.mapInArrow(run, "doc_id long, score double, predicted int")


def train_and_score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, by a model of the labelled rows not held out.

    Statistics of all texts are made once and kept in the shared folder. Labels of null or other values, of
    held-out or null doc_ids, or without a document, teach nothing; a document labelled twice counts twice.
    Repeated rows get a row each. A null doc_id is never held out. An empty table gives no rows; without labels
    of both classes every score is the same.
    """
    made = stored(features(docs), "quality-features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    training = made.join(known.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id"))), "doc_id")
    out = score(made, fit(training), threshold)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
