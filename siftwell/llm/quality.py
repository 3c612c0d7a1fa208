"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian. Its covariance is shrunk towards the diagonal of the pooled variances, so that it can be
inverted whatever the sample; its Cholesky factor is inverted once and kept with the model. A document's score is the
logistic of the difference of the two log-densities (Mahalanobis distance and log-determinant) plus that of the priors.

The statistics of every document are computed in one pass and staged as a narrow table; class means and covariances come
from one grouped aggregation over all labelled rows, so nothing is sampled and no rows reach the driver but the sums.

Defined cases: null, empty and blank texts have the statistics of a text without words and are scored by them; rows
without a label are not learnt from; where a class has fewer than two rows every score is the class share, smoothed;
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import staged
from siftwell.llm.words import chunks, rolling, words_of

SHRINKAGE = 0.1
STATISTICS = (
    "words", "word_length", "distinct_words", "most_common", "repeated_runs", "upper", "digits", "symbols", "stops", "word_symbols",
    "symbol_tails", "line_words", "other_bytes", "capitalised", "length_spread", "bars",
)
_UPPER, _LOWER, _DIGIT, _STOP, _HIGH, _SYMBOL = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = _HIGH[128:] = True
_STOP[[33, 44, 46, 58, 59, 63]] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_UPPER | _LOWER | _DIGIT | _STOP)


def _sums(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(flags)))
    return (upto[cuts[1:]] - upto[cuts[:-1]]).astype(float)


def _repeats(hashes: np.ndarray, document: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: how many of its hashes it has had before, and how often it has its most common one."""
    again, most = np.zeros(n), np.zeros(n)
    if len(hashes):
        order = np.lexsort((hashes, document))
        h, d = hashes[order], document[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        at = np.flatnonzero(new)
        again = np.bincount(d[~new], minlength=n).astype(float)
        np.maximum.at(most, d[at], np.diff(at, append=len(h)))
    return again, most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    w = words_of(texts)
    n, count = len(texts), np.diff(w.first).astype(float)
    document = np.repeat(np.arange(n), np.diff(w.first))
    cuts = np.zeros(n + 1, np.int64)  # of the bytes of each text's words, with what stands between
    some = count > 0
    cuts[:-1][some] = w.starts[w.first[:-1][some]]
    ends = np.zeros(n, np.int64)
    ends[some] = w.ends[w.first[1:][some] - 1]

    def inside(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(flags[w.data])))
        return (upto[ends] - upto[cuts[:-1]]).astype(float)

    lengths = (w.ends - w.starts).astype(float)
    words, letters = np.maximum(count, 1), np.maximum(_sums(lengths, w.first), 1)
    hashes = w.hashes()
    runs = rolling(hashes, 4)
    whole = document[: len(runs)] == document[3:] if len(runs) else np.zeros(0, bool)
    repeated, most = _repeats(hashes, document, n)
    rerun, _ = _repeats(runs[whole], document[: len(runs)][whole], n)
    last = w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    first = w.data[w.starts] if len(w.starts) else last
    upper, lower = inside(_UPPER), inside(_LOWER)
    lines, bars, one = np.zeros(256, bool), np.zeros(256, bool), np.ones(n)
    lines[10] = bars[124] = True
    rate = lambda part, of: np.log((part + 0.5) / (of - part + 0.5).clip(0.5))
    columns = (
        np.log1p(count),
        np.log(letters / words),
        rate(repeated, words),
        rate(most, words),
        rate(rerun, words),
        rate(upper, upper + lower),
        rate(inside(_DIGIT), letters),
        rate(inside(_SYMBOL), letters),
        rate(inside(_STOP), letters),
        rate(_sums(_SYMBOL[last], w.first), words),
        rate(_sums(_STOP[last], w.first), words),
        np.log(words / (inside(lines) + one)),
        rate(inside(_HIGH), letters),
        rate(_sums(_UPPER[first], w.first), words),
        np.log1p(np.maximum(0, _sums(lengths**2, w.first) / words - (letters / words) ** 2)),
        rate(inside(bars), letters),
    )
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row of docs; x holds the statistics in the order of STATISTICS."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = statistics(part.column("text"))
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, "doc_id long, x array<double>")


class Model(NamedTuple):
    """Of each class: mean, inverse Cholesky factor, log-determinant / 2; and the log-odds of the priors."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    halves: list[float]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.prior)
        for sign, mean, factor, half in zip((-1, 1), self.means, self.factors, self.halves, strict=False):
            margin += sign * (-0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) - half)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def model_of(counts: list[int], sums: list[np.ndarray], products: list[np.ndarray], shrinkage: float = SHRINKAGE) -> Model:
    """From the sums of x and of its outer products by class (0, 1)."""
    prior = float(np.log((counts[1] + 0.5) / (counts[0] + 0.5)))
    if min(counts) < 2:
        return Model([], [], [], prior)
    means = [s / c for s, c in zip(sums, counts, strict=True)]
    own = [p / c - np.outer(m, m) for p, c, m in zip(products, counts, means, strict=True)]
    pooled = sum(c * np.diag(v) for c, v in zip(counts, own, strict=True)) / sum(counts)
    factors, halves = [], []
    for v in own:
        factor = np.linalg.cholesky((1 - shrinkage) * v + np.diag(shrinkage * np.maximum(pooled, 0) + 1e-3))
        factors.append(np.linalg.inv(factor))
        halves.append(float(np.log(np.diag(factor)).sum()))
    return Model(means, factors, halves, prior)


def fit(stats: DataFrame, labels: DataFrame, held_in: Column, shrinkage: float = SHRINKAGE) -> Model:
    """Learn from the labelled rows of stats (doc_id, x) for which held_in (of doc_id) holds."""
    d = len(STATISTICS)
    marked = labels.filter("quality in (0, 1) and doc_id is not null").filter(held_in).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    rows = stats.join(marked, F.col("doc_id") == F.col("_id"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    moments = rows.groupBy("quality").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("p"))
    counts, sums, products = [0, 0], [np.zeros(d), np.zeros(d)], [np.zeros((d, d)), np.zeros((d, d))]
    for row in moments.collect():  # two rows at most
        counts[row.quality], sums[row.quality] = row.n, np.array(row.s)
        for (i, j), value in zip(pairs, row.p, strict=True):
            products[row.quality][i, j] = products[row.quality][j, i] = value
    return model_of(counts, sums, products, shrinkage)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of stats."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_in: Column, shrinkage: float = SHRINKAGE) -> DataFrame:
    """(doc_id, score) of every row of docs, learnt from those of its labelled rows for which held_in holds."""
    stats = staged(with_statistics(docs), "statistics")
    return score(stats, fit(stats, labels, held_in, shrinkage))
