"""Toxicity: bags of subword embeddings, averaged by passage, into a linear softmax; trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with its whole form among them), a passage of ``PASSAGE``
words the mean of its words, and a softmax over two classes takes it from there. A passage of fewer words is filled up with
zero vectors, so that one word of a short text does not speak for 24. A document is as toxic as its worst passage, so a few
words in a long text are not averaged away; training follows the same rule. As the softmax's margin is linear in the passage
mean, a trained word comes down to one number, which scoring looks up.

Subwords are those that labelled texts give evidence for: n-grams whose share of toxic documents is further from the
whole share than chance allows. A misspelling unseen in training still shares most of them. Vectors start at the
evidence and are then trained together with the softmax.

Fitted on at most ``TRAIN_ROWS`` labelled rows and about ``TRAIN_CHARS`` characters, in the order of a seeded hash; whole
texts. One task reads the sample and trains; what reaches the driver is the model, of at most ``SUBWORDS`` numbers. Every text
is scored whole.

Defined cases: null and empty texts and texts without letters get the score of an empty passage; unlabelled rows and rows
whose label is null are not learnt from; with no label of one class every score is the class share, smoothed; repeated
rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import staged
from siftwell.llm.words import chunks

TRAIN_ROWS, TRAIN_CHARS = 8_000, 40_000_000
PASSAGE = 24
SIZES = (3, 4, 5, 6)
SUBWORDS, DIMENSIONS, EPOCHS = 20_000, 8, 60
LONGEST_WORD = 40
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHED, _SLOTS = 300_000, 1 << 20


def subwords(word: str) -> set[str]:
    """Character n-grams of a word between marks, and its whole form. A word beyond LONGEST_WORD has those of its pieces."""
    if len(word) > LONGEST_WORD:
        return set().union(*(subwords(word[i : i + LONGEST_WORD]) for i in range(0, len(word), LONGEST_WORD)))
    marked = f"<{word}>"
    return {marked, *(marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1))}


class Model(NamedTuple):
    """margin of each subword, and the softmax's margin of an empty passage."""

    margins: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        parts = subwords(word)
        return sum(self.margins[p] for p in parts if p in self.margins) / len(parts)

    def scores(self, texts: Iterable[str | None], cache: dict[str, float]) -> np.ndarray:
        """Probability that each text is toxic. cache: words met so far; it is emptied when full."""
        out = []
        for text in texts:
            words = _LETTERS.findall((text or "").lower())
            if len(cache) > _CACHED:
                cache.clear()
            for w in set(words):
                if w not in cache:
                    cache[w] = self.word(w)
            if not words:
                out.append(self.bias)
                continue
            sums = np.add.reduceat(np.fromiter(map(cache.__getitem__, words), float, len(words)), np.arange(0, len(words), PASSAGE))
            out.append(float(sums.max()) / PASSAGE + self.bias)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _evidence(df: np.ndarray, bad: np.ndarray, words: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """df, bad: documents and toxic documents with each word. Subwords with evidence -> their row, and their log-odds.

    Counted in hash slots first, so that memory is bounded; subwords in the slots that stand out are then counted each.
    """
    share = bad.sum() / df.sum()
    common = np.flatnonzero(df >= 2).tolist()

    def far(n: np.ndarray, a: np.ndarray) -> np.ndarray:
        return np.abs(a - n * share) / np.sqrt(n * share * (1 - share) + 1)

    slots_n, slots_a = np.zeros(_SLOTS), np.zeros(_SLOTS)
    for k in range(0, len(common), 5_000):
        parts = [[crc32(p.encode()) % _SLOTS for p in subwords(words[w])] for w in common[k : k + 5_000]]
        sizes, at = [len(p) for p in parts], np.concatenate(parts)
        np.add.at(slots_n, at, np.repeat(df[common[k : k + 5_000]], sizes))
        np.add.at(slots_a, at, np.repeat(bad[common[k : k + 5_000]], sizes))
    open_slots = (far(slots_n, slots_a) > 3) & (slots_n >= 5)
    del slots_n, slots_a
    counts: dict[str, list[float]] = {}
    for k in common:
        for part in subwords(words[k]):
            if open_slots[crc32(part.encode()) % _SLOTS]:
                c = counts.setdefault(part, [0, 0])
                c[0] += df[k]
                c[1] += bad[k]
    if not counts:
        return {}, np.zeros(0)
    n, a = np.array(list(counts.values()), float).T
    z = far(n, a)
    chosen = np.flatnonzero((z > 4) & (n >= 5))
    names = list(counts)
    chosen = sorted(chosen, key=lambda k: (-z[k], names[k]))[:SUBWORDS]
    odds = np.log((a + 0.5) / (n - a + 0.5)) - np.log(share / (1 - share))
    return {names[k]: i for i, k in enumerate(chosen)}, odds[chosen]


def train(rows: Iterable[tuple[str | None, int]], seed: int = 7) -> Model:
    """Fit subword vectors and softmax to (text, toxic) rows."""
    vocabulary: dict[str, int] = {}
    documents, labels = [], []
    for text, toxic in rows:
        documents.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in _LETTERS.findall((text or "").lower())), np.int32))
        labels.append(int(toxic))
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model({}, float(np.log(share / (1 - share))))
    words = list(vocabulary)
    distinct = [np.unique(d) for d in documents]
    seen, label = np.concatenate(distinct), np.repeat(y, [len(d) for d in distinct])
    rows_of, odds = _evidence(np.bincount(seen, minlength=len(words)), np.bincount(seen, label, len(words)), words) if len(seen) else ({}, np.zeros(0))
    del distinct, seen, label
    if not rows_of:
        return Model({}, float(np.log(y.mean() / (1 - y.mean()))))
    parts, size = [], np.zeros(len(words))
    for k, w in enumerate(words):
        own = subwords(w)
        size[k] = len(own)
        parts.append(tuple(rows_of[p] for p in sorted(own) if p in rows_of))
    part_count = np.array([len(p) for p in parts])
    # words without a chosen subword are zero: only the others enter the sums
    told = np.flatnonzero(part_count)
    rank = np.full(len(words), -1)
    rank[told] = np.arange(len(told))
    of_word = np.repeat(np.arange(len(told)), part_count[told])
    of_part = np.concatenate([parts[k] for k in told]).astype(int)
    weight = 1 / size[told][of_word]
    passages = np.array([max(1, -(-len(d) // PASSAGE)) for d in documents])
    document = np.repeat(np.arange(len(documents)), passages)
    at = np.concatenate([np.arange(len(d)) // PASSAGE for d in documents]) + np.repeat(np.cumsum(passages) - passages, [len(d) for d in documents])
    word = rank[np.concatenate(documents)]
    at, word = at[word >= 0].astype(np.int32), word[word >= 0].astype(np.int32)
    del documents, parts, vocabulary, words, rank
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (len(rows_of), DIMENSIONS))
    vectors[:, 0] += odds
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
    softmax[0] = [-2.0, 2.0]
    bias = np.array([1.0, -1.0])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    weights = np.where(y == 1, min(4.0, (1 - y).sum() / y.sum()), 1.0)

    def spread(index: np.ndarray, rows: np.ndarray, take: np.ndarray, factor: np.ndarray | None, n: int) -> np.ndarray:
        """Sums of rows[take] * factor by index, one dimension at a time to keep memory low."""
        out = np.empty((n, DIMENSIONS))
        for d in range(DIMENSIONS):
            values = rows[take, d]
            out[:, d] = np.bincount(index, values if factor is None else values * factor, n)
        return out

    for step in range(1, EPOCHS + 1):
        word_vectors = spread(of_word, vectors, of_part, weight, len(told))
        mean = spread(at, word_vectors, word, None, len(document)) / PASSAGE
        margin = mean @ (softmax[:, 1] - softmax[:, 0]) + bias[1] - bias[0]
        order = np.lexsort((margin, document))
        worst = order[np.cumsum(passages) - 1]
        error = weights * (1 / (1 + np.exp(-np.clip(margin[worst], -50, 50))) - y) / weights.sum()
        to_logits = np.zeros((len(document), 2))
        to_logits[worst] = np.stack([-error, error], axis=1)
        to_mean = to_logits @ softmax.T / PASSAGE
        used = to_logits[at, 1] != 0
        to_words = spread(word[used], to_mean, at[used], None, len(told))
        gradients = [spread(of_part, to_words, of_word, weight, len(vectors)) + 1e-6 * vectors, mean.T @ to_logits + 1e-5 * softmax, to_logits.sum(axis=0)]
        for p, g, m in zip((vectors, softmax, bias), gradients, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p -= 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    margins = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model({p: float(margins[k]) for p, k in rows_of.items()}, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, held_in: Column, seed: int = 7) -> Model:
    """Train on the labelled rows of docs for which held_in (of doc_id) holds, a bounded sample of them."""
    marked = labels.filter("toxic is not null and doc_id is not null").filter(held_in).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(marked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    rows = staged(rows, "toxicity-sample")
    share = TRAIN_CHARS / max(1, rows.agg(F.sum(F.length("text"))).first()[0] or 0)
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("chars")), F.lit(1_000_000)) < int(1_000_000 * share))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in chunks(batch))
        model = train((pair for part in parts for pair in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True)), seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.coalesce(1).sortWithinPartitions("doc_id", "text").mapInArrow(trained, "model binary").first()
    return pickle.loads(made.model) if made else train([], seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text").to_pylist(), cache))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(model.scores(part.column("text").to_pylist(), cache) < threshold))

    return docs.mapInArrow(kept, docs.schema)
