"""Benchmark decontamination: a BM25 inverted index of the test items with block maxima, queried by every passage.

The index holds the items; a passage of a training document is the query. An item's impacts are divided by its greatest
possible score, so a score is the share of the item's BM25 weight that the passage has, and one threshold serves all
items. Every term has its postings (item, impact), and for each block of ``BLOCK`` items that it occurs in the greatest of
its impacts there. Terms are numbered by falling maximum, so a passage's terms come strongest first. Block-max WAND: the
pivot is the term after which the maxima of all weaker ones sum to less than half the threshold. Items without a term up to
the pivot cannot reach the threshold, so only blocks in the lists of those terms are opened; a block's bound is the sum of
their maxima in it and of the weaker terms' maxima at large, and only blocks whose bound reaches the threshold are scored.
All items at or above it are retrieved, and each is verified: both its question and its answer must overlap with the passage
in word trigrams, or in runs of the part's own length where it has one or two words. An item's question ends with its first
question mark; without one it is the first half. Many passages are searched at once, as arrays.

Passages are two neighbouring segments, each as long as the longest item of its class (lengths up to 64, 128, ...), so
every occurrence of an item lies in one passage whole, wherever it starts. Words are runs of letters and digits, lower
case within A-Z.

Scale: documents stay where they are; the index of a shard, at most about ``SHARD_ITEMS`` items and ``SHARD_WORDS`` words, is
of bounded size and goes to every task with the code. A larger benchmark is taken in shards, each a pass over the documents;
equal items are indexed once; document frequencies are of all different items.

Defined cases: documents and items that are null, empty or without words match nothing; an item with a null id counts like
any other and is reported with that id; equal items are all reported; rows that repeat a document are each reported; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, staged
from siftwell.llm.words import PLAIN, Words, chunks, rolling, words_of

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.7, 0.5
BLOCK, SHORTEST_CLASS = 4, 64
SHARD_ITEMS, SHARD_WORDS = 2000, 400_000
#: Entries of block lists that are summed at once.
OPENED = 4_000_000
_GRAM = 3
_ROWS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_HITS = "doc_id long, item string, score double, question_overlap double, answer_overlap double"


class Lists(NamedTuple):
    """Lists one after the other: list k is at[k]:at[k + 1] of both arrays."""

    at: np.ndarray
    ids: np.ndarray
    values: np.ndarray

    def opened(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of several lists all entries, one list after the other: the index into k, and the place in the arrays."""
        sizes = self.at[k + 1] - self.at[k]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(np.arange(len(k)), sizes), np.repeat(self.at[k], sizes) + within


class Index(NamedTuple):
    """Items of one length class. fingerprints: of the terms, in order; number: of each the term's number, by falling
    maximum; maxima: of each term; blocks: of each term its blocks with their maxima; items: of each item its terms with
    their impacts, which are the postings by item."""

    segment: int
    fingerprints: np.ndarray
    number: np.ndarray
    sieve: np.ndarray
    maxima: np.ndarray
    blocks: Lists
    items: Lists
    keys: list[str]
    parts: list[tuple[tuple[np.ndarray, int], tuple[np.ndarray, int]]]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are terms, and the terms' numbers."""
        at = np.flatnonzero(self.sieve[hashes >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.fingerprints, hashes[at]), len(self.fingerprints) - 1)
        same = self.fingerprints[k] == hashes[at]
        return at[same], self.number[k[same]]

    def score(self, item: int, present: np.ndarray) -> float:
        a, b = self.items.at[item], self.items.at[item + 1]
        return float(self.items.values[a:b] @ present[self.items.ids[a:b]])


def _grams(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """A part's distinct runs of words, and how many words each has: fewer than three only where the part has fewer."""
    n = max(1, min(_GRAM, len(hashes)))
    return np.unique(rolling(hashes, n)), n


def _question_words(text: str, n: int) -> int:
    """How many of an item's n words are its question."""
    asked = text.find("?") + 1
    k = len(words_of(pa.array([text[:asked]]), table=PLAIN).starts) if asked else 0
    return k if 0 < k < n else max(1, n // 2)


def build(items: list[tuple[str, str]], terms: np.ndarray, frequency: np.ndarray, count: int, mean_words: float) -> list[Index]:
    """Indexes of the items (key, text) by length class. terms: fingerprints of words, in order; frequency: how many of all
    count items have each."""
    words = words_of(pa.array([t for _, t in items], pa.string()), table=PLAIN)
    hashes = words.hashes()
    classes: dict[int, list[int]] = {}
    for k, n in enumerate(np.diff(words.first).tolist()):
        if n:
            classes.setdefault(max(SHORTEST_CLASS, 1 << (n - 1).bit_length()), []).append(k)
    out = []
    for segment, members in sorted(classes.items()):
        own = [hashes[words.first[k] : words.first[k + 1]] for k in members]
        held = [np.unique(h, return_counts=True) for h in own]
        sizes = np.array([len(t) for t, _ in held])
        item = np.repeat(np.arange(len(own)), sizes)
        fingerprints, term = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        df = frequency[np.searchsorted(terms, fingerprints)].astype(float)
        idf = np.log1p((count - df + 0.5) / (df + 0.5))
        tf, length = np.concatenate([n for _, n in held]), np.repeat([len(h) for h in own], sizes)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_words))
        impact /= np.repeat(np.add.reduceat(impact, np.cumsum(sizes) - sizes), sizes)
        maxima = np.zeros(len(fingerprints))
        np.maximum.at(maxima, term, impact)
        order = np.argsort(-maxima, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        term, maxima = number[term], maxima[order]
        by_block = term * (len(own) // BLOCK + 1) + item // BLOCK
        pairs, at = np.unique(by_block, return_inverse=True)
        highest = np.zeros(len(pairs))
        np.maximum.at(highest, at, impact)
        of_term = pairs // (len(own) // BLOCK + 1)
        blocks = Lists(np.searchsorted(of_term, np.arange(len(maxima) + 1)), pairs % (len(own) // BLOCK + 1), highest)
        sieve = np.zeros(1 << 20, bool)
        sieve[fingerprints >> np.uint64(44)] = True
        cuts = [_question_words(items[k][1], len(h)) for k, h in zip(members, own, strict=True)]
        parts = [(_grams(h[:c]), _grams(h[c:])) for c, h in zip(cuts, own, strict=True)]
        out.append(Index(segment, fingerprints, number, sieve, maxima, blocks, Lists(np.concatenate(([0], np.cumsum(sizes))), term, impact), [items[k][0] for k in members], parts))
    return out


def candidates(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """(passage, block) of all blocks whose bound reaches the threshold. passage, term: the terms of each passage, in order."""
    threshold *= 0.999  # sums are not exact
    strength = index.maxima[term]
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    ends = np.append(starts[1:], len(passage))
    upto = np.cumsum(strength)
    rest = np.repeat(upto[ends - 1], ends - starts) - upto + strength  # of a term and all weaker ones of its passage
    strong = rest >= threshold / 2
    light = np.add.reduceat(np.where(strong, 0, strength), starts)
    hopeful = np.repeat(rest[starts] >= threshold, ends - starts)
    at = np.flatnonzero(strong & hopeful)
    if not len(at):
        return
    row = np.repeat(np.arange(len(starts)), ends - starts)[at]
    sizes = np.cumsum(index.blocks.at[term[at] + 1] - index.blocks.at[term[at]])
    many = int(index.blocks.ids.max()) + 1
    a = 0
    while a < len(at):  # as many passages as OPENED entries allow, one at least
        b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + OPENED, "right"))
        b = int(np.searchsorted(row, row[b])) if b < len(at) else b
        b = b if b > a else int(np.searchsorted(row, row[a], "right"))
        of, place = index.blocks.opened(term[at[a:b]])
        pairs, inverse = np.unique(row[a:b][of] * many + index.blocks.ids[place], return_inverse=True)
        bound = np.bincount(inverse, index.blocks.values[place]) + light[pairs // many]
        for pair in pairs[bound >= threshold].tolist():
            yield int(passage[starts[pair // many]]), pair % many
        a = b


def leaks(index: Index, w: Words, hashes: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of every verified hit; an item once a text, its best passage."""
    counts = np.diff(w.first)
    passages = np.maximum(1, -(-counts // index.segment) - 1)
    first = np.cumsum(passages) - passages
    at, term = index.look_up(hashes)
    text = np.searchsorted(w.first, at, "right") - 1
    segment = (at - w.first[text]) // index.segment
    begins, ends = segment < passages[text], segment > 0  # a segment begins one passage and ends another
    passage = first[text] + segment
    keys = np.unique(np.concatenate((passage[begins], passage[ends] - 1)) * len(index.maxima) + np.concatenate((term[begins], term[ends])))
    if not len(keys):
        return
    passage, term = keys // len(index.maxima), keys % len(index.maxima)
    document = np.repeat(np.arange(len(counts)), passages)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    present = np.zeros(len(index.maxima))
    for p, block in candidates(index, passage, term, threshold):
        own = term[slice(*np.searchsorted(passage, [p, p + 1]))]
        present[own] = 1
        scores = [(item, index.score(item, present)) for item in range(block * BLOCK, min((block + 1) * BLOCK, len(index.keys)))]
        present[own] = 0
        for item, score in scores:
            if score >= threshold:
                d = document[p]
                begin = w.first[d] + (p - first[d]) * index.segment
                words = hashes[begin : min(begin + 2 * index.segment, w.first[d + 1])]
                shares = [np.isin(g, rolling(words, n)).mean() if len(g) else 1.0 for g, n in index.parts[item]]
                if min(shares) >= overlap:
                    key, hit = (int(d), item), (score, float(shares[0]), float(shares[1]))
                    found[key] = max(found.get(key, hit), hit)
    for (d, i), hit in found.items():
        yield d, i, *hit


def _keyed(items: DataFrame) -> DataFrame:
    """(item_id, item): ids of items with the key of their text."""
    return items.select(F.col("item_id").cast("long"), F.md5(F.col("text").cast("string").cast("binary")).alias("item")).filter("item is not null")


def shards(items: DataFrame) -> list[list[Index]]:
    """Indexes of the different items (item_id, text), in shards."""
    texts = staged(items.select(F.col("text").cast("string")).filter("text is not null").distinct().withColumn("item", F.md5(F.col("text").cast("binary"))), "items")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = words_of(part.column("text"), table=PLAIN)
                h, text = w.hashes().view(np.int64), np.repeat(np.arange(part.num_rows), np.diff(w.first))
                pairs, n = np.unique(np.stack([text, h]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(pairs[0])), pa.array(pairs[1]), pa.array(n)], ["item", "term", "n"])

    found = staged(texts.select("item", "text").mapInArrow(terms, "item string, term long, n long"), "item-terms")
    frequency = staged(found.groupBy("term").agg(F.count("*").alias("df")), "item-frequencies")
    count, words = found.agg(F.countDistinct("item"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(1, -(-count // SHARD_ITEMS), -(-words // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("item"), F.lit(parts))
    out = []
    for k in range(parts if count else 0):
        own = texts.filter(shard == k).orderBy("item").collect()
        used = frequency.join(found.filter(shard == k).select("term").distinct(), "term", "left_semi").toArrow()  # SHARD_WORDS rows, about, at most
        term = used["term"].to_numpy().view(np.uint64)
        order = np.argsort(term)
        out.append(build([(r.item, r.text) for r in own], term[order], used["df"].to_numpy()[order], count, words / count))
    return out


def _found(part: pa.RecordBatch, indexes: list[Index], threshold: float, overlap: float) -> list[tuple]:
    w = words_of(part.column("text"), table=PLAIN)
    hashes = w.hashes()
    return [(d, index.keys[i], *hit) for index in indexes for d, i, *hit in leaks(index, w, hashes, threshold, overlap)]


def contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each document and each item found in it."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def searched(indexes: list[Index]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    hits = _found(part, indexes, threshold, overlap)
                    columns = list(zip(*hits, strict=True)) or [()] * 5
                    ids = part.column("doc_id").take(pa.array(columns[0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.string()), *(pa.array(c, pa.float64()) for c in columns[2:])], ["doc_id", "item", "score", "question_overlap", "answer_overlap"])

        return texts.mapInArrow(search, _HITS)

    found = [searched(indexes) for indexes in shards(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], _ROWS)
    return reduce(DataFrame.unionByName, found).join(bounded(staged(_keyed(items), "item-keys")), "item").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def without_contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found."""

    def cleaned(df: DataFrame, indexes: list[Index]) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, *_ in _found(part, indexes, threshold, overlap)]] = False
                    yield part.filter(pa.array(keep))

        return df.mapInArrow(clean, docs.schema)

    return reduce(cleaned, shards(items), docs)
