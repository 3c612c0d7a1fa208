"""Cross-entropy difference: target and background bigram models with one vocabulary score every document.

Both models count words and word pairs over whole texts of all documents, the background over all of them, the target over
those marked. Counts are exact for each word and pair, by 63-bit fingerprints, and their number grows with the corpus. The
models are matched in that the background's counts are scaled to the target's size, and both are smoothed alike: a pair
backs off to its word, a word to the uniform distribution over the words counted. A document's score is the mean over its
words of target loss minus background loss in nats: the lower, the more it is like the target. What a document itself added
to the counts is taken out before it is scored, so no document is judged by its own words.

Texts are packed into blocks of about ``BLOCK_BYTES``. The models are sharded by ranges of fingerprints, as many as the size
of the texts asks for: a block sends each shard its distinct fingerprints with their counts, and gets back the totals of
just these. No task and no driver holds a whole model, and a word or pair in a third of the rows is one entry a block. Arrays
over a block are few, its texts are hashed and scored in parts, and a shard adds up packet by packet, so that a worker's
memory stays near the size of its keys.

Defined cases: a document without words (null, empty, blank) has 0 words and losses and score 0; without any target row
the target model is uniform; repeated rows count and score each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import staged
from siftwell.llm.words import chunks, mixed, words_of

BLOCK_BYTES, SHARD_BYTES, SHARDS = 8_000_000, 32_000_000, 64
#: Bytes of a block that are hashed at once, and words that are scored at once; a longer text is taken alone.
PART_BYTES, PART_WORDS = 500_000, 100_000
PAIR_BACKOFF, WORD_BACKOFF = 4.0, 1000.0
_START = np.uint64(0x5EED0)
_PAIR = np.uint64(1)
_SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers with their like bytes together, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(data.reshape(8, -1).T).reshape(-1).view(np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values of x in order. x itself is sorted."""
    x.sort()
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of x in order, and where in them each entry of x is."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    rank = np.empty(len(x), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], rank


class Block(NamedTuple):
    """Texts with their distinct fingerprints in order (even: words, odd: pairs), and where in them each word, the word
    before it (a document starts after a mark of its own) and the pair of both are."""

    keys: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    count: np.ndarray
    doc_id: pa.Array
    target: np.ndarray

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def firsts(self) -> np.ndarray:
        return (np.cumsum(self.count) - self.count)[self.count > 0]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the target and the background have each fingerprint; every start mark is a word."""
        flags, begun, n = np.repeat(self.target, self.count), self.firsts(), len(self.keys)
        ours, all_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at, mine in ((self.word, flags), (self.pair, flags), (self.before[begun], flags[begun])):
            ours += np.bincount(at[mine], minlength=n)
            all_ += np.bincount(at, minlength=n)
        return ours, all_

    def own(self, at: np.ndarray) -> np.ndarray:
        """How often each entry occurs in its own text."""
        _, rank = _ranked(self.text() * len(self.keys) + at)
        return np.bincount(rank)[rank]

    def parts(self) -> Iterator[Block]:
        """The texts in runs of about PART_WORDS words, a text at least, with the keys of all."""
        ends, at = np.cumsum(self.count), 0
        while at < len(self.count):
            base = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + PART_WORDS, "right")))
            s = slice(base, int(ends[upto - 1]))
            yield Block(self.keys, self.word[s], self.before[s], self.pair[s], self.count[at:upto], self.doc_id[at:upto], self.target[at:upto])
            at = upto

    def losses(self, totals: tuple[np.ndarray, np.ndarray], sums: tuple[int, int], vocabulary: int) -> list[np.ndarray]:
        """Of each text the mean target loss and background loss. totals: of keys, by target and background; sums: of all words."""
        found = [part._losses(totals, sums, vocabulary) for part in self.parts()]
        return [np.concatenate([np.zeros(0), *(x[k] for x in found)]) for k in (0, 1)]

    def _losses(self, totals: tuple[np.ndarray, np.ndarray], sums: tuple[int, int], vocabulary: int) -> list[np.ndarray]:
        scale = sums[0] / sums[1] if sums[1] else 0.0
        own_word, own_pair = self.own(self.word), self.own(self.pair)
        own_before = np.concatenate(([1], own_word[:-1])) if len(own_word) else own_word
        own_before[self.firsts()] = 1
        out = []
        for total, sum_, factor, seen in ((totals[0], sums[0], 1.0, self.target[self.text()].astype(float)), (totals[1], sums[1], scale, scale)):
            word = (total[self.word] * factor + WORD_BACKOFF / max(1, vocabulary)) / (sum_ * factor + WORD_BACKOFF)
            pairs, contexts = (np.maximum(total[at] * factor - seen * own, 0) for at, own in ((self.pair, own_pair), (self.before, own_before)))
            loss = -np.log((pairs + PAIR_BACKOFF * word) / (contexts + PAIR_BACKOFF))
            upto = np.concatenate(([0.0], np.cumsum(loss)))
            ends = np.cumsum(self.count)
            out.append((upto[ends] - upto[ends - self.count]) / np.maximum(self.count, 1))
        return out


def _opened(body: bytes) -> Block:
    words, pairs, counts, ids, targets = [], [], [], [], []
    for batch in pa.ipc.open_stream(body):
        for part in chunks(batch, most=PART_BYTES):
            w = words_of(part.column("text"))
            hashes = w.hashes() & ~_PAIR
            before = np.concatenate(([_START], hashes[:-1])) if len(hashes) else hashes
            before[w.first[:-1][np.diff(w.first) > 0]] = _START
            words.append(hashes)
            pairs.append(mixed(before * np.uint64(0x9E3779B97F4A7C15) + hashes) | _PAIR)
            counts.append(np.diff(w.first))
            ids.append(part.column("doc_id"))
            targets.append(part.column("target").to_numpy(zero_copy_only=False).astype(bool))
    (word_keys, word), (pair_keys, pair) = (_ranked(_joined(x)) for x in (words, pairs))
    keys = _distinct(np.concatenate((word_keys, pair_keys, [_START] if len(word) else word_keys)))
    word, pair = (np.searchsorted(keys, of).astype(np.int32)[rank] for of, rank in ((word_keys, word), (pair_keys, pair)))
    block = Block(keys, word, np.roll(word, 1), pair, np.concatenate(counts), pa.concat_arrays(ids), np.concatenate(targets))
    block.before[block.firsts()] = np.searchsorted(keys, _START)
    return block


def _joined(found: list[np.ndarray]) -> np.ndarray:
    """The arrays of a list in one; the list is empty then."""
    out = np.concatenate(found)
    found.clear()
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """(block, size, body): the rows (doc_id, text, target) packed together, and their bytes of text."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 32

        def taken() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "body"])

        for batch in batches:
            for part in chunks(batch):
                held.append(part)
                size += part.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield taken()
                    held, size, block = [], 0, block + 1
        if held:
            yield taken()

    return rows.mapInArrow(packed, "block long, size long, body binary")


def _totals(packets: pd.DataFrame) -> pd.DataFrame:
    """All of a shard's packets -> for each the totals of its fingerprints; and, as block -1, words counted, and how many differ."""
    ends = np.cumsum(packets["n"]).tolist()
    every, places = np.empty(ends[-1], np.uint64), []
    for k, n, e in zip(packets["keys"], packets["n"], ends, strict=True):
        np.cumsum(_unpacked(k, n), out=every[e - n : e])
    values = _distinct(every)
    del every
    for k, n in zip(packets["keys"], packets["n"], strict=True):  # opened again, which takes less memory than to keep them
        places.append(np.searchsorted(values, np.cumsum(_unpacked(k, n), dtype=np.uint64)).astype(np.int32))
    is_word = values & _PAIR == 0
    out = {"block": [*packets["block"], -1], "shard": [*packets["shard"], -1], "n": [*packets["n"], int(is_word.sum())], "sums": []}
    for name in ("target", "background"):
        total = np.zeros(len(values), np.int64)
        for at, c in zip(places, packets[name], strict=True):
            total[at] += _unpacked(c, len(at)).astype(np.int64)
        out[name] = [_packed(total[at]) for at in places] + [None]
        out["sums"].append(int(total[is_word].sum()))
    of = out.pop("sums")
    return pd.DataFrame(out | {"target_sum": [0] * len(packets) + of[:1], "background_sum": [0] * len(packets) + of[1:]})


def scores(docs: DataFrame, target: Column) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of every row of docs. target: marks the rows to be like."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    texts = staged(blocks(rows), "lm-blocks")
    bits = (max(SHARDS, -(-(texts.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES)) - 1).bit_length()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                opened = _opened(body.as_buffer())
                n = np.diff(np.searchsorted(opened.keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), append=len(opened.keys))
                shards, n = np.flatnonzero(n), n[n > 0]
                spans = [(e - k, e) for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
                counts = opened.counts()
                columns = [[_packed(np.diff(opened.keys[s:e], prepend=np.uint64(0))) for s, e in spans], *([_packed(c[s:e]) for s, e in spans] for c in counts)]
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([block] * len(spans), pa.int64()), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["shard", "block", "n", "keys", "target", "background"])

    packets = texts.select("block", "body").mapInArrow(sent, "shard int, block long, n long, keys binary, target binary, background binary")
    totals = staged(packets.groupBy("shard").applyInPandas(_totals, "block long, shard int, n long, target binary, background binary, target_sum long, background_sum long"), "lm-totals")
    vocabulary, *sums = (x or 0 for x in totals.filter("block < 0").agg(F.sum("n"), F.sum("target_sum"), F.sum("background_sum")).first())

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's texts (shard -1) and the totals of its fingerprints -> a row for each text."""
        pdf = pdf.sort_values("shard")
        block, replies = _opened(pdf["body"].iloc[0]), pdf.iloc[1:]
        of = tuple(np.concatenate([np.zeros(0), *(_unpacked(c, n) for c, n in zip(replies[name], replies["n"], strict=True))]) for name in ("target", "background"))
        ours, theirs = block.losses(of, sums, vocabulary)
        return pd.DataFrame({"doc_id": block.doc_id.to_pandas(types_mapper=pd.ArrowDtype), "n_words": block.count, "target_loss": ours, "background_loss": theirs, "score": ours - theirs})

    none = F.lit(None).cast("binary")
    asked = texts.select("block", F.lit(-1).alias("shard"), F.lit(0).cast("long").alias("n"), none.alias("target"), none.alias("background"), "body")
    replies = totals.filter("block >= 0").select("block", "shard", "n", "target", "background", none.alias("body"))
    return asked.unionByName(replies).groupBy("block").applyInPandas(scored, _SCORES)
