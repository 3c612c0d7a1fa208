"""Substring dedup by fixed-block anchors: every repeat of at least ``window`` words is removed but for its first.

Documents are packed into blocks of bounded size. In each document the non-overlapping runs of ``anchor`` words (at word
0, anchor, 2 * anchor, ...) are the reference blocks of the index; every rolling run of as many words probes it. As a
window of ``window`` >= 2 * anchor - 1 words holds a whole reference block wherever it starts, a window that occurs twice
is hit at both places. Three passes over the blocks:

1. Probes and anchors go to the hash range they fall in, a packet for each block and range, each fingerprint once. The
   range answers which of the block's fingerprints are hit: they are in the index and occur a second time.
2. Around hits, windows are compared exactly, each once a block and with the least document that has it. The range
   answers whether that document is the first of all.
3. Windows that are not the first make up the maximal repeats; their words are removed.

Packets hold a fingerprint once for each block, so a passage in every document is as cheap as any other, and no pair of
documents is ever made. Answers are bitmaps in the order of the block's own sorted fingerprints. Hits are truncated
fingerprints and only save work; windows are decided by 64-bit fingerprints of their words.

Defined cases: null and empty texts have no words and nothing is removed; the answer to a document does not depend on
the block it is in; rows that repeat an id do not count as earlier than one another, while a repeat within one row does;
rows with a null id come after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import staged
from siftwell.llm.words import Words, chunks, rolling, words_of

WINDOW, ANCHOR = 20, 10
#: Words whose fingerprints a hash range holds, about; fewest ranges.
RANGE_WORDS, RANGES = 1_000_000, 64
#: Bytes of answers that are broadcast at most; beyond, blocks and answers meet by a shuffle.
BROADCAST_BYTES = 64_000_000
_LAST = np.iinfo(np.int64).max


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, words, payload): the documents of each input partition in blocks of bounded text, staged."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(words_of(part.column("text")).starts)], pa.int64()), pa.array([_packed(part)], pa.binary())], ["block", "words", "payload"])
                at += 1

    return staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, "block long, words long, payload binary"), "blocks")


def _runs(w: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of n words within one document, and their fingerprints."""
    rolled = rolling(hashes, n)
    document = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.flatnonzero(document[: len(rolled)] == document[n - 1 :]) if len(rolled) else np.zeros(0, np.int64)
    return at, rolled[at]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: high ones of small numbers compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _from_planes(data: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def _probes(w: Words, hashes: np.ndarray, anchor: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the probes, index of each into the block's sorted distinct keys, the keys (range above 32 bits of
    fingerprint), and of each key whether it is an anchor's and whether it occurs twice."""
    at, h = _runs(w, hashes, anchor)
    keys, inverse, counts = np.unique(((h >> np.uint64(32)) % np.uint64(ranges)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
    firsts = np.repeat(w.first[:-1], np.diff(w.first))
    is_anchor = np.zeros(len(keys), bool)
    is_anchor[inverse[(at - firsts[at]) % anchor == 0]] = True
    return at, inverse, keys, is_anchor, counts > 1


def _windows(w: Words, hashes: np.ndarray, hit: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the windows that hold a hit probe. hit: a flag for each word at which one starts."""
    at, h = _runs(w, hashes, window)
    upto = np.concatenate(([0], np.cumsum(hit)))
    near = upto[np.minimum(at + window - anchor + 1, len(hit))] > upto[at]
    return at[near], h[near]


def _slices(ranges_of: np.ndarray, ranges: int) -> np.ndarray:
    return np.searchsorted(ranges_of, np.arange(ranges + 1, dtype=ranges_of.dtype))


def _hit_words(w: Words, hashes: np.ndarray, bits: bytes | None, anchor: int, ranges: int) -> np.ndarray:
    hit = np.zeros(len(w.starts) + 1, bool)
    at, inverse, keys, _, _ = _probes(w, hashes, anchor, ranges)
    if bits is not None and len(keys):
        live = _read_bits(bits, keys >> np.uint64(32), ranges)
        hit[at[live[inverse]]] = True
    return hit


def _owned(window_hashes: np.ndarray, docs: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of a block in the order of range and fingerprint: the ranges, fingerprints, least documents; and each window's index."""
    keys, inverse = np.unique(window_hashes, return_inverse=True)
    least = np.full(len(keys), _LAST)
    np.minimum.at(least, inverse, docs)
    range_of = (keys >> np.uint64(20)) % np.uint64(ranges)
    order = np.argsort(range_of, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return range_of[order], keys[order], least[order], rank[inverse]


def _read_bits(answers: bytes, range_of: np.ndarray, ranges: int) -> np.ndarray:
    """Flags in the order of a block's keys, from the answers of its ranges; a range without answer has none set."""
    out, cuts, at = np.zeros(len(range_of), bool), _slices(range_of, ranges), 0
    data = zlib.decompress(answers)
    while at < len(data):
        k = int.from_bytes(data[at : at + 4], "little")
        n = int(cuts[k + 1] - cuts[k])
        size = -(-n // 8)
        out[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(data, np.uint8, size, at + 4), count=n)
        at += 4 + size
    return out


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            values = [batch.column(i)[row].as_py() for i in range(batch.num_columns)]
            docs = _unpacked(values[1])
            w = words_of(docs.column("text"))
            yield values[0], docs, w, w.hashes(), *values[2:]


def _documents(docs: pa.RecordBatch, w: Words) -> np.ndarray:
    """The id of each word's document."""
    return np.repeat(docs.column("doc_id").fill_null(_LAST).to_numpy(), np.diff(w.first))


def _by_block(answers: DataFrame) -> DataFrame:
    """(range, block, bits) -> (block, bits): the answers to a block in one, staged."""

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [zlib.compress(b"".join(int(k).to_bytes(4, "little") + b for k, b in zip(pdf["range"], pdf["bits"], strict=True)), 1)]})

    return staged(answers.groupBy("block").applyInPandas(joined, "block long, bits binary"), "answers")


def _with_answers(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    answers = answers.select(F.col("block").alias("_b"), F.col("bits").alias(name))
    size = answers.agg(F.sum(F.octet_length(name) + 16)).first()[0] or 0
    return blocks.join(F.broadcast(answers) if size <= BROADCAST_BYTES else answers, F.col("block") == F.col("_b"), "left").drop("_b")


def repeats_removed(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words that stay, joined by one space. A row for each row of docs."""
    if window < 2 * anchor - 1:
        raise ValueError("a window must be long enough to hold a whole anchor wherever it starts")
    blocks = blocks_of(docs)
    ranges = max(RANGES, -(-(blocks.agg(F.sum("words")).first()[0] or 0) // RANGE_WORDS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, w, hashes in _each_block(batches):
            _, _, keys, is_anchor, twice = _probes(w, hashes, anchor, ranges)
            cuts = _slices(keys >> np.uint64(32), ranges)
            some = np.flatnonzero(np.diff(cuts))
            low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)),
                    pa.array(np.full(len(some), block, np.int64)),
                    pa.array([_planes(np.diff(low[cuts[k] : cuts[k + 1]], prepend=np.uint32(0))) for k in some], pa.binary()),
                    pa.array([np.packbits(is_anchor[cuts[k] : cuts[k + 1]]).tobytes() + np.packbits(twice[cuts[k] : cuts[k + 1]]).tobytes() for k in some], pa.binary()),
                ],
                ["range", "block", "keys", "flags"],
            )

    def hits(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(_from_planes(x, np.uint32), dtype=np.uint32) for x in pdf["keys"]]
        flags = [np.frombuffer(x, np.uint8).reshape(2, -1) for x in pdf["flags"]]
        sizes = [len(k) for k in keys]
        is_anchor, twice = (np.concatenate([np.unpackbits(f[i], count=n) for f, n in zip(flags, sizes, strict=True)]).astype(bool) for i in (0, 1))
        values, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        live = counts > 1
        live[inverse[twice]] = True
        indexed = np.zeros(len(values), bool)
        indexed[inverse[is_anchor]] = True
        return _answers(pdf, sizes, (live & indexed)[inverse])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, docs, w, hashes, hit_bits in _each_block(batches):
            at, h = _windows(w, hashes, _hit_words(w, hashes, hit_bits, anchor, ranges), window, anchor)
            range_of, keys, least, _ = _owned(h, _documents(docs, w)[at], ranges)
            cuts = _slices(range_of, ranges)
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)),
                    pa.array(np.full(len(some), block, np.int64)),
                    pa.array([keys[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()),
                    pa.array([_planes(least[cuts[k] : cuts[k + 1]]) for k in some], pa.binary()),
                ],
                ["range", "block", "keys", "flags"],
            )

    def firsts(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64) for x in pdf["keys"]]
        docs = np.concatenate([_from_planes(x, np.int64) for x in pdf["flags"]])
        values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        least = np.full(len(values), _LAST)
        np.minimum.at(least, inverse, docs)
        return _answers(pdf, [len(k) for k in keys], docs > least[inverse])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, w, hashes, hit_bits, late_bits in _each_block(batches):
            at, h = _windows(w, hashes, _hit_words(w, hashes, hit_bits, anchor, ranges), window, anchor)
            ids = _documents(docs, w)[at]
            range_of, _, least, index = _owned(h, ids, ranges)
            late = _read_bits(late_bits, range_of, ranges) if late_bits is not None else np.zeros(len(range_of), bool)
            row = np.searchsorted(w.first, at, "right")
            order = np.lexsort((at, index))
            again = np.zeros(len(at), bool)
            again[order[1:]] = (np.diff(index[order]) == 0) & (np.diff(row[order]) == 0)
            gone = at[late[index] | again | (ids > least[index])]
            edges = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(edges, gone, 1)
            np.add.at(edges, gone + window, -1)
            yield _kept(docs, w, np.cumsum(edges)[:-1] == 0)

    packets = "range int, block long, keys binary, flags binary"
    shape = "range int, block long, bits binary"
    texts = blocks.select("block", "payload")
    hit = _by_block(texts.mapInArrow(probe, packets).groupBy("range").applyInPandas(hits, shape))
    texts = _with_answers(texts, hit, "hit_bits")
    late = _by_block(texts.mapInArrow(compare, packets).groupBy("range").applyInPandas(firsts, shape))
    return _with_answers(texts, late, "late_bits").select("block", "payload", "hit_bits", "late_bits").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def _answers(pdf: pd.DataFrame, sizes: list[int], flags: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - n : e]).tobytes() if flags[e - n : e].any() else None for n, e in zip(sizes, ends, strict=True)]
    return pd.DataFrame({"range": pdf["range"], "block": pdf["block"], "bits": bits})[[b is not None for b in bits]]


def _kept(docs: pa.RecordBatch, w: Words, stays: np.ndarray) -> pa.RecordBatch:
    """The rows of a block with their kept words, whose bytes are gathered for all rows at once."""
    n = len(w.first) - 1
    document = np.repeat(np.arange(n), np.diff(w.first))[stays]
    starts, sizes = w.starts[stays], (w.ends - w.starts)[stays]
    gaps = np.ones(len(starts), np.int64)
    gaps[np.flatnonzero(np.diff(document, prepend=-1))] = 0  # none before a text's first word
    ends = np.cumsum(sizes + gaps)
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 32, np.uint8)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(ends - sizes, sizes) + within] = w.data[np.repeat(starts, sizes) + within]
    upto = np.concatenate(([0], ends))[np.searchsorted(document, np.arange(n + 1))]
    kept = pa.LargeStringArray.from_buffers(n, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    words = np.diff(w.first)
    return pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(words), pa.array(words - np.bincount(document, minlength=n)), kept], ["doc_id", "n_words", "n_removed", "kept"])
