"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles of numpy arrays.

A fingerprint's bit is 1 if more than half of the document's shingle hashes (XXH64, seed 42) have it. Equal fingerprints
are first merged into one row, so copies cost nothing. The distinct ones are laid out in order of their population
count and cut into tiles of bounded size. Two fingerprints within the radius differ in population count by no more
than it, so a pair of tiles whose counts are further apart is never made; within a pair of tiles the same holds for the
counts of the four 16-bit quarters taken together, by which blocks are skipped. What remains is compared completely,
by exclusive-or and bit counts. A pair of tiles returns a spanning forest of its links and never the pairs themselves.

That finds texts with almost all shingles in common. To find texts by similarity (``similar_groups``), equal sets of shingles
are merged, the fingerprints are wider, and their radius is that of the similarity and ``SPREAD`` deviations more; candidates
are then compared exactly by their sets of shingles. Fingerprints are compared within blocks only: of all shingles in one
order, two sets as similar share one of their first, as many as the similarity allows to differ and one more. These are a
set's anchors, and the sets that have one in common are a block. Any order does; one with frequent shingles last keeps
blocks small. Bits of a text of few shingles say too little, so texts of up to ``SHORT`` shingles have a second way to become
candidates that misses nothing: they share one of their rarest shingles likewise.

Cost: without blocks, the comparison is quadratic in the number of distinct fingerprints, as the method is; its memory is
two tiles a task, and each tile is sent to the tasks that compare it. With them, anchors are a fifth of all shingles, and
only a block is compared completely, by one task or, if it is large, by tiles.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; a text of fewer words
than a shingle is one shingle; a very long text is one row's work; repeated rows link with each other; rows with a null id
link like any other, but name no group: a group of only such rows has the id null; ``without_near_duplicates`` keeps rows
without an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, staged
from siftwell.llm.components import components, unite, with_nodes
from siftwell.llm.words import chunks, mixed, words_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 4
SEED = 42
#: Distinct fingerprints in a tile at most, and tiles at least for smaller inputs.
TILE, TILES = 65_536, 16
#: Words of 64 bits where similar texts are sought, and sets of shingles in a tile.
WIDE, SET_TILE = 4, 256
#: Deviations that candidates may lie beyond the expected distance, and shingles of the texts that also have the other way.
SPREAD, SHORT = 5, 80
#: Sampled texts that make a shingle frequent, and frequent shingles at most.
OFTEN, FREQUENT = 4, 500_000
#: Texts in a block that one task compares at most, and rows of a task that makes or compares blocks.
BLOCK, TASK_ROWS = 4096, 500_000
_ROWS, _COLUMNS, _PAIRS = 256, 2048, 1_000_000


class Shingles(NamedTuple):
    """Hashes of the shingles of several texts; made[i] of them are of text i."""

    hashes: np.ndarray
    made: np.ndarray


def shingles(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> Shingles:
    """XXH64 of each text's shingles, lower-cased within A-Z."""
    w = words_of(texts, lower=True)
    if not len(w.starts):
        return Shingles(np.zeros(0, np.uint64), np.zeros(len(texts), np.int64))
    sizes = w.ends - w.starts
    inside = np.repeat(w.starts, sizes) + _within(sizes)
    starts = np.cumsum(sizes + 1) - sizes - 1  # of the words, one space apart
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    joined[np.repeat(starts, sizes) + _within(sizes)] = w.data[inside]
    ends = starts + sizes
    counts = np.diff(w.first)
    made = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    at = np.repeat(w.first[:-1], made) + _within(made)
    last = np.minimum(at + shingle, np.repeat(w.first[1:], made)) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[s:e], seed) for s, e in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(at))
    return Shingles(hashes, made)


def majority(hashes: np.ndarray, made: np.ndarray) -> np.ndarray:
    """Of each text, the 64 bits that more than half of its hashes have."""
    out = np.zeros(len(made), np.uint64)
    some = np.flatnonzero(made)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(made) - made)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > made[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def distinct(s: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, and how many each has."""
    row = np.repeat(np.arange(len(s.made)), s.made)
    order = np.lexsort((s.hashes, row))
    hashes, row = s.hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(s.made))


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each text."""
    s = shingles(texts, shingle, seed)
    return majority(s.hashes, s.made)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row of docs; fp holds the fingerprint's 64 bits as long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                fp = pa.array(fingerprints(part.column("text"), shingle, seed).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, "doc_id long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool, more: tuple[np.ndarray, np.ndarray, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) within the radius, block by block; a and b are in order of their quarters' counts.

    more: further bits of a and of b, row by row, and how many bits may differ in all.
    """
    qa, qb = _quarters(a), _quarters(b)
    at_a, at_b = np.arange(0, len(a), _ROWS), np.arange(0, len(b), _COLUMNS)
    low_a, high_a, low_b, high_b = (f.reduceat(q, at, axis=0) for q, at in ((qa, at_a), (qb, at_b)) for f in (np.minimum, np.maximum))
    gap = np.maximum(0, np.maximum(low_a[:, None].astype(int) - high_b[None], low_b[None].astype(int) - high_a[:, None])).sum(axis=2)
    for x, y in zip(*np.nonzero(gap <= radius), strict=True):
        i, j = at_a[x], at_b[y]
        if same and j + _COLUMNS <= i:
            continue
        close = np.bitwise_count(a[i : i + _ROWS, None] ^ b[None, j : j + _COLUMNS]) <= radius
        r, c = np.nonzero(close)
        r, c = r + i, c + j
        if more is not None and len(r):
            ahead = r < c if same else np.ones(len(r), bool)
            r, c = r[ahead], c[ahead]
            near = np.bitwise_count(a[r] ^ b[c]) + np.bitwise_count(more[0][r] ^ more[1][c]).sum(axis=1) <= more[2]
            r, c = r[near], c[near]
        if len(r):
            yield r, c


def _tree(nodes: np.ndarray, parent: np.ndarray) -> pd.DataFrame:
    """Links from each node to its root."""
    while (parent != parent[parent]).any():
        parent = parent[parent]
    tied = parent != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[tied], "b": nodes[parent[tied]]})


def _forest(radius: int, total: int | None):
    def linked(pair: pd.DataFrame) -> pd.DataFrame:
        tiles = []
        for fps, nodes, more in zip(pair["fps"], pair["nodes"], pair["more"], strict=True):
            fp, node = np.asarray(fps, np.int64).view(np.uint64), np.asarray(nodes, np.int64)
            order = np.lexsort(_quarters(fp).T[::-1])
            rest = np.frombuffer(b"".join(more), np.uint64).reshape(len(fp), -1)[order] if total is not None else None
            tiles.append((fp[order], node[order], rest))
        nodes = np.unique(np.concatenate([t[1] for t in tiles]))
        ranks = [np.searchsorted(nodes, t[1]) for t in tiles]
        parent = np.arange(len(nodes))
        for r, c in tile_links(tiles[0][0], tiles[-1][0], radius, len(tiles) == 1, None if total is None else (tiles[0][2], tiles[-1][2], total)):
            unite(parent, ranks[0][r], ranks[-1][c])
        return _tree(nodes, parent)

    return linked


def near_links(unique: DataFrame, radius: int = RADIUS, tile: int = TILE, total: int | None = None) -> DataFrame:
    """(fp, node), each node once -> (a, b), links between nodes that span every group of fingerprints within the radius.

    total: if given, unique also has ``more``, further bits as binary, and links differ in so many bits of all at most.
    """
    if total is None:
        unique = unique.select("fp", "node", F.lit(None).cast("binary").alias("more"))
    spark = unique.sparkSession
    unique = unique.withColumn("ones", F.bit_count("fp"))
    counts = dict(unique.groupBy("ones").count().collect())  # 65 rows at most
    tile = max(1024, min(tile, -(-sum(counts.values()) // TILES)))
    spans: list[list[int]] = []  # of the tiles: least and greatest population count
    first, parts, filled = {}, {}, tile
    for ones, n in sorted(counts.items()):
        parts[ones] = -(-n // tile)
        if parts[ones] > 1 or filled + n > tile:
            first[ones] = len(spans)
            spans += [[ones, ones] for _ in range(parts[ones])]
            filled = n if parts[ones] == 1 else tile
        else:
            first[ones] = len(spans) - 1
            spans[-1][1] = ones
            filled += n
    if not spans:
        return spark.createDataFrame([], "a long, b long")
    reach = [(t, min(i for i, (_, hi) in enumerate(spans) if hi + radius >= lo0), max(i for i, (lo, _) in enumerate(spans) if lo - radius <= hi0)) for t, (lo0, hi0) in enumerate(spans)]
    of = {k: F.element_at(F.array(*[F.lit(d.get(i, 1)) for i in range(65)]), F.col("ones") + 1) for k, d in (("first", first), ("parts", parts))}
    tiles = unique.groupBy((of["first"] + F.pmod(F.xxhash64("fp"), of["parts"])).cast("int").alias("tile")).agg(F.collect_list(F.struct("fp", "node", "more")).alias("rows"))
    tiles = tiles.join(F.broadcast(spark.createDataFrame(reach, "tile int, low int, high int")), "tile")
    pairs = tiles.withColumn("other", F.explode(F.sequence("low", "high"))).select(F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), F.col("rows.fp").alias("fps"), F.col("rows.node").alias("nodes"), F.col("rows.more").alias("more"))
    return pairs.groupBy("x", "y").applyInPandas(_forest(radius, total), "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs, with the least doc_id that links of at most ``radius`` bits reach."""
    prints = staged(with_fingerprints(docs, shingle, seed), "fingerprints")
    unique, top = with_nodes(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "unique-fingerprints")
    found = components(near_links(unique.select("fp", "node"), radius))
    least = F.coalesce("component", "node")
    groups = staged(unique.join(found, "node", "left").select(F.col("fp").alias("group_fp"), F.when(least <= top, least).alias("component_id")), "groups")
    return prints.join(bounded(groups), F.col("fp") == F.col("group_fp")).select("doc_id", "fp", "component_id")


def _like(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-6


def _sets_near(similarity: float):
    def near(task: pd.DataFrame) -> pd.DataFrame:
        """Sets of a tile (side 0) and of another (side 1), which may hold the same rows -> a spanning forest of the pairs as similar."""
        nodes = np.unique(task["node"].to_numpy())
        rank = np.searchsorted(nodes, task["node"].to_numpy())
        side = task["side"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in task["shingles"]]
        sizes = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), sizes)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = (np.cumsum(counts > 1) - 1)[inverse]
        shared = (counts > 1)[inverse]
        row, column = row[shared], column[shared]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        common = np.zeros((len(left), len(right)))
        for at in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
            here = (column >= at) & (column < at + 4096)
            held = np.zeros((len(sets), 4096), np.float32)
            held[row[here], column[here] - at] = 1
            common += held[left] @ held[right].T
        r, c = np.nonzero(common >= similarity * (sizes[left][:, None] + sizes[right][None] - common) - 1e-6)
        parent = np.arange(len(nodes))
        unite(parent, rank[left[r]], rank[right[c]])
        return _tree(nodes, parent)

    return near


def short_groups(short: DataFrame, similarity: float) -> DataFrame:
    """(node, n, short: its n shingles) -> (group, node): groups by a common shingle, such that any two sets as similar meet in one.

    Of sets of n and m shingles as similar, each has its n - ceil(n * similarity) + 1 rarest ones, and these have one in common.
    """
    each = staged(short.select("node", "n", F.explode_outer("short").alias("shingle")), "short-shingles")
    counts = each.groupBy(F.col("shingle").alias("_shingle")).agg(F.count("*").alias("texts")).filter("texts > 1")
    # one that a single text has is rarer than all others and meets nothing
    held = each.join(counts, F.col("shingle") == F.col("_shingle"), "left").withColumn("texts", F.coalesce("texts", F.lit(1)))
    at = F.row_number().over(Window.partitionBy("node").orderBy("texts", "shingle"))
    rarest = held.withColumn("at", at).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1).filter("texts > 1")
    return rarest.select(F.col("shingle").alias("group"), "node")


def similar_links(sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """sets (node, shingles), groups (group, node) -> (a, b): links that span, within each group, all pairs as similar.

    Every set is compared with that of its group's least node first. Those alike are settled, as they need not be compared
    with one another; the others are compared with all of the group, tile by tile.
    """
    grouped = groups.withColumnRenamed("node", "_node").join(sets, F.col("_node") == F.col("node")).select("group", "node", "shingles")
    least = staged(groups.groupBy(F.col("group").alias("_group")).agg(F.min("node").alias("first")), "group-firsts")
    first = staged(least.join(sets, F.col("first") == F.col("node")).select("_group", "first", F.col("shingles").alias("first_shingles")), "group-first-sets")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("shingles").to_pylist(), batch.column("first_shingles").to_pylist(), strict=True)
            alike = pa.array([_like(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("node"), batch.column("first"), alike], ["group", "node", "first", "alike"])

    told = grouped.join(bounded(first), F.col("group") == F.col("_group")).filter("node <> first").mapInArrow(compared, "group long, node long, first long, alike boolean")
    told = staged(told, "compared-with-first")
    links = told.filter("alike").select(F.col("node").alias("a"), F.col("first").alias("b"))
    rest = told.filter("not alike")
    if not rest.take(1):
        return links
    # tasks (group, x, y): tile x of the others with tile y of all
    sizes = told.groupBy(F.col("group").alias("_group")).agg(F.sum((~F.col("alike")).cast("int")).alias("others"), (F.count("*") + 1).alias("all")).filter("others > 0")
    sizes = staged(sizes.select("_group", F.ceil(F.col("others") / SET_TILE).cast("int").alias("xs"), F.ceil(F.col("all") / SET_TILE).cast("int").alias("ys")), "group-tiles")
    tile = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    sized = groups.join(bounded(sizes), F.col("group") == F.col("_group")).select("group", "node", "xs", "ys")
    other = rest.select(F.col("group").alias("_g"), F.col("node").alias("_n"))
    left = sized.join(other, (F.col("group") == F.col("_g")) & (F.col("node") == F.col("_n"))).select("group", "node", tile("xs").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), F.lit(0).alias("side"))
    right = sized.select("group", "node", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), tile("ys").alias("y"), F.lit(1).alias("side"))
    tasks = left.unionByName(right).withColumnRenamed("node", "_node").join(sets, F.col("_node") == F.col("node")).select("group", "x", "y", "side", "node", "shingles")
    return links.unionByName(tasks.groupBy("group", "x", "y").applyInPandas(_sets_near(similarity), "a long, b long"))


def frequent_shingles(texts: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Shingles of ``OFTEN`` texts or more of a sample, ``FREQUENT`` of them at most, rarest first: one text in 32, more where that is less than about 5,000."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(distinct(shingles(part.column("text"), shingle, seed))[0].view(np.int64))], ["shingle"])

    share = max(1, min(32, texts.count() // 5_000))
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    counts = sample.mapInArrow(made, "shingle long").groupBy("shingle").agg(F.count("*").alias("texts")).filter(F.col("texts") >= OFTEN)
    most = counts.orderBy(F.desc("texts"), "shingle").limit(FREQUENT).select("shingle").toArrow().column("shingle")
    return most.to_numpy()[::-1].view(np.uint64)


def anchors(hashes: np.ndarray, count: np.ndarray, similarity: float, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, its first n - ceil(n * similarity) + 1 shingles in one order for all, and how many: two sets as similar share one.

    hashes: count[i] of set i, in order of their values. That is the order, with the frequent ones (rarest first) behind all others.
    """
    most = np.where(count > 0, count - np.ceil(count * similarity - 1e-6).astype(np.int64) + 1, 0)
    if not len(frequent) or not len(hashes):
        return hashes[_within(count) < np.repeat(most, count)], most
    by_value = np.argsort(frequent)
    at = np.minimum(np.searchsorted(frequent[by_value], hashes), len(frequent) - 1)
    often = frequent[by_value][at] == hashes
    before = np.r_[0, np.cumsum(~often)]  # others before each position
    starts = np.cumsum(count) - count
    chosen = ~often & (before[:-1] - np.repeat(before[starts], count) < np.repeat(most, count))
    short = most - (before[starts + count] - before[starts])  # places that others leave
    where = np.flatnonzero(often)
    row = np.repeat(np.arange(len(count)), count)[where]
    order = np.lexsort((by_value[at[where]], row))
    where, row = where[order], row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    chosen[where[place < short[row]]] = True
    return hashes[chosen], most


def blocks(anchored: DataFrame, task: int = TASK_ROWS) -> DataFrame:
    """(node, anchors) -> (block, size, node): the nodes that have an anchor in common, those of equal nodes once."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of some anchors."""
        held = [(batch.column("anchor").to_numpy(), batch.column("node").to_numpy()) for batch in batches]
        if not held:
            return
        anchor, node = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.lexsort((node, anchor))
        anchor, node = anchor[order], node[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (node[1:] != node[:-1])
        anchor, node = anchor[new], node[new]
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(starts, append=len(anchor))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        ends = np.cumsum(sizes)
        node = node[np.repeat(starts, sizes) + _within(sizes)]
        name = mixed(np.add.reduceat(mixed(node.view(np.uint64) + np.uint64(1)), ends - sizes) + sizes.astype(np.uint64)) if len(sizes) else np.zeros(0, np.uint64)
        once = np.zeros(len(sizes), bool)
        once[np.unique(name, return_index=True)[1]] = True
        node, sizes, name = node[np.repeat(once, sizes)], sizes[once], name[once].view(np.int64)
        made = pa.RecordBatch.from_arrays([pa.array(np.repeat(name, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(node)], ["block", "size", "node"])
        for at in range(0, made.num_rows, 65_536):
            yield made.slice(at, 65_536)

    n = anchored.agg(F.sum(F.size("anchors"))).first()[0] or 0
    each = anchored.select(F.explode("anchors").alias("anchor"), "node").repartition(-(-n // task) or 1, "anchor")
    return staged(each.mapInArrow(met, "block long, size long, node long").distinct(), "blocks")


def block_links(unique: DataFrame, found: DataFrame, radius: int, total: int, *, most: int = BLOCK, task: int = TASK_ROWS) -> DataFrame:
    """unique (node, fp, more), blocks of its nodes -> (a, b): links that span, within each block, the pairs of so few differing bits.

    Every block is compared completely: those of up to ``most`` nodes many at a time by one task, the nodes of larger ones by tiles.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of some blocks."""
        held = [(*(batch.column(c).to_numpy() for c in ("block", "node", "fp")), np.frombuffer(b"".join(batch.column("more").to_pylist()), np.uint64).reshape(batch.num_rows, -1)) for batch in batches if batch.num_rows]
        if not held:
            return
        block, node, fp, more = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.argsort(block, kind="stable")
        block, node, fp, more = block[order], node[order], fp[order].view(np.uint64), more[order]
        ends = np.searchsorted(block, block, "right")
        nodes, rank = np.unique(node, return_inverse=True)
        parent = np.arange(len(nodes))
        ahead = ends - np.arange(len(block)) - 1  # rows after each in its block
        upto, at = np.cumsum(ahead), 0
        while at < len(block):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
            a = np.repeat(np.arange(at, stop), ahead[at:stop])
            b = a + 1 + _within(ahead[at:stop])
            bits = np.bitwise_count(fp[a] ^ fp[b])
            a, b, bits = a[bits <= radius], b[bits <= radius], bits[bits <= radius]
            close = bits + np.bitwise_count(more[a] ^ more[b]).sum(axis=1) <= total
            unite(parent, rank[a[close]], rank[b[close]])
            at = stop
        yield pa.RecordBatch.from_pandas(_tree(nodes, parent), preserve_index=False)

    small = found.filter(F.col("size") <= most)
    rows = small.withColumnRenamed("node", "_node").join(unique, F.col("_node") == F.col("node")).select("block", "node", "fp", "more")
    links = rows.repartition(-(-small.count() // task) or 1, "block").mapInArrow(near, "a long, b long")
    large = found.filter(F.col("size") > most).select(F.col("node").alias("_node")).distinct()
    if not large.take(1):
        return links
    large = staged(large, "large-blocks")
    return links.unionByName(near_links(staged(unique.join(bounded(large), F.col("_node") == F.col("node"), "left_semi"), "large-block-prints"), radius, total=total))


def similar_groups(docs: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, component_id): groups of texts whose sets of shingles have a Jaccard similarity of at least so much.

    Rows without an id are left out. Texts of equal sets are merged first. SimHashes of ``WIDE`` times 64 bits find candidates
    within a radius that such texts of many shingles exceed with a chance of less than one in a million; only texts that share
    one of their anchors are compared, as all texts so similar do. Short texts are candidates also by their rarest shingles.
    Groups of candidates are then compared exactly by their sets. Only texts in such a group have their sets made.
    """
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(min(1.0, cosine)) / np.pi  # of bits in which two such texts differ, as expected
    radius, total = (int(np.ceil(bits * share + SPREAD * np.sqrt(bits * share * (1 - share)))) for bits in (64, 64 * WIDE))
    frequent = frequent_shingles(texts, shingle, seed)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, count = distinct(shingles(part.column("text"), shingle, seed))  # one vote for each, as the sets have it
                prints = [majority(hashes if not k else mixed(hashes + np.uint64(k)), count) for k in range(WIDE)]
                more = np.stack(prints[1:], axis=1)
                ends = np.cumsum(count)
                keys = [xxhash.xxh3_128_digest(hashes[e - n : e].tobytes()) for e, n in zip(ends, count, strict=True)]
                short = [hashes[e - n : e].view(np.int64) if 0 < n <= SHORT else None for e, n in zip(ends, count, strict=True)]
                first, most = anchors(hashes, count, similarity, frequent)
                held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(most)], pa.int32()), pa.array(first.view(np.int64)))
                columns = [pa.array(keys, pa.binary()), pa.array(prints[0].view(np.int64)), pa.array([m.tobytes() for m in more], pa.binary()), pa.array(short, pa.list_(pa.int64())), held]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "key", "fp", "more", "short", "anchors"])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, count = distinct(shingles(part.column("text"), shingle, seed))
                sets = [hashes[e - n : e].tobytes() for n, e in zip(count, np.cumsum(count), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    prints = staged(texts.mapInArrow(made, "doc_id long, key binary, fp long, more binary, short array<long>, anchors array<long>"), "wide-fingerprints")
    held = prints.groupBy("key").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.min("more").alias("more"), F.any_value("short").alias("short"), F.any_value("anchors").alias("anchors"))
    unique = staged(held, "unique-texts")
    near = block_links(unique.select("node", "fp", "more"), blocks(unique.select("node", "anchors")), radius, total)
    near = components(near).select(F.col("component").alias("group"), "node")
    groups = near.unionByName(short_groups(unique.filter("short is not null").select("node", F.size("short").alias("n"), "short"), similarity))
    groups = staged(groups, "suspects")
    nodes = staged(groups.select(F.col("node").alias("_node")).distinct(), "suspect-nodes")
    own = texts.join(bounded(nodes), F.col("doc_id") == F.col("_node"))
    if prints.groupBy("doc_id").count().filter("count > 1").take(1):  # rows that repeat an id: the one whose set the node stands for
        own = own.dropDuplicates(["doc_id"])
    sets = staged(own.select("text", F.col("doc_id").alias("node")).mapInArrow(with_sets, "node long, shingles binary"), "suspect-sets")
    found = components(similar_links(sets, groups, similarity))
    named = staged(unique.join(found, "node", "left").select(F.col("key").alias("_key"), F.coalesce("component", "node").alias("component_id")), "text-groups")
    return prints.join(bounded(named), F.col("key") == F.col("_key")).select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of similar texts, that of the least id; rows without an id stay."""
    groups = staged(similar_groups(docs, **options), "near-duplicates")
    gone = staged(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    kept = docs.join(bounded(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
    if groups.groupBy("doc_id").count().filter("count > 1").take(1):  # rows that repeat an id
        return kept.filter("doc_id is null").unionByName(kept.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    return kept
