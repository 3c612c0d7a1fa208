"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative for a group.

Equal vectors are first merged into one row with a count, so copies cost nothing. Centroids are fitted by one task on a bounded
sample of ``SAMPLE`` rows in the order of a seeded hash, for each length that vectors have; every vector is then indexed. A
vector lives in the cell of its nearest centroid, and visits every other cell if it is within ``reach`` of the plane halfway
between the two centroids. A pair of vectors of different cells that meets in both of them counts in one, as each vector
carries the cells it visits.

Two unit vectors with cosine c are sqrt(2 - 2 c) apart. If they live on either side of a plane, one of them lies within half
of that of it; with this as reach no link can be missed. ``exact=False`` gives that up: it presumes that the difference of
two near vectors spreads evenly over d dimensions, so that its part across a plane has deviation sqrt((2 - 2 c) / d), and
reaches half of ``SPREAD`` deviations where that is less.

A cell is split into tiles of bounded size; a task compares two tiles, whatever the size of the cell. It returns counts of
links and a spanning forest, never the pairs. Vectors travel as they are stored and are scaled, in double precision, where
they are compared; afterwards a 128-bit hash stands for them.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths do not link with each other; repeated ids count as one vector each; vectors with a
null id link like any other, but name no component: one of only such vectors has the id null; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, staged
from siftwell.llm.components import components, unite, with_nodes

COSINE = 0.95
SAMPLE, ROUNDS = 20_000, 12
CELL_ROWS, CELLS, TILE, SPREAD = 2000, 1024, 4096, 5.0
_BLOCK = 512


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        cell = (x @ centroids.T).argmax(axis=1)
        order = np.argsort(cell, kind="stable")
        at = np.flatnonzero(np.diff(cell[order], prepend=-1))
        sums = np.add.reduceat(x[order], at, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        good = norms > 1e-9
        centroids[cell[order][at][good]] = sums[good] / norms[good, None]
    return centroids


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their values, row by row."""
    sizes, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[first[rows][:, None] + np.arange(d)]


def _receives(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs that meet in cell a and in cell b count in a: of every two cells just one does, and each about half the time."""
    return ((a + b) % 2 == 0) == (a < b)


def assign(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, lives): every row at home, and as a visitor, with the cell it lives in; and of each row of x the cells it visits."""
    likeness = x @ centroids.T
    own = likeness.argmax(axis=1)
    apart = np.linalg.norm(centroids[:, None] - centroids[None], axis=2)[own]
    depth = (likeness[np.arange(len(x)), own][:, None] - likeness) / np.where(apart > 0, apart, np.inf)
    visits = depth <= reach + 1e-9
    visits[np.arange(len(x)), own] = False
    rows, cells = np.nonzero(visits)
    return np.concatenate((np.arange(len(x)), rows)), np.concatenate((own, cells)), np.concatenate((own, own[rows])), visits


def _compared(cosine: float, kind: type):
    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        """Rows of one home tile (side 0) and those of another tile of the cell, at home or visiting (side 1)."""
        x = _unit(np.frombuffer(b"".join(pair["vector"]), kind).reshape(len(pair), -1))
        node, copies, side, lives = (pair[c].to_numpy() for c in ("node", "copies", "side", "lives"))
        cell, visits = pair["cell"].iloc[0], np.unpackbits(np.frombuffer(b"".join(pair["visits"]), np.uint8).reshape(len(x), -1), axis=1)
        nodes = np.sort(node)
        rank = np.searchsorted(nodes, node)
        parent, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        same = not (side == 1).any() and bool(pair["same"].iloc[0])
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        for i in range(0, len(left), _BLOCK):
            r, c = np.nonzero(x[left[i : i + _BLOCK]] @ x[right].T >= cosine)
            if same:
                r, c = r[c > r + i], c[c > r + i]
            a, b = left[r + i], right[c]
            here = (visits[a, lives[b]] == 0) | _receives(cell, lives[b])
            a, b = a[here], b[here]
            np.add.at(links, rank[a], copies[b])
            np.add.at(links, rank[b], copies[a])
            unite(parent, rank[a], rank[b])
        while (parent != parent[parent]).any():
            parent = parent[parent]
        tied = np.flatnonzero(links)
        return pd.DataFrame({"node": nodes[tied], "root": nodes[parent[tied]], "links": links[tied]})

    return compare


def _centroids(unique: DataFrame, cell_rows: int) -> dict[int, np.ndarray]:
    """By length, fitted in one task on a bounded sample; a length that the sample lacks has none, and all its vectors one cell."""
    n = dict(unique.groupBy(F.size("embedding")).count().collect())  # a row for each length
    sample = unique.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, x in _by_length(batch.column("embedding")):
                held.setdefault(x.shape[1], []).append(_unit(x))
        made = {d: kmeans(np.concatenate(parts), max(1, min(CELLS, n[d] // cell_rows))) for d, parts in held.items()}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    made = sample.coalesce(1).mapInArrow(fitted, "made binary").first()
    return pickle.loads(made.made) if made else {}


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, exact: bool = True, cell_rows: int = CELL_ROWS, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of vectors (vec_id, embedding)."""
    e = F.col("embedding")
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    rows = vectors.select(F.col("vec_id").cast("long"), e.cast(f"array<{'float' if kind is np.float32 else 'double'}>").alias("embedding"))
    fine = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("fine", fine).withColumn("h1", F.xxhash64(F.lit(1), e)).withColumn("h2", F.xxhash64(F.lit(2), e))
    unique, top = with_nodes(rows.filter("fine").groupBy("h1", "h2", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "unique-vectors")
    centroids = _centroids(unique, cell_rows)
    most = max([1, *(len(c) for c in centroids.values())])
    near = math.sqrt(max(0.0, 2 - 2 * cosine)) / 2

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for rows, x in _by_length(part.column("embedding")):
                    d = x.shape[1]
                    row, cell, lives, visits = assign(_unit(x), centroids.get(d, np.eye(1, d)), near * (1 if exact else min(1, SPREAD / math.sqrt(d))))
                    visits = np.pad(visits, ((0, 0), (0, most - visits.shape[1])))
                    take, whose = pa.array(row), pa.array(rows[row])
                    packed, bits = (pa.array([v.tobytes() for v in values], pa.binary()) for values in (np.ascontiguousarray(x, kind), np.packbits(visits, axis=1)))
                    columns = [pa.array(np.full(len(row), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(lives.astype(np.int32)), part.column("node").take(whose), part.column("copies").take(whose), packed.take(take), bits.take(take)]
                    yield pa.RecordBatch.from_arrays(columns, ["d", "cell", "lives", "node", "copies", "vector", "visits"])

    at = unique.select("node", "copies", "embedding").mapInArrow(placed, "d int, cell int, lives int, node long, copies long, vector binary, visits binary")
    at = staged(at, "cells").withColumn("home", F.col("cell") == F.col("lives"))
    sizes = at.groupBy("d", "cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.sum((~F.col("home")).cast("int")).alias("visitors"))
    sizes = sizes.select(F.col("d").alias("_d"), F.col("cell").alias("_cell"), F.ceil(F.col("homes") / tile).cast("int").alias("h"), F.ceil(F.col("visitors") / tile).cast("int").alias("v"))
    at = at.join(bounded(staged(sizes, "cell-sizes")), (F.col("d") == F.col("_d")) & (F.col("cell") == F.col("_cell"))).filter("h > 0").withColumn("t", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("h")).otherwise(F.col("v"))).cast("int"))
    # tasks (d, cell, x, y): home tile x with home tile y >= x, or with visiting tile y - h
    as_left = at.filter("home").select("d", "cell", F.col("t").alias("x"), F.explode(F.sequence(F.col("t"), F.col("h") + F.col("v") - 1)).alias("y"), "node", "copies", "vector", "visits", "lives", F.lit(0).alias("side"), F.col("t").alias("own"))
    as_right = at.withColumn("y", F.when(F.col("home"), F.col("t")).otherwise(F.col("h") + F.col("t"))).withColumn("last", F.when(F.col("home"), F.col("t") - 1).otherwise(F.col("h") - 1)).filter("last >= 0")
    as_right = as_right.select("d", "cell", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("x"), "y", "node", "copies", "vector", "visits", "lives", F.lit(1).alias("side"), F.lit(-1).alias("own"))
    tasks = as_left.unionByName(as_right).withColumn("same", F.col("own") == F.col("y")).drop("own")
    found = staged(tasks.groupBy("d", "cell", "x", "y").applyInPandas(_compared(cosine, kind), "node long, root long, links long"), "vector-links")
    groups = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = unique.select("h1", "h2", "node", "copies").join(links, "node", "left").join(groups, "node", "left")
    least = F.coalesce("component", "node")
    nodes = staged(nodes.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.when(least <= top, least).alias("component_id")), "vector-groups")
    linked = rows.filter("fine").join(bounded(nodes), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def without_near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """vectors with one row for each group: the one of the least id."""
    gone = staged(near_duplicates(vectors, **options).filter("vec_id <> component_id").select(F.col("vec_id").alias("_gone")).distinct(), "gone-vectors")
    return vectors.join(bounded(gone), F.col("vec_id") == F.col("_gone"), "left_anti")
