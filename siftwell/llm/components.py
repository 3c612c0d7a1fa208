"""Connected components: locally over numpy links, globally by alternating stars over a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, staged


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[k] and j[k] for every k; a set's root is its least member."""
    while len(i):
        i, j = roots(parent, i), roots(parent, j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def with_nodes(unique: DataFrame, name: str) -> tuple[DataFrame, int]:
    """unique with ``node``, its ``id`` or, where that is null, a number above all ids, staged; and the greatest id."""
    top = unique.agg(F.max("id")).first()[0]
    top = -1 if top is None else top
    node = F.coalesce("id", F.monotonically_increasing_id() + F.lit(top + 1))
    return staged(unique.withColumn("node", node.cast("long")), name), top


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Links that one task may hold, at 16 bytes each.
ONE_TASK = 1_000_000


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    a, b = (np.concatenate([h[i] for h in held] or [np.zeros(0, np.int64)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = np.arange(len(nodes))
    unite(parent, at[: len(a)], at[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots(parent, parent)])], ["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) links between ids -> (node, component), the least id that can be reached; nodes without links are absent.

    Up to ``one_task`` links are united by one task. Beyond, in rounds: large-star and small-star rounds, in number about the logarithm of a component's size. Every round is staged, so a
    lost executor costs one round at most. The minimum by node is combined before the shuffle; where a hub's edges
    meet it, the minima are broadcast if few, else joined by shuffle with both sides read from staged tables, whose
    skewed partitions Spark splits.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = staged(edges, "edges")
    state = _state(edges)
    if state[0] <= one_task:
        return staged(edges.coalesce(1).mapInArrow(_solved, "node long, component long"), "components")
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = staged(both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low")).withColumn("low", F.least("low", "hub")), "least")
        edges = both.join(bounded(least), F.col("a") == F.col("hub")).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = staged(edges.distinct(), "edges")
        least = staged(edges.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low")), "least")
        joined = edges.join(bounded(least), F.col("a") == F.col("hub")).select("a", "b", "low")
        edges = joined.select("a", F.col("low").alias("b")).union(joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")))
        edges = staged(edges.distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
