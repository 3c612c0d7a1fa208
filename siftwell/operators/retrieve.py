"""Dense top-k, rank fusion, reranking, and picking from ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.config import DEFAULT, Settings
from siftwell.operators.index import ranked


#: Queries that are held at once; more are taken in blocks, each a pass over the vectors.
QUERIES = 20_000
_ROWS, _SLACK = 2048, 2e-9


def _products(asked: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """asked (query_id, part, vec), vectors (id, part, vec) -> (query_id, id, score): of each batch the best of each query among
    the rows of its part; a query whose part is null is compared with all. A stated set of queries against all rows, in blocks."""
    kinds = dict(asked.dtypes), dict(vectors.dtypes)
    schema = f"query_id {kinds[0]['query_id']}, id {kinds[1]['id']}, score double"

    def compared(queries: pa.Table):
        ids, parts = queries["query_id"].combine_chunks(), queries["part"].to_pylist()
        q = _matrix(queries["vec"].combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least = np.full(len(parts), -np.inf)  # what the best of a batch so far have at least
            of_part = {p: np.flatnonzero([x is None or x == p for x in parts]) for p in {*parts, None}}
            for batch in batches:
                for part in (batch.slice(k, _ROWS) for k in range(0, batch.num_rows, _ROWS)):
                    names, x = np.array(part.column("part").to_pylist(), object), _matrix(part.column("vec"))
                    for name in set(names.tolist()):
                        rows, own = np.flatnonzero(names == name), of_part.get(name, of_part[None])
                        if not len(own) or x.shape[1] != q.shape[1]:
                            continue
                        like = x[rows] @ q[own].T
                        like[np.isnan(like)] = -np.inf
                        if len(rows) >= limit:
                            least[own] = np.maximum(least[own], np.partition(like, -limit, axis=0)[-limit])
                        r, c = np.nonzero((like >= least[own] - _SLACK) & (like > -np.inf))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[c])), part.column("id").take(pa.array(rows[r])), pa.array(like[r, c])], ["query_id", "id", "score"])

        return run

    blocks = -(-asked.count() // QUERIES)
    found = None
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else asked
        made = vectors.select("id", F.col("part").cast("string").alias("part"), "vec").mapInArrow(compared(block.toArrow()), schema)
        found = made if found is None else found.unionByName(made)
    return found if found is not None else vectors.sparkSession.createDataFrame([], schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors row by row in double precision; a row without one of the first length is NaN."""
    sizes = column.value_lengths().fill_null(-1).to_numpy()
    d = int(sizes[sizes > 0][0]) if (sizes > 0).any() else 0
    out = np.full((len(sizes), d), np.nan)
    fit = np.flatnonzero(sizes == d) if d else np.zeros(0, np.int64)
    if len(fit):
        out[fit] = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    return out


def dense(queries: DataFrame, vectors: DataFrame, limit: int, known: list[str] | None = None) -> DataFrame:
    """queries (query_id, part, vec) x vectors (id, part, vec) -> (query_id, id, score, rank) by inner product.

    A query of a part that vectors have is compared within it; one without part, or of an unknown one, with all.
    known: the parts, if they are known beforehand; else those that are asked are looked up in vectors.
    """
    part = F.col("part").cast("string")
    if known is None:
        wanted = [r.part for r in queries.select(part.alias("part")).filter("part is not null").distinct().collect()]
        known = [r.part for r in vectors.select(part.alias("part")).filter(F.col("part").isin(wanted)).distinct().collect()]
    asked = queries.select("query_id", F.when(part.isin(known), part).alias("part"), "vec")
    return ranked(_products(asked, vectors, limit).withColumn("score", F.round("score", 9)), ["query_id"], F.col("score").desc(), limit)


def dense_strict(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """As dense(), but a query without part, or of an unknown one, finds nothing."""
    asked = queries.filter("part is not null").select("query_id", F.col("part").cast("string").alias("part"), "vec")
    return ranked(_products(asked, vectors, limit).withColumn("score", F.round("score", 9)), ["query_id"], F.col("score").desc(), limit)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, limit: int, settings: Settings = DEFAULT) -> DataFrame:
    """Two ranked lists (query_id, id, score, rank) -> (query_id, id, rrf, dense_score, sources, rank), by weighted reciprocal rank."""

    def part(hits: DataFrame, tag: str, weight: float) -> DataFrame:
        score = F.col("score") if tag == "dense" else F.lit(0.0)
        return hits.filter(F.col("rank") <= settings.candidates).select("query_id", "id", (weight / (settings.rrf_k + F.col("rank"))).alias("share"), score.alias("dense_score"), F.lit(tag).alias("tag"))

    both = part(dense_hits, "dense", settings.dense_weight)
    if settings.sparse_weight > 0:
        both = both.unionByName(part(sparse_hits, "sparse", settings.sparse_weight))
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum("share"), 9).alias("rrf"), F.max("dense_score").alias("dense_score"), F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("sources"))
    return ranked(fused, ["query_id"], F.col("rrf").desc(), limit)


def rerank(hits: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], lang: str = "en", first: int = 20) -> DataFrame:
    """hits (query_id, lang, query, text, rank) with ``rank`` anew: the first of each query by the scorer, the rest as they are.

    Queries of other languages, or with one hit only, stay as they are. Only rows that need a score reach Python.
    """
    score = F.pandas_udf(scorer, "double")
    counted = hits.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    due = (F.col("lang") == lang) & (F.col("_n") >= 2) & (F.col("rank") <= first)
    scored = counted.filter(due).withColumn("rerank_score", score("query", "text")).unionByName(counted.filter(~F.coalesce(due, F.lit(False))).withColumn("rerank_score", F.lit(None).cast("double")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").isNull(), F.col("rerank_score").desc(), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).drop("_n")


def best_passages(hits: DataFrame, limit: int = 10, depth: int = 100) -> DataFrame:
    """Ranked chunks (query_id, passage_id, rank) -> ranked passages, each by its best chunk."""
    best = hits.filter(F.col("rank") <= depth).groupBy("query_id", "passage_id").agg(F.min("rank").alias("best"))
    return ranked(best, ["query_id"], F.col("best"), limit, "passage_id")


def best_hit(hits: DataFrame) -> DataFrame:
    """The hit of the highest dense score of each query; the earlier of equals."""
    return ranked(hits.withColumnRenamed("rank", "_rank"), ["query_id"], F.col("dense_score").desc(), 1, "_rank").drop("rank").withColumnRenamed("_rank", "rank")


def search(queries: DataFrame, index: DataFrame, limit: int, strict: bool = False) -> DataFrame:
    """Dense search by the rules of the exact index, or of a store that knows its parts only (strict)."""
    return dense_strict(queries, index, limit) if strict else dense(queries, index, limit)
