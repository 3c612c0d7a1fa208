"""Per-language BM25: postings and statistics as tables, scoring as joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.config import DEFAULT, Settings
from siftwell.functions.text import tokens
from siftwell.operators.joins import exploded, few


def lengths(docs: DataFrame) -> DataFrame:
    """docs (id, lang, text) -> (id, lang, terms, dl)."""
    return docs.select("id", "lang", tokens(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))


def counts(held: DataFrame) -> DataFrame:
    """(lang, term, df, words, whole) of what lengths() gives: each document counts a term once, before any shuffle, and once for
    the language as a whole, in a row without term, with its words."""
    marked = exploded(held, ["lang", "dl"], F.array_union(F.array_distinct("terms"), F.array(F.lit(""))), "term")
    return marked.groupBy("lang", "term").agg(F.count("*").alias("df"), F.sum("dl").alias("words"), F.max(F.col("term") == "").alias("whole"))


def language_stats(counted: DataFrame) -> DataFrame:
    """(lang, n, avgdl) of what counts() gives."""
    return counted.filter("whole").select("lang", F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"))


def idf(counted: DataFrame, stats: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(lang, term, idf): a negative value is replaced by a share of the language's mean."""
    raw = counted.filter("not whole").join(F.broadcast(stats), "lang").select("lang", "term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy("lang").agg(F.avg("raw").alias("mean"))  # a row for each language
    return raw.join(F.broadcast(mean), "lang").select("lang", "term", F.when(F.col("raw") < 0, settings.epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


class Built(NamedTuple):
    """A BM25 index as tables: postings (lang, term, id, dl, tf), idf (lang, term, idf), stats (lang, n, avgdl)."""

    postings: DataFrame
    idf: DataFrame
    stats: DataFrame


def build(docs: DataFrame, settings: Settings = DEFAULT) -> Built:
    """docs (id, lang, text) -> the index of all their terms. Counts are combined before the shuffle."""
    held = lengths(docs)
    counted = counts(held)
    stats = language_stats(counted)
    postings = exploded(held, ["lang", "id", "dl"], F.col("terms"), "term").groupBy("lang", "id", "dl", "term").agg(F.count("*").alias("tf"))
    return Built(postings.select("lang", "term", "id", "dl", "tf"), idf(counted, stats, settings), stats)


def write(index: Built, path: str) -> None:
    """The index in parquet by language, postings in order of term within a file, so that a search reads few of their pages."""
    index.postings.repartitionByRange("lang", "term", "id").sortWithinPartitions("lang", "term", "id").write.mode("overwrite").partitionBy("lang").parquet(f"{path}/postings")
    index.idf.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/idf")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def read(spark: SparkSession, path: str) -> Built:
    return Built(*(spark.read.parquet(f"{path}/{part}") for part in Built._fields))


#: Questions of at most so many terms in all, and of so many terms times questions in a language, are scored document by document.
ASKED, CELLS = 200_000, 8_000_000
_ROWS, _TALLY = 2048, 4_000_000


class Weighed(NamedTuple):
    """What is asked in a language: mean length of a document, terms, and the weight of a term for a question by their numbers."""

    avgdl: float
    terms: pa.Array
    term: np.ndarray
    query: np.ndarray
    weight: np.ndarray


def search(queries: DataFrame, docs: DataFrame, limit: int, settings: Settings = DEFAULT, keys: DataFrame | None = None) -> DataFrame:
    """queries (query_id, lang, text) x docs (id, lang, text) -> (query_id, lang, id, score, rank), the best of the query's language.

    For one batch of queries without an index. The terms' statistics are counted first; then each task scores its documents one
    by one and passes on the best of each query, so what is shuffled and sorted does not grow with the documents that share a
    term. By joins of postings of the queries' terms where queries are too many for that, or where a language has an id twice.
    keys: (id, lang), unique just where those of docs are, if they are cheaper to read.
    """
    held = lengths(docs)
    asked, small = _asked(queries)
    found = asked.limit(ASKED + 1).toArrow()
    keys = (docs if keys is None else keys).select("id", "lang")
    single = dict(docs.dtypes)["id"] in ("bigint", "int", "string") and not keys.groupBy("id", "lang").count().filter("count > 1").take(1)
    of = _weighed(found, asked, held, settings) if found.num_rows <= ASKED and single else None
    if of is None or any(len(w.terms) * len(np.unique(w.query)) > CELLS for w in of.values()):
        counted = counts(held)
        stats = language_stats(counted)
        terms = small(asked.select("lang", "term").distinct())
        postings = exploded(held, ["id", "lang", "dl"], F.col("terms"), "term").join(terms, ["lang", "term"], "left_semi").groupBy("lang", "id", "dl", "term").agg(F.count("*").alias("tf"))
        return _scored(asked, small, Built(postings, idf(counted, stats, settings), stats), limit, settings)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, lang string, id {dict(docs.dtypes)['id']}, score double"
    best = held.select("id", "lang", "terms").mapInArrow(_best_of(of, _numbered(found["query_id"])[1], limit, settings), schema)
    return ranked(best, ["query_id", "lang"], F.col("score").desc(), limit)


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, and the values by number; null is a value."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(), coded.dictionary


def _weighed(found: pa.Table, asked: DataFrame, held: DataFrame, settings: Settings) -> dict[str, Weighed]:
    """The weights of what is asked, by language. Documents are read once: terms that are not asked count by their frequency only,
    which is all that the mean of the language needs."""
    said = asked.select("lang", "term").distinct().withColumn("said", F.lit(True))
    told = counts(held).join(F.broadcast(said), ["lang", "term"], "left").groupBy("lang", "df", "whole", F.when(F.col("said"), F.col("term")).alias("term"))
    rows = told.agg(F.count("*").alias("n"), F.sum("words").alias("words")).filter("lang is not null").toArrow()
    number, _ = _numbered(found["query_id"])
    out = {}
    for lang in pc.unique(rows["lang"]).to_pylist():
        own = rows.filter(pc.equal(rows["lang"], lang))
        whole = own.filter(own["whole"]).to_pylist()[0]
        own = own.filter(pc.invert(own["whole"]))
        at = np.flatnonzero(pc.fill_null(pc.equal(found["lang"], lang), False).to_numpy(zero_copy_only=False))
        if not own.num_rows or not len(at):
            continue
        df, n = own["df"].to_numpy().astype(float), own["n"].to_numpy()
        raw = np.log(whole["df"] - df + 0.5) - np.log(df + 0.5)
        value = np.where(raw < 0, settings.epsilon * (raw * n).sum() / n.sum(), raw)
        known = np.flatnonzero(own["term"].is_valid().to_numpy(zero_copy_only=False))
        terms = own["term"].take(known).combine_chunks()
        term = pc.fill_null(pc.index_in(found["term"].take(at), value_set=terms), -1).to_numpy()
        at, term = at[term >= 0], term[term >= 0]
        if len(at):
            out[lang] = Weighed(whole["words"] / whole["df"], terms, term, number[at], found["times"].to_numpy()[at] * value[known][term])
    return out


def _best_of(of: dict[str, Weighed], ids: pa.Array, limit: int, settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (id, lang, terms) -> (query_id, lang, id, score): of all the batches of a task the best of each question. A term
    said twice counts twice; scores are rounded to 6 places, ties go by id, and what scores 0 or less is left out."""
    k1, b = settings.k1, settings.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(sorted({t for w in of.values() for t in w.terms.to_pylist()}), "string")
        tables, kept = {}, {}
        for lang, w in of.items():
            asking, column = np.unique(w.query, return_inverse=True)
            weights = np.zeros((len(w.terms), len(asking)))
            np.add.at(weights, (w.term, column), w.weight)
            place = pc.fill_null(pc.index_in(words, value_set=w.terms), -1).to_numpy()
            tables[lang] = asking, weights, place, np.zeros(len(asking))
        rows = min([_ROWS, *(max(1, _TALLY // len(w.terms)) for w in of.values())])
        for batch in batches:
            for part in (batch.slice(k, rows) for k in range(0, batch.num_rows, rows)):
                names, sizes = np.array(part.column("lang").to_pylist(), object), part.column("terms").value_lengths().to_numpy()
                codes = pc.fill_null(pc.index_in(part.column("terms").flatten(), value_set=words), -1).to_numpy()
                of_doc = np.repeat(np.arange(len(sizes)), sizes)[codes >= 0]
                codes = codes[codes >= 0]
                for lang in {*names.tolist()} & tables.keys():
                    asking, weights, place, least = tables[lang]
                    docs = np.flatnonzero(names == lang)
                    at = np.full(len(names), -1)
                    at[docs] = np.arange(len(docs))
                    doc, term = at[of_doc], place[codes]
                    both = (doc >= 0) & (term >= 0)
                    tf = np.bincount(doc[both] * len(weights) + term[both], minlength=len(docs) * len(weights)).reshape(len(docs), -1)
                    share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[docs, None] / of[lang].avgdl))
                    score = np.floor(share @ weights * 1e6 + 0.5) / 1e6
                    if len(docs) > limit:
                        np.maximum(least, np.partition(score, -limit, axis=0)[-limit], out=least)
                    r, q = np.nonzero((score >= least) & (score > 0))
                    if len(r):
                        made = q, score[r, q], part.column("id").take(pa.array(docs[r]))
                        if lang in kept:
                            made = np.concatenate((kept[lang][0], made[0])), np.concatenate((kept[lang][1], made[1])), pa.concat_arrays([kept[lang][2], made[2]])
                        kept[lang] = _first(*made, limit, least)
        for lang, (q, score, found) in kept.items():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(tables[lang][0][q])), pa.array([lang] * len(q), "string"), found, pa.array(score)], ["query_id", "lang", "id", "score"])

    return run


def _first(query: np.ndarray, score: np.ndarray, ids: pa.Array, limit: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The first rows of each query by score and id; least is raised to the score of the last one where there are enough."""
    order = np.lexsort((pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy(), -score, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    full = order[place == limit - 1]
    least[query[full]] = np.maximum(least[query[full]], score[full])
    order = order[place < limit]
    return query[order], score[order], ids.take(pa.array(order))


def search_built(queries: DataFrame, index: Built, limit: int, settings: Settings = DEFAULT) -> DataFrame:
    """As search(), over an index that is there: only postings of the queries' terms pass the first join."""
    asked, small = _asked(queries)
    return _scored(asked, small, index, limit, settings)


def _asked(queries: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(query_id, lang, term, times), and the hint for what has at most as many rows: measured once, it decides for all joins."""
    asked = exploded(queries, ["query_id", "lang"], tokens(F.col("text")), "term").groupBy("query_id", "lang", "term").agg(F.count("*").alias("times"))
    return asked, F.broadcast if few(asked) else lambda df: df


def _scored(asked: DataFrame, small: Callable[[DataFrame], DataFrame], index: Built, limit: int, settings: Settings) -> DataFrame:
    """A term said twice counts twice. Scores are rounded to 6 places, ties go by id, and after the cut what scores 0 or less is dropped."""
    weights = index.idf.join(small(asked.select("lang", "term").distinct()), ["lang", "term"], "left_semi")
    k1, b, tf = settings.k1, settings.b, F.col("tf")
    hits = index.postings.join(small(weights), ["lang", "term"]).join(F.broadcast(index.stats), "lang").withColumn("part", F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    scored = hits.select("lang", "term", "id", "part").join(small(asked), ["lang", "term"]).groupBy("query_id", "lang", "id").agg(F.round(F.sum(F.col("times") * F.col("part")), 6).alias("score"))
    return ranked(scored, ["query_id", "lang"], F.col("score").desc(), limit).filter("score > 0")


def ranked(df: DataFrame, by: list[str], order: Column, limit: int, tie: str = "id") -> DataFrame:
    """The first rows of each group with their rank from 1; groups are cut before and after the shuffle."""
    at = Window.partitionBy(*by).orderBy(order, F.col(tie))
    return df.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))
