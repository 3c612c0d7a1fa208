"""Sources and sinks: corpora, queries, chunks, vectors, and the manifest that ties an index together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "passage_id string, doc_id string, text string, lang string, query_id bigint, is_selected int"
QUERIES = "query_id bigint, query string, lang string, answer string, query_type string, relevant array<string>"
CHUNKS = ("chunk_id", "passage_id", "doc_id", "lang", "text", "context", "query_id")
STORED = "chunk_id string, doc_id string, vec array<double>, version bigint, lang string"


def parallel_corpus(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of a parallel corpus in parquet; only the columns named are read. ``ordinal`` numbers the rows in file order."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Passages in JSON lines, absent keys with their defaults; the first ``limit`` lines where it is given and not 0."""
    df = spark.read.schema(CORPUS).json(path).withColumn("ordinal", F.monotonically_increasing_id())
    df = df.fillna({"text": "", "query_id": -1, "is_selected": 0})
    return df.orderBy("ordinal").limit(limit) if limit else df


def queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERIES).json(path)


def outside_queries(spark: SparkSession, path: str) -> DataFrame:
    """(lang, query) of a JSON object with a list of queries that no passage answers."""
    return spark.read.schema("note string, queries array<struct<lang:string,query:string>>").option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.lang", "q.query")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks by language in parquet, a context equal to the text left empty. Returns the count by language."""
    kept = chunks.withColumn("context", F.when(F.col("context") == F.col("text"), "").otherwise(F.col("context"))).select(*CHUNKS)
    kept.write.mode("overwrite").partitionBy("lang").parquet(path)
    return counts(chunks.sparkSession.read.parquet(path))


def write_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Vectors (chunk_id, lang, vec) by language in parquet. Returns the count by language."""
    vectors.write.mode("overwrite").partitionBy("lang").parquet(path)
    return counts(vectors.sparkSession.read.parquet(path))


def upsert_vectors(vectors: DataFrame, path: str, version: int) -> None:
    """Put vectors (chunk_id, doc_id, lang, vec) into the store at path; of a chunk of a language the greatest version counts.

    Files are only added, so nothing that is stored is read or rewritten; an upsert done again with its version changes nothing.
    """
    kept = vectors.select("chunk_id", "doc_id", F.col("vec").cast("array<double>").alias("vec"), F.lit(version).cast("long").alias("version"), "lang")
    kept.write.mode("append").partitionBy("lang").parquet(path)


def recreate_vectors(vectors: DataFrame, path: str, version: int = 0) -> None:
    """upsert_vectors, but what the store held of the languages that vectors have is gone; other languages stay."""
    kept = vectors.select("chunk_id", "doc_id", F.col("vec").cast("array<double>").alias("vec"), F.lit(version).cast("long").alias("version"), "lang")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(path)


def stored_vectors(spark: SparkSession, path: str, doc_ids: list[str] | None = None) -> DataFrame:
    """(chunk_id, doc_id, lang, vec) of the store, one row per chunk and language; only of the documents named, if any are.

    Of rows of one version the greatest (doc_id, vec) counts. A filter on lang reaches the partitions.
    """
    held = spark.read.schema(STORED).parquet(path).groupBy("lang", "chunk_id").agg(F.max(F.struct("version", "doc_id", "vec")).alias("v"))
    found = held.select("chunk_id", "v.doc_id", "lang", "v.vec")
    return found if doc_ids is None else found.filter(F.col("doc_id").isin(doc_ids))


def read_index(spark: SparkSession, chunks: str, vectors: str) -> DataFrame:
    """Chunks with their vectors; what lacks either is left out."""
    return spark.read.parquet(chunks).join(spark.read.parquet(vectors).select("chunk_id", "vec"), "chunk_id")


def counts(df: DataFrame) -> DataFrame:
    return df.groupBy("lang").agg(F.count("*").alias("n"))


def manifest(chunks: DataFrame, strategy: str, model: str, dim: int, built_at: str) -> DataFrame:
    """One row: strategy, passages, chunks, model, dim, langs, per_lang, built_at."""
    by = chunks.groupBy("lang").agg(F.count("*").alias("n"))
    totals = by.agg(F.sum("n").alias("chunks"), F.sort_array(F.collect_list("lang")).alias("langs"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n")))).alias("per_lang"))
    seen = chunks.agg(F.countDistinct("passage_id").alias("passages"))
    return totals.crossJoin(seen).select(F.lit(strategy).alias("strategy"), "passages", "chunks", F.lit(model).alias("model"), F.lit(dim).alias("dim"), "langs", "per_lang", F.lit(built_at).alias("built_at"))


def verify(manifest_row: DataFrame, vectors: DataFrame, postings: DataFrame | None, sparse_weight: float, store: DataFrame | None = None) -> DataFrame:
    """(check, passed): vectors match the manifest; postings are there where the sparse branch has weight; a store matches unless it is empty."""
    told = manifest_row.select("chunks")
    matched = told.crossJoin(vectors.agg(F.count("*").alias("n"))).select(F.lit("vectors match manifest").alias("check"), (F.col("n") == F.col("chunks")).alias("passed"))
    held = (postings is not None and bool(postings.take(1))) or sparse_weight <= 0
    checks = matched.unionByName(told.select(F.lit("postings present").alias("check"), F.lit(held).alias("passed")))
    if store is None:
        return checks
    stored = told.crossJoin(store.agg(F.count("*").alias("n"))).filter("n > 0")
    return checks.unionByName(stored.select(F.lit("store matches manifest").alias("check"), (F.col("n") == F.col("chunks")).alias("passed")))
