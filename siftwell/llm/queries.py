"""The registered queries of this subpackage, one for each operator, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontam, langid, lm_score, mixing, pii, quality, simhash, substring, toxicity, vectors
from siftwell.llm.common import bounded, fold, staged, table, word_count


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page (text, markup, address, host) and of every document (text, with its source for a host)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    languages, likelihoods = langid.fit(docs.filter(fold(F.col("doc_id")) != 0), F.col("doc_id"))
    html = F.col("html")
    rows = pages.select(F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id")).alias("key"), langid.visible(html).alias("text"), langid.declared(html).alias("declared"), langid.host(F.col("url")).alias("host"))
    rows = rows.unionByName(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id")).alias("key"), "text", F.lit("").alias("declared"), F.col("source").alias("host")))
    return langid.identify(rows, languages, likelihoods).select("key.*", "lang", "confidence", "text_lang")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    m = F.col("_mix")
    mixed = mixing.mix(staged(docs, "mix-sizes"), size=F.col("size"), source=F.col("source"), doc_id=F.col("doc_id"), narrow=True)
    return mixed.select("doc_id", "size", m["source_size"].alias("source_size"), m["target"].alias("target"), (m["whole"] * F.col("size") + m["part"]).alias("taken"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against those labelled as of good quality."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("_good")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.scores(docs.join(bounded(good), F.col("doc_id") == F.col("_good"), "left"), F.col("_good").isNotNull())


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats_removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.spelled("_base").cast("binary"), 256).alias("base_sha256"), pii.spelled("_spans").alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict:
    return {"op1_language": op1_language, "op2_mixing": op2_mixing, "op3_lm_score": op3_lm_score, "op4_substring": op4_substring, "op5_decontamination": op5_decontamination, "op6_vectors": op6_vectors, "op7_quality": op7_quality, "op8_simhash": op8_simhash, "op9_pii": op9_pii, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE_SQL}
