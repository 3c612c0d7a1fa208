"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, mixing of sources.

Each stage takes the documents that the one before kept and returns them with the columns of documents; the last returns
the mix, a row for each repetition of a document, with ``repetition`` and ``taken`` (its words) besides. What a stage
learns, it learns from its own input and from the tables beside it.

SQL cannot express the stages (trained vectors, SimHash tiles, a BM25 index, bootstrapping), so there is no ORACLE_SQL;
tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontam, mixing, pii, simhash, toxicity
from siftwell.llm.common import fold, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from labelled ones, does not reject."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of those alike in at least 0.8 of their five-word shingles, the one of the least id."""
    return simhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where it has that column, of the text as it is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return _counted(pii.redacted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight; n_chars follows the text, which is cut at a source's edge."""
    return _counted(mixing.mixed_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
