"""Corpus building: rows of a parallel corpus to passages and queries, with caps and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.config import DEFAULT, Settings
from siftwell.functions.text import normalized
from siftwell.operators.joins import sized

RAW = "ordinal bigint, query_id bigint, query string, Eng_Query string, Answer string, Eng_Answer string, passages struct<is_selected:array<int>,English_passages:array<string>,Translated_passages:array<string>>, target_lang string, query_type string"


def sides(raw: DataFrame, english: Column) -> DataFrame:
    """Each row with a selected passage as its translated side and, where english holds, its English one, in order (ordinal, side)."""
    chosen = raw.filter(F.exists(F.coalesce("passages.is_selected", F.array().cast("array<int>")), lambda x: x != 0))

    def side(df: DataFrame, number: int, query: str, answer: str, texts: str, lang: Column) -> DataFrame:
        return df.select("ordinal", F.lit(number).alias("side"), "query_id", "query_type", normalized(F.col(query)).alias("query"), normalized(F.col(answer)).alias("answer"), F.col(f"passages.{texts}").alias("texts"), F.col("passages.is_selected").alias("selected"), lang.alias("lang"))

    return side(chosen.filter(english), 0, "Eng_Query", "Eng_Answer", "English_passages", F.lit("en")).unionByName(side(chosen, 1, "query", "Answer", "Translated_passages", F.col("target_lang")))


def first_english(rows: DataFrame) -> DataFrame:
    """Sides with a query; of English ones the first of each query_id, which counts as seen even where its query is empty."""
    at = Window.partitionBy("lang", "query_id").orderBy("ordinal", "side")
    held = rows.withColumn("_r", F.when(F.col("lang") == "en", F.row_number().over(at)).otherwise(1))
    return held.filter((F.col("_r") == 1) & (F.col("query") != "")).drop("_r")


def kept_passages(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Sides with ``kept``: passages long enough, with their position and whether they are selected; and ``positive``, whether any is."""
    flags = F.coalesce("selected", F.array().cast("array<int>"))
    listed = F.transform("texts", lambda t, i: F.struct(normalized(t).alias("text"), i.alias("i"), F.coalesce(F.get(flags, i), F.lit(0)).alias("is_selected")))
    rows = rows.withColumn("kept", F.filter(listed, lambda p: F.length(p["text"]) >= settings.min_passage_chars))
    return rows.withColumn("positive", F.exists("kept", lambda p: p["is_selected"] != 0))


def capped(rows: DataFrame, cap: int, by: str = "lang", order: list[str] | None = None, size: Column | None = None) -> DataFrame:
    """Rows of a group as long as those before sum to less than cap: the one that goes over is the last.

    Where a group ends is found among its first cap rows that count, which is all that a task ever sorts; rows themselves
    stay where they are. rows is read twice.
    """
    keys = order or ["ordinal", "side"]
    counted = F.when(F.col("positive"), F.size("kept")).otherwise(0) if size is None else size
    held = rows.select(F.col(by).alias("_by"), F.struct(*keys).alias("_at"), counted.cast("long").alias("_n")).filter("_n > 0")
    at = Window.partitionBy("_by").orderBy("_at")
    first = held.withColumn("_k", F.row_number().over(at)).filter(F.col("_k") <= cap)
    last = first.withColumn("_sum", F.sum("_n").over(at.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") >= cap).groupBy("_by").agg(F.min("_at").alias("_last"))
    ends = rows.join(sized(last), F.col(by).eqNullSafe(F.col("_by")), "left")
    return ends.filter(F.col("_last").isNull() | (F.struct(*keys) <= F.col("_last"))).select(*rows.columns)


def passages(rows: DataFrame) -> DataFrame:
    """(passage_id, doc_id, text, lang, query_id, is_selected) of every kept passage."""
    doc = F.concat_ws(":", "lang", "query_id")
    return rows.select(doc.alias("doc_id"), "lang", "query_id", F.explode("kept").alias("p")).select(F.concat_ws(":", "doc_id", "p.i").alias("passage_id"), "doc_id", "p.text", "lang", "query_id", F.col("p.is_selected").alias("is_selected"))


def evaluation_queries(rows: DataFrame) -> DataFrame:
    """(query_id, query, lang, answer, query_type, relevant) of sides with a selected passage kept."""
    ids = F.transform(F.filter("kept", lambda p: p["is_selected"] != 0), lambda p: F.concat_ws(":", F.col("lang"), F.col("query_id"), p["i"]))
    return rows.filter("positive").select("query_id", "query", "lang", "answer", "query_type", ids.alias("relevant"))


def build(raw: DataFrame, english: Column, cap: int, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Raw rows -> (passages, queries)."""
    rows = capped(kept_passages(first_english(sides(raw, english)), settings), cap)
    return passages(rows), evaluation_queries(rows)


def stratified(rows: DataFrame, limit: int, by: str = "lang", order: str = "ordinal") -> DataFrame:
    """The first limit / groups rows of each group, one at least."""
    groups = rows.select(by).distinct().count()
    at = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(at)).filter(F.col("_r") <= max(1, limit // max(1, groups))).drop("_r")


def sampled(queries: DataFrame, n: int, seed: str, key: str, repeat_rate: float = 0.0) -> DataFrame:
    """n queries in the order of a seeded hash, with ``position``; a share of them repeats of others, where asked for."""
    extra = int(n * repeat_rate)
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    first = queries.withColumn("_h", order).orderBy("_h", key).limit(n - extra)
    if extra:
        at = first.withColumn("_k", F.row_number().over(Window.orderBy("_h", key)) - 1)
        picks = queries.sparkSession.range(extra).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n - extra)).cast("int").alias("_k"), F.col("id").alias("_copy"))
        again = at.join(F.broadcast(picks), "_k").withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("_copy"))))
        first = first.unionByName(again.select(*first.columns))
    return first.withColumn("position", F.row_number().over(Window.orderBy("_h", key)).cast("long")).drop("_h")
