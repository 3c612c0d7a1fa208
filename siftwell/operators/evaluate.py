"""Evaluation: recall and reciprocal rank, threshold sweeps, score summaries, latency and path statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.config import DEFAULT, Settings


def scorable(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """queries (query_id, relevant array) all of whose relevant ids are in corpus (id), and that have any."""
    wanted = queries.filter(F.size("relevant") > 0).select("query_id", F.explode("relevant").alias("id"))
    missed = wanted.join(corpus.select("id").distinct(), "id", "left_anti").select("query_id").distinct()
    return queries.filter(F.size("relevant") > 0).join(missed, "query_id", "left_anti")


def by_query(queries: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """queries (query_id, relevant array), hits (query_id, id, rank) -> (query_id, recall_at_k..., rr)."""
    wanted = queries.select("query_id", F.array_distinct("relevant").alias("relevant"))
    got = hits.filter(F.col("rank") <= max(ks)).groupBy("query_id").agg(F.collect_list(F.struct("id", "rank")).alias("_hits"))  # so many of each
    ranks = F.transform(F.filter("_hits", lambda h: F.array_contains("relevant", h["id"])), lambda h: h["rank"])
    joined = wanted.join(got, "query_id", "left").withColumn("_ranks", F.coalesce(ranks, F.array().cast("array<bigint>")))
    within = lambda k: F.size(F.filter("_ranks", lambda r: r <= k))
    return joined.select("query_id", *[F.try_divide(within(k), F.size("relevant")).alias(f"recall_at_{k}") for k in ks], F.coalesce(1.0 / F.array_min("_ranks"), F.lit(0.0)).alias("rr"))


def averages(per_query: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean recall at each k, and mean reciprocal rank, of all or by group."""
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(f"recall_at_{k}"), 6).alias(f"recall_at_{k}") for k in ks], F.round(F.avg("rr"), 6).alias("mrr")]
    return (per_query.groupBy(*by) if by else per_query).agg(*aggs)


def sweep(scores: DataFrame, by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """scores (score, positive) -> a row for each distinct rounded score: threshold, tpr, fpr, youden.

    Shares of raw scores at or over each threshold; null where a group has no row of a kind. Counts by step of the grid are
    summed from the top; no pair of score and threshold is made, and no task sorts raw scores.
    """
    by, scale = by or [], 10.0**digits
    # a raw score counts at the greatest threshold of the grid that it reaches, so there is a row for each step at most
    near = F.floor(F.col("score") * scale)
    reached = F.when(F.col("score") >= (near + 1) / scale, near + 1).when(F.col("score") < near / scale, near - 1).otherwise(near) / scale
    kept = scores.select(*by, "score", reached.alias("reached"), "positive")
    raw = kept.groupBy(*by, F.col("reached").alias("score")).agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("n"))
    marks = scores.select(*by, F.round("score", digits).alias("score")).distinct().withColumn("p", F.lit(0)).withColumn("n", F.lit(0)).withColumn("mark", F.lit(True))
    both = raw.withColumn("mark", F.lit(False)).unionByName(marks)
    down = Window.partitionBy(*by).orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    totals = both.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).withColumn("np", F.sum("p").over(whole)).withColumn("nn", F.sum("n").over(whole))
    shares = totals.filter("mark").select(*by, F.col("score").alias("threshold"), F.try_divide("tp", "np").alias("tpr"), F.try_divide("fp", "nn").alias("fpr"))
    return shares.withColumn("youden", F.col("tpr") - F.col("fpr"))


def choose(curve: DataFrame, by: list[str] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The threshold of most youden within the caps; of least where equal. Without any within both caps, that on tpr governs; else all."""
    by = by or []
    low, high = F.col("fpr") <= settings.target_fpr, F.col("tpr") >= settings.min_tpr
    tier = F.when(low & high, 0).when(high, 1).otherwise(2)
    order = Window.partitionBy(*by).orderBy(tier, F.round("youden", 4).desc(), "threshold")
    return curve.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def summary(scores: DataFrame, by: list[str], percents: tuple[float, ...]) -> DataFrame:
    """Count, mean and percentiles of score by group."""
    told = scores.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.percentile("score", F.array(*[F.lit(p) for p in percents])).alias("_p"))
    return told.select(*by, "n", F.round("mean", 6).alias("mean"), *[F.round(F.get("_p", F.lit(i)), 6).alias(f"p{int(p * 100):02d}") for i, p in enumerate(percents)])


def separation(scores: DataFrame, by: str, least_positive: int = 20, least_negative: int = 5) -> DataFrame:
    """By group with enough of both: p10 of positives, p90 of negatives, and their difference."""
    positive, negative = F.when(F.col("positive"), F.col("score")), F.when(~F.col("positive"), F.col("score"))
    held = scores.groupBy(by).agg(F.count(positive).alias("n_pos"), F.count(negative).alias("n_neg"), F.avg(positive).alias("in_mean"), F.percentile(positive, F.lit(0.1)).alias("in_p10"), F.avg(negative).alias("ood_mean"), F.percentile(negative, F.lit(0.9)).alias("ood_p90"))
    held = held.filter((F.col("n_pos") >= least_positive) & (F.col("n_neg") >= least_negative)).withColumn("separation", F.col("in_p10") - F.col("ood_p90"))
    return held.select(by, "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in ("in_mean", "in_p10", "ood_mean", "ood_p90", "separation")])


def support_pairs(queries: DataFrame, passages: DataFrame, seed: str) -> DataFrame:
    """queries (query_id, answer, relevant), passages (passage_id, text) -> (query_id, answer, text, positive): each answer with
    its first relevant passage, and with one picked by a seeded hash, which may be the same. The input of a grounding sweep.

    The pick is an equi-join: passages are numbered by ranges of the hash, and a query takes the first one at or after its own.
    """
    slots = 1 << 20
    gold = queries.select("query_id", "answer", F.get("relevant", F.lit(0)).alias("passage_id")).join(passages, "passage_id").select("query_id", "answer", "text", F.lit(True).alias("positive"))
    held = passages.groupBy(F.pmod(F.xxhash64("passage_id", F.lit(seed)), F.lit(slots)).alias("slot")).agg(F.min(F.struct("passage_id", "text")).alias("p"))
    asked = queries.select(F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(slots)).alias("slot"), "query_id", "answer")
    both = held.select("slot", F.col("p.text").alias("text"), F.lit(None).cast(dict(queries.dtypes)["query_id"]).alias("query_id"), F.lit(None).cast("string").alias("answer")).unionByName(asked.withColumn("text", F.lit(None).cast("string")))
    parts = both.withColumn("_part", F.floor(F.col("slot") * 64 / slots))
    ahead = F.first("text", ignorenulls=True).over(Window.partitionBy("_part").orderBy("slot").rowsBetween(0, Window.unboundedFollowing))
    behind = F.last("text", ignorenulls=True).over(Window.partitionBy("_part").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    picked = parts.withColumn("text", F.coalesce(ahead, behind)).filter("query_id is not null and text is not null")
    return gold.unionByName(picked.select("query_id", "answer", "text", F.lit(False).alias("positive")))


LATENCY = (0.5, 0.7, 0.9, 0.95, 0.99, 1.0)


def latency(rows: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """n, mean and P50 to P100 of a value, rounded to 2 places; null where there is none."""
    held = rows.select(*(by or []), value.alias("_v"))
    told = (held.groupBy(*by) if by else held).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.percentile("_v", F.array(*[F.lit(p) for p in LATENCY])).alias("_p"))
    return told.select(*(by or []), "n", F.round("mean", 2).alias("mean"), *[F.round(F.get("_p", F.lit(i)), 2).alias(f"p{int(p * 100)}") for i, p in enumerate(LATENCY)])


def answered(rows: DataFrame, by: list[str] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """rows (path, core_ms, refused) -> n, refused, percent within the budget, and P50 and P95 of core_ms, of all or by group."""
    aggs = [F.count("*").alias("n"), F.sum(F.col("refused").cast("long")).alias("refused"), F.avg((F.col("core_ms") <= settings.core_budget_ms).cast("double")).alias("_within"), F.percentile("core_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("_p")]
    told = (rows.groupBy(*by) if by else rows).agg(*aggs)
    return told.select(*(by or []), "n", "refused", F.round(F.col("_within") * 100.0, 1).alias("within_budget_pct"), F.round(F.get("_p", F.lit(0)), 2).alias("p50"), F.round(F.get("_p", F.lit(1)), 2).alias("p95"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Count by group, and its share of all in percent."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def stage_sums(spans: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """spans (request_id, stage, ms) -> (request_id, stages map, core_ms, total_ms, within_budget)."""
    per_stage = spans.groupBy("request_id", "stage").agg(F.sum("ms").alias("ms"))
    core = F.when(F.col("stage").isin(*settings.core_stages), F.col("ms")).otherwise(0.0)
    out = per_stage.groupBy("request_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "ms")))).alias("stages"), F.round(F.sum(core), 6).alias("core_ms"), F.round(F.sum("ms"), 6).alias("total_ms"))
    return out.withColumn("within_budget", F.col("core_ms") <= settings.core_budget_ms)


def marked_best(table: DataFrame, metrics: list[str], order: str) -> DataFrame:
    """A small table of results with best_<metric> flags and rank by one of them."""
    whole = Window.partitionBy()
    for m in metrics:
        table = table.withColumn(f"best_{m}", F.col(m) == F.max(m).over(whole))
    return table.withColumn("rank", F.row_number().over(whole.orderBy(F.col(order).desc(), *metrics)))


def chunk_stats(chunks: DataFrame, size: Column, first: int = 4000) -> DataFrame:
    """chunks (chunk_id, passage_id): how many, how many a passage, and sizes over the first in order of id."""
    sample = chunks.orderBy("chunk_id").limit(first).select(size.alias("s")).agg(F.round(F.avg("s"), 6).alias("mean_size"), F.round(F.percentile("s", F.lit(0.95)), 6).alias("p95_size"))
    counts = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("passage_id").alias("passages"))
    return counts.crossJoin(sample).withColumn("chunks_per_passage", F.round(F.try_divide("chunks", "passages"), 6))
