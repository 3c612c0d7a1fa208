"""Mixing sources to target weights by capped water-filling.

Each source has a weight and may be repeated up to ``max_epochs`` times. A budget of words is dealt by weight; a
source whose share is over its cap is clamped to it, and the excess goes to the others by weight until none is over.
The fixed point has a closed form: with the sources in order of cap / weight, the water level is the greatest of
(budget - caps before) / (weights from here on), and each source gets the lesser of its cap and weight times level.

A source's target is then realised by whole repetitions of all its documents and one seeded fractional repetition:
its documents in the order of a seeded hash until the words run out; the document at the edge is taken in part, so a
source's words equal its target but for less than one word.

Scale: sizes are counted once, into a narrow table. The order within a source is found from counts in 4096 hash ranges,
then in 4096 ranges within the one where the source's words run out; only the documents there, one in 16 million, are
ever sorted. No source's rows meet in one task, however hot it is. Sources themselves are planned in one task: a row for each.

Defined cases: a null text has no words and takes none; null sources form one source, ordered last; null ids are alike in
order; repeated rows are rows of their own, and where a source's words run out among rows alike in id and size, they are
numbered in one task; an empty table gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, fits, staged, word_count

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2


def _order(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with weight and target. Weights repeat over the sources by code point, null last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    ranked = ranked.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    ranked = ranked.withColumn("level", (F.col("total") * F.lit(float(budget_share)) - F.coalesce(F.sum("cap").over(level), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(level), F.lit(0))))
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(whole))).select("source", "source_size", "weight", "target")


def _passed(counts: DataFrame, limits: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """counts (source, at, words), limits (source, words to take) -> (source, at, before): where in order of ``at`` the words
    pass the limit, and the words before; a source that never passes it has no row."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    held = counts.withColumn("upto", upto).join(small(limits.select(F.col("source").alias("_s"), "take")), F.col("source").eqNullSafe(F.col("_s")))
    held = held.filter((F.col("upto") > F.col("take")) & (F.col("upto") - F.col("words") <= F.col("take")))
    return held.groupBy("source").agg(F.min(F.struct("at", (F.col("upto") - F.col("words")).alias("before"))).alias("edge")).select("source", "edge.at", "edge.before")


def mix(docs: DataFrame, *, size: Column, source: Column, doc_id: Column, seed: str = SEED, weights: Sequence[int] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, narrow: bool = False) -> DataFrame:
    """docs with a struct ``_mix`` of size, source_size, target, whole (repetitions of the whole text) and part (words of one more).

    docs is read twice: for a table of sizes, from which all is planned, and for the result; narrow: docs is itself such a
    table, cheap to read. A column of docs named ``_mix`` is replaced.
    """
    kept = [c for c in docs.columns if c != "_mix"]
    sized = docs.select(F.struct(*kept).alias("row"), F.struct(source.alias("source"), _order(doc_id, seed).alias("h"), doc_id.alias("id"), size.cast("long").alias("size")).alias("k"))
    sizes = sized.select("k.*") if narrow else staged(sized.select("k.*"), "mix-sizes")
    ranges = staged(sizes.groupBy("source", F.substring("h", 1, 3).alias("at")).agg(F.sum("size").alias("words")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget_share, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0).cast("long")))
    targets = staged(targets.withColumn("take", F.floor(F.col("target") - F.col("whole") * F.col("source_size"))), "mix-targets")
    small = F.broadcast if fits(targets) else lambda df: df  # for what has a row for each source at most
    # the range of hashes where a source's words run out, then the range within it, then its documents one by one
    first = staged(_passed(ranges, targets, small), "mix-edges")
    at_first = first.select(F.col("source").alias("_s"), F.col("at").alias("_at"), "before")
    inside = sizes.join(small(at_first.drop("before")), F.col("source").eqNullSafe(F.col("_s")) & (F.substring("h", 1, 3) == F.col("_at"))).groupBy("source", F.substring("h", 1, 6).alias("at")).agg(F.sum("size").alias("words"))
    rest = targets.join(small(at_first), F.col("source").eqNullSafe(F.col("_s"))).select("source", (F.col("take") - F.col("before")).alias("take"))
    second = staged(_passed(inside, rest, small), "mix-edges")
    at_second = second.select(F.col("source").alias("_s"), F.col("at").alias("_at"), F.col("before").alias("_within"))
    plan = targets.join(small(at_first.select(F.col("_s").alias("_s1"), F.col("before").alias("_b1"))), F.col("source").eqNullSafe(F.col("_s1")), "left").join(small(at_second), F.col("source").eqNullSafe(F.col("_s")), "left")
    plan = plan.select(F.struct("source", "source_size", "target", "whole", "take", F.col("_at").alias("edge"), (F.col("_b1") + F.col("_within")).alias("before")).alias("p"))
    # documents of the edge ranges in order; those alike in source, id and size are counted together
    edge = sizes.join(small(plan), F.col("source").eqNullSafe(F.col("p.source")) & (F.substring("h", 1, 6) == F.col("p.edge")))
    edge = edge.groupBy("source", "h", "id", "size").agg(F.count("*").alias("copies"), F.first("p.before").alias("from"))
    order = Window.partitionBy("source").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("from") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))
    edge = staged(edge.select(F.struct("source", "h", "id", "size", "copies", before.alias("before")).alias("e")), "mix-edge-documents")
    same = (F.col("k.h") == F.col("e.h")) & F.col("k.source").eqNullSafe(F.col("e.source")) & F.col("k.id").eqNullSafe(F.col("e.id")) & (F.col("k.size") == F.col("e.size"))
    joined = sized.join(small(plan), F.col("k.source").eqNullSafe(F.col("p.source"))).join(bounded(edge), same, "left")
    off_edge = F.when((F.col("p.take") > 0) & (F.col("p.edge").isNull() | (F.substring("k.h", 1, 6) < F.col("p.edge"))), F.col("k.size")).otherwise(F.lit(0).cast("long"))

    def with_part(df: DataFrame, number: Column) -> DataFrame:
        on_edge = F.greatest(F.lit(0).cast("long"), F.least(F.col("k.size"), F.col("p.take") - F.col("e.before") - number * F.col("k.size")))
        mixed = F.struct(F.col("k.size").alias("size"), F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), F.col("p.whole").alias("whole"), F.when(F.col("e.h").isNull(), off_edge).otherwise(on_edge).alias("part"))
        return df.select("row.*", mixed.alias("_mix"))

    if not edge.filter("e.copies > 1").take(1):
        return with_part(joined, F.lit(0))
    repeated = F.coalesce(F.col("e.copies") > 1, F.lit(False))
    number = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.to_json("row")))) - 1
    return with_part(joined.filter(~repeated), F.lit(0)).unionByName(with_part(joined.filter(repeated).withColumn("number", number), F.col("number")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix holds them: a row for each repetition, numbered by ``repetition`` from 1; ``taken`` has its words.

    The document at a source's edge ends after its last taken word in its last repetition. A document that the mix
    leaves out is gone; one without words stays once, as it costs nothing. Columns of docs named ``repetition`` or
    ``taken`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("_mix", "repetition", "taken")]
    mixed = mix(docs, size=word_count(F.col("text")), source=F.col("source"), doc_id=F.col("doc_id"), **options)
    m = F.col("m")
    rows = mixed.select(F.struct(*kept).alias("row"), F.col("_mix").alias("m"))
    copies = F.when(m["size"] == 0, F.lit(1)).otherwise(m["whole"] + F.when(m["part"] > 0, 1).otherwise(0)).cast("int")
    rows = rows.withColumn("repetition", F.explode_outer(F.when(copies > 0, F.sequence(F.lit(1), copies)))).filter("repetition is not null")
    taken = F.when(F.col("repetition") <= m["whole"], m["size"]).otherwise(m["part"])
    cut = F.call_function("regexp_extract", F.col("row.text"), F.concat(F.lit(r"^(?s:[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), (taken - 1).cast("string"), F.lit(r"}+[^\x20\x09-\x0D]++)")), F.lit(0))
    text = F.when((taken > 0) & (taken < m["size"]), cut).otherwise(F.col("row.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept], "repetition", taken.alias("taken"))


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix-1:' || coalesce(doc_id::varchar, '')) as h
  from documents),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight
  from sums),
levels as (
  select *,
    ((sum(source_size) over ()) * 1.5::double
      - coalesce(sum(2 * source_size) over (order by (2 * source_size)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / ((sum(weight) over ())
      - coalesce(sum(weight) over (order by (2 * source_size)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double as level
  from ranked),
targets as (select source, source_size, least((2 * source_size)::double, weight * (max(level) over ())) as target from levels),
plan as (
  select *, case when source_size > 0 then least(2, floor(target / source_size))::bigint else 0 end as whole
  from targets),
ordered as (
  select d.doc_id, d.size, p.source_size, p.target, p.whole,
    floor(p.target - p.whole * p.source_size)::bigint
      - coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as rest
  from sized d join plan p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest)))::bigint as taken from ordered
"""
