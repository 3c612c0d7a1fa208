"""Seven chunking strategies: passages in, chunks out, as array expressions in one projection without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.config import DEFAULT, Settings
from siftwell.functions import text as T
from siftwell.functions.vectors import distances, dot, encoded


def slices(text: Column, size: int) -> Column:
    """A text in windows of so many units."""
    return T.bind(T.runs(text, size), lambda runs: F.when(F.size(runs) <= 1, F.array(text)).otherwise(F.filter(F.transform(runs, T.stripped), lambda s: s != "")))


def sliding(text: Column, size: int, overlap: int) -> Column:
    """Windows of size units, each starting size - overlap after the one before, up to the first that reaches the end.

    The text is cut into runs of a stride; a window is a run and the beginning of those after it.
    """
    stride = max(1, size - overlap)
    whole, part = divmod(size, stride)
    begin = rf"(?U)^(?:\S++\s*+){{1,{part}}}"

    def window(runs: Column, k: Column) -> Column:
        more = [F.coalesce(F.get(runs, k + i), F.lit("")) for i in range(whole)]
        return T.stripped(F.concat(*more, F.regexp_extract(F.coalesce(F.get(runs, k + whole), F.lit("")), begin, 0) if part else F.lit("")))

    def cut(runs: Column, n: Column) -> Column:
        last = F.ceil((n - size) / stride).cast("int")
        return F.when(n <= size, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: window(runs, k)))

    return T.bind(T.runs(text, stride), lambda runs: T.bind((F.size(runs) - 1) * stride + T.size_of(F.get(runs, F.size(runs) - 1)), lambda n: cut(runs, F.coalesce(n, F.lit(0)))))


def pack(units: Column, budget: int, overlap: int) -> Column:
    """Units joined greedily up to the budget. A new chunk begins with the longest run of whole last units within the overlap.

    A unit over the budget ends the chunk, is cut into windows, and leaves no overlap.
    """
    sized = F.transform(units, lambda u: F.struct(u.alias("u"), T.size_of(u).alias("n")))
    none = F.array().cast("array<struct<u:string,n:int>>")
    start = F.struct(T.empty_strings().alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def joined(open_: Column) -> Column:
        return F.array_join(F.transform(open_, lambda x: x["u"]), " ")

    def closed(state: Column) -> Column:
        return F.when(F.size(state["open"]) > 0, F.array_append(state["done"], joined(state["open"]))).otherwise(state["done"])

    def total(units_: Column) -> Column:
        return F.aggregate(units_, F.lit(0), lambda s, x: s + x["n"])

    def tail(open_: Column) -> Column:
        if not overlap:
            return none
        return F.filter(open_, lambda x, i: total(F.slice(open_, i + 1, F.size(open_))) <= overlap)

    def step(state: Column, unit: Column) -> Column:
        cut = F.struct(F.concat(closed(state), slices(unit["u"], budget)).alias("done"), none.alias("open"), F.lit(0).alias("n"))
        turned = T.bind(tail(state["open"]), lambda kept: F.struct(closed(state).alias("done"), F.array_append(kept, unit).alias("open"), (total(kept) + unit["n"]).alias("n")))
        grown = F.struct(state["done"].alias("done"), F.array_append(state["open"], unit).alias("open"), (state["n"] + unit["n"]).alias("n"))
        return F.when(unit["n"] > budget, cut).when((state["n"] + unit["n"] > budget) & (F.size(state["open"]) > 0), turned).otherwise(grown)

    chunks = F.aggregate(sized, start, step, closed)
    return F.filter(F.transform(chunks, T.stripped), lambda s: s != "")


def _split_large(parts: Column, budget: int, split: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(parts, lambda p: F.when(T.size_of(p) <= budget, F.array(p)).otherwise(split(p))))


def descend(text: Column, budget: int) -> Column:
    """Units within the budget where possible: by blank line, then line, then sentence, then window; each level splits only what is too large."""
    parts = F.filter(F.array(T.stripped(text)), lambda s: s != "")
    for split in (lambda p: T.split_at(p, "\n\n"), lambda p: T.split_at(p, "\n"), T.sentences, lambda p: slices(p, budget)):
        parts = _split_large(parts, budget, split)
    return parts


def script_sentences(text: Column) -> Column:
    """Sentences by the rules of the text's script; the text itself without any."""

    def split(script: Column) -> Column:
        return F.when(script.isin("Devanagari", "Gujarati"), T.split_at(text, T.SENTENCE_END_INDIC)).when(script == "Latin", T.split_at(text, T.SENTENCE_END_LATIN)).otherwise(T.split_at(text, T.SENTENCE_END_MIXED))

    return T.bind(T.bind(T.detect_script(text), split), lambda found: F.when(F.size(found) == 0, F.array(text)).otherwise(found))


def percentile_of(values: Column, percent: float) -> Column:
    """Percentile of an array's numbers, interpolated between neighbours."""
    at = (F.size(values) - 1) * (percent / 100.0)

    def between(ordered: Column) -> Column:
        low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.least(F.floor(at).cast("int") + 1, F.size(values) - 1))
        return low + (high - low) * (at - F.floor(at))

    return T.bind(F.array_sort(values), between)


def with_topic_runs(rows: DataFrame, text: Column, most: int, percent: float, encoder: Callable[[Column], Column] = encoded) -> DataFrame:
    """rows with ``_runs``: runs of sentences, cut where neighbours are further apart than that percentile of the text's own
    distances, or at most units. Step by step in columns of their own, so that each sentence is encoded once; by the default
    encoder in Arrow batches, as its expression goes over a sentence's tokens once for each dimension."""
    rows = rows.withColumn("_sents", T.sentences(text))
    if encoder is encoded:
        apart = distances(F.col("_sents"))
    else:
        rows = rows.withColumn("_vecs", F.transform("_sents", lambda s: encoder(s)))
        apart = F.transform(F.sequence(F.lit(1), F.size("_sents") - 1), lambda i: 1.0 - dot(F.get("_vecs", i - 1), F.get("_vecs", i)))
    rows = rows.withColumn("_apart", F.when(F.size("_sents") >= 2, apart))
    # bound, as the fold below would otherwise take the percentile anew for each sentence
    far = T.bind(percentile_of(F.col("_apart"), percent), lambda limit: F.transform("_apart", lambda d: d > limit))
    units = F.zip_with(F.slice("_sents", 2, F.greatest(F.size("_sents") - 1, F.lit(0))), far, lambda s, d: F.struct(s.alias("s"), T.size_of(s).alias("n"), d.alias("d")))
    first = F.get("_sents", F.lit(0))
    start = F.struct(T.empty_strings().alias("done"), first.alias("open"), T.size_of(first).alias("n"))

    def step(state: Column, x: Column) -> Column:
        cut = F.struct(F.array_append(state["done"], state["open"]).alias("done"), x["s"].alias("open"), x["n"].alias("n"))
        grown = F.struct(state["done"].alias("done"), F.concat_ws(" ", state["open"], x["s"]).alias("open"), (state["n"] + x["n"]).alias("n"))
        return F.when(x["d"] | (state["n"] + x["n"] > most), cut).otherwise(grown)

    runs = F.aggregate(units, start, step, lambda s: F.array_append(s["done"], s["open"]))
    return rows.withColumn("_runs", F.when(F.size("_sents") < 2, F.array(text)).otherwise(runs)).drop("_sents", "_vecs", "_apart")


def _parts(strategy: str, text: Column, settings: Settings) -> Column:
    size, overlap = settings.chunk_sizes[strategy]
    if strategy in ("fixed", "passage_native"):
        return slices(text, size)
    if strategy == "sliding":
        return sliding(text, size, overlap)
    if strategy == "recursive":
        return pack(descend(text, size), size, overlap)
    if strategy == "parent_child":
        return T.bind(pack(T.sentences(text), size, overlap), lambda children: F.when(F.size(children) == 0, F.array(text)).otherwise(children))
    return pack(script_sentences(text), size, overlap)


def limited(parts: Column, settings: Settings = DEFAULT) -> Column:
    """Parts stripped, none blank, none over the encoder's limit."""
    limit, step = settings.encoder_limit, settings.encoder_limit - settings.encoder_margin
    whole = F.filter(F.transform(parts, T.stripped), lambda s: s != "")
    cut = F.transform(whole, lambda p: F.when((F.length(p) <= limit) | (T.size_of(p) <= limit), F.array(p)).otherwise(slices(p, step)))
    return F.flatten(cut)


STRATEGIES = tuple(DEFAULT.chunk_sizes)


def chunk(passages: DataFrame, strategy: str, settings: Settings = DEFAULT, custom: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Passages (passage_id, doc_id, text, lang and more) -> chunks: the passage's columns with chunk_id, text, context, meta.

    custom: further strategies by name, each a function from a text column to an array of parts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    if custom and strategy in custom:
        parts = custom[strategy](text)
    elif strategy == "semantic":
        passages = with_topic_runs(passages, text, settings.chunk_sizes[strategy][0], settings.semantic_percentile)
        parts = F.col("_runs")
    elif strategy in settings.chunk_sizes:
        parts = _parts(strategy, text, settings)
    else:
        raise ValueError(f"no chunking strategy {strategy!r}; there are {', '.join([*settings.chunk_sizes, *(custom or {})])}")
    whole = T.stripped(text) if strategy == "parent_child" else F.lit(None).cast("string")
    script = T.detect_script(text) if strategy == "indic_aware" else F.lit(None).cast("string")
    # the outer form, as the inner one has the parts evaluated twice; what holds for a passage is evaluated once for it
    rows = passages.withColumn("_whole", whole).withColumn("_script", script).select("*", F.posexplode_outer(limited(parts, settings)).alias("_i", "_part")).filter("_part is not null")
    context = F.coalesce("_whole", "_part")
    meta = F.create_map(F.lit("script"), F.col("_script")) if strategy == "indic_aware" else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("chunk_id", F.concat_ws(":", F.lit(strategy), F.col("passage_id"), F.col("_i"))).withColumn("context", context).withColumn("meta", meta)
    return rows.withColumn("text", F.col("_part")).drop("_i", "_part", "_runs", "_whole", "_script")


def chunk_with(passages: DataFrame, name: str, split: Callable[[str], Iterable[str]], settings: Settings = DEFAULT) -> DataFrame:
    """As chunk(), with a chunker in Python: split(text) gives the parts. It runs as an Arrow-batched function."""

    @F.pandas_udf("array<string>")
    def parts(text: pd.Series) -> pd.Series:
        return text.map(lambda t: list(split(t)))

    cut = passages.withColumn("_parts", parts(F.coalesce("text", F.lit(""))))
    return chunk(cut, name, settings, {name: lambda _: F.col("_parts")}).drop("_parts")
