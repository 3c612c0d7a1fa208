"""Answers: spans out of passages, and the routing of a batch of questions to one uniform record."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.config import DEFAULT, Settings
from siftwell.functions import text as T
from siftwell.functions.vectors import dot, encoded
from siftwell.operators import guards

Encoder = Callable[[Column], Column]


def extract(rows: DataFrame, source: Column, query_vec: Column, score: Column, settings: Settings = DEFAULT, encoder: Encoder = encoded) -> DataFrame:
    """rows with ``_found``: (answer, confidence, span_similarity) of the sentence of source nearest to the question, with the next if nearly as near; null if none is near enough.

    Step by step in columns of their own, so that each sentence is encoded once; a source whose score is too low has no sentence encoded.
    """
    fit = score >= settings.extractive_min_score
    rows = rows.withColumn("_sents", F.when(fit, T.sentences(source)).otherwise(T.empty_strings()))
    rows = rows.withColumn("_sims", F.transform("_sents", lambda s: F.round(dot(encoder(s), query_vec), 9)))
    rows = rows.withColumn("_at", F.array_position("_sims", F.array_max("_sims")).cast("int")).withColumn("_sim", F.array_max("_sims"))
    first, following = F.get("_sents", F.col("_at") - 1), F.get("_sents", F.col("_at"))
    near = (F.get("_sims", F.col("_at")) >= F.col("_sim") - settings.extractive_join) & (F.length(F.concat_ws(" ", first, following)) <= settings.max_span_chars)
    alone = F.size("_sents") == 1
    rows = rows.withColumn("_span", F.when(alone, first).when(F.col("_sim") >= settings.extractive_min_span, F.when(F.coalesce(near, F.lit(False)), F.concat_ws(" ", first, following)).otherwise(first)))
    sim = F.when(alone, score.cast("double")).otherwise(F.col("_sim"))
    found = F.struct(T.span(F.col("_span"), settings.max_span_chars).alias("answer"), F.bround(F.least(F.lit(1.0), (score + sim) / 2), 4).alias("confidence"), F.bround(sim, 4).alias("span_similarity"))
    return rows.withColumn("_found", F.when(F.col("_span").isNotNull(), found)).drop("_sents", "_sims", "_at", "_sim", "_span")


def verbatim(hits: Column, settings: Settings = DEFAULT) -> Column:
    """The answer without a model: the first hit's passage as it stands, three citations."""
    first = F.get(hits, F.lit(0))
    text = F.coalesce(F.nullif(first["context"], F.lit("")), first["text"])
    return F.struct(F.substring(text, 1, settings.citation_chars).alias("answer"), F.lit(0.35).alias("confidence"), guards.citations(F.slice(hits, 1, 3), F.array().cast("array<int>"), settings).alias("citations"), F.lit("PROVIDER_UNAVAILABLE").alias("reason"))


#: What a model is asked after a reply that cannot be read.
REPAIR = "The reply above is no JSON object. Answer again with one JSON object that has answer, citations and confidence, and nothing else. The reply was:"


def asked(complete: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """Prompts -> replies of a model; null prompts are not given to it. Never evaluated twice for a row."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        out, due = pd.Series([None] * len(prompts), dtype=object), prompts.notna().to_numpy()
        if due.any():
            out[due] = list(complete(prompts[due].reset_index(drop=True)))
        return out

    return ask.asNondeterministic()


def route(questions: DataFrame, settings: Settings = DEFAULT, encoder: Encoder = encoded, complete: Callable[[pd.Series], pd.Series] | None = None, general: bool = True, similarity: Callable[[pd.Series, pd.Series], pd.Series] | None = None, relaxed: Settings | None = None) -> DataFrame:
    """questions (query_id, query, lang or null, query_vec, hits) -> one record each: answer, citations, confidence, path, lang, grounded, refused, reason, provider.

    The order is: input guard, relevance guard, extraction, generation, grounding; the record is one expression over columns
    that follow one another, so every row goes through once. complete: prompts -> replies of a model, run in batches on the
    rows that the steps before left open: one call a row, a second where its reply cannot be read, and one from general
    knowledge where the corpus has no answer and ``general`` allows it. Without a readable reply, or without a model, the best
    span by ``relaxed`` settings is given at 0.9 of its confidence, where these are given and find one, else the passage as
    it stands; what the corpus lacks is then refused. similarity: (answer, context) for answers that share too few words.
    """
    hits = F.coalesce(F.col("hits"), F.array().cast(dict(questions.dtypes)["hits"]))
    guarded = questions.withColumn("_in", guards.input_reason(F.col("query"), F.col("lang"), settings)).withColumn("lang", F.col("_in.lang"))
    scores = F.sort_array(F.transform(hits, lambda h: F.coalesce(h["dense_score"], F.lit(0.0))), asc=False)
    guarded = guarded.withColumn("_scores", scores)
    top, second = F.coalesce(F.get("_scores", F.lit(0)), F.lit(0.0)), F.get("_scores", F.lit(1))
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in settings.relevance_by_lang.items() for x in kv]), F.col("lang")), F.lit(settings.relevance_default))
    best = F.get(F.filter(hits, lambda h: F.coalesce(h["dense_score"], F.lit(0.0)) == top), F.lit(0))
    unfit = F.col("_in.reason").isNotNull()
    flat = F.coalesce((F.lit(settings.min_margin) > 0) & (top - second < settings.min_margin), F.lit(False))
    lacking = F.when(~unfit & ((F.size(hits) == 0) | (top < floor)), "OUT_OF_CORPUS").when(~unfit & flat, "LOW_CONFIDENCE")
    rows = guarded.withColumn("_lacking", lacking).withColumn("_best", best)
    rows = rows.withColumn("_score", F.when(~unfit & F.col("_lacking").isNull(), top).otherwise(-1.0))
    source = F.coalesce(F.nullif(F.col("_best.context"), F.lit("")), F.col("_best.text"))
    rows = extract(rows, source, F.col("query_vec"), F.col("_score"), settings, encoder)
    open_ = ~unfit & F.col("_lacking").isNull() & F.col("_found").isNull()
    if relaxed is not None:
        rows = rows.withColumnRenamed("_found", "_first").withColumn("_open_score", F.when(F.col("_first").isNull(), F.col("_score")).otherwise(-1.0))
        rows = extract(rows, source, F.col("query_vec"), F.col("_open_score"), relaxed, encoder).withColumnRenamed("_found", "_again").withColumnRenamed("_first", "_found")
    else:
        rows = rows.withColumn("_again", F.lit(None).cast(dict(rows.dtypes)["_found"]))
    empty = F.array().cast("array<int>")
    none = guards.citations(F.slice(hits, 1, 0), empty, settings)
    unread = F.lit(None).cast("struct<answer:string,citations:array<int>,confidence:double>")
    rows = rows.withColumn("contexts", F.transform(F.slice(hits, 1, 5), lambda h: F.coalesce(F.nullif(h["context"], F.lit("")), h["text"])))
    if complete is None:
        rows = rows.withColumn("_reply", unread).withColumn("_told", unread).withColumn("answer", F.lit(None).cast("string"))
    else:
        ask = asked(complete)
        question = F.concat(F.lit("Question: "), F.col("query"))
        lacks = F.col("_lacking").isNotNull() & F.lit(general)
        rows = rows.withColumn("_prompt", F.when(open_, T.prompt(F.col("query"), F.col("contexts"))).when(lacks, question))
        rows = rows.withColumn("_raw", ask(F.col("_prompt"))).withColumn("_reply", T.reply(F.col("_raw")))
        again = F.concat_ws("\n\n", F.col("_prompt"), F.lit(REPAIR), F.substring(F.coalesce("_raw", F.lit("")), 1, 500))
        rows = rows.withColumn("_raw", ask(F.when(open_ & F.col("_reply").isNull(), again)))
        rows = rows.withColumn("_reply", F.coalesce("_reply", T.reply(F.col("_raw"))))
        mute = open_ & F.col("_reply").isNotNull() & (T.stripped(F.col("_reply.answer")) == "")
        rows = rows.withColumn("_raw", ask(F.when(mute & F.lit(general), question)))
        rows = rows.withColumn("_told", F.when(lacks, F.col("_reply")).when(mute, T.reply(F.col("_raw"))))
        rows = rows.withColumn("answer", F.when(open_ & ~mute, guards.supported(F.col("_reply.answer"), F.col("contexts"), settings)["answer"]))
    rows = guards.judged(rows, settings, similarity)
    plain = verbatim(hits, settings)
    fallen, spoken = open_ & F.col("_reply").isNull(), open_ & F.col("answer").isNotNull()
    told = F.coalesce(T.stripped(F.col("_told.answer")) != "", F.lit(False))
    done, again = F.col("_found").isNotNull(), F.col("_again").isNotNull()
    failed = spoken & (F.col("reason") == "UNGROUNDED_OUTPUT")
    kind = F.when(unfit, "unfit").when(done, "extractive").when(told, "general").when(fallen & again, "again").when(fallen, "verbatim").when(failed, "failed").when(spoken, "generative").otherwise("lacking")
    rows = rows.withColumn("_kind", kind)
    is_ = lambda *names: F.col("_kind").isin(*names)
    refused = is_("unfit", "failed", "lacking")
    # a model that was asked for general knowledge and has none leaves the corpus as the reason
    lacks_reason = F.lit("OUT_OF_CORPUS") if complete is not None and general else F.coalesce("_lacking", F.lit("OUT_OF_CORPUS"))
    reason = F.when(is_("unfit"), F.col("_in.reason")).when(is_("failed"), F.lit("UNGROUNDED_OUTPUT")).when(is_("lacking"), lacks_reason).when(is_("again", "verbatim"), F.lit("PROVIDER_UNAVAILABLE")).when(is_("general"), F.lit("ANSWERED_FROM_GENERAL_KNOWLEDGE"))
    of_best = guards.citations(F.array("_best"), empty, settings)
    answer = F.when(refused, guards.message(reason, F.col("lang"))).when(is_("extractive"), F.col("_found.answer")).when(is_("again"), F.col("_again.answer")).when(is_("verbatim"), plain["answer"]).when(is_("general"), T.stripped(F.col("_told.answer"))).otherwise(F.col("answer"))
    cites = F.when(is_("extractive", "again"), of_best).when(is_("verbatim"), plain["citations"]).when(is_("generative", "failed"), guards.citations(hits, F.col("_reply.citations"), settings)).otherwise(none)
    confidence = F.when(refused, F.lit(0.0)).when(is_("extractive"), F.col("_found.confidence")).when(is_("again"), F.col("_again.confidence") * 0.9).when(is_("verbatim"), plain["confidence"]).when(is_("general"), F.least(F.col("_told.confidence"), F.lit(0.75))).otherwise(F.col("_reply.confidence"))
    path = F.when(refused, "refused").when(is_("extractive", "again", "verbatim"), "extractive").otherwise(F.col("_kind"))
    provider = F.when(is_("extractive"), "extractive").when(is_("again"), "extractive-fallback").when(is_("verbatim"), "passage-verbatim").when(is_("general", "generative"), "model")
    return rows.select("query_id", answer.alias("answer"), cites.alias("citations"), confidence.cast("double").alias("confidence"), path.alias("path"), "lang", (~refused & ~is_("general")).alias("grounded"), refused.alias("refused"), reason.cast("string").alias("reason"), provider.alias("provider"))


def cacheable(record: Column) -> Column:
    """What the cache keeps of a record."""
    return F.struct(record["answer"].alias("answer"), record["citations"].alias("citations"), record["confidence"].alias("confidence"), record["provider"].alias("provider"))
