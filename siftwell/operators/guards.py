"""Guards: is a question fit to be answered, are the hits good enough, is an answer supported."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.config import DEFAULT, Settings
from siftwell.functions import text as T

# Attempts to change the instructions, case ignored, anywhere in the text; classes are those of Unicode.
INJECTION = (
    r"ignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instruction|prompt|direction|rule)",
    r"disregard\s+(all\s+|the\s+)?(previous|prior|above|system)",
    r"forget\s+(everything|all|your)\s+(you|instruction|rule|prompt)",
    r"you\s+are\s+now\s+(a|an|no longer)",
    r"(reveal|show|print|repeat|output)\s+(me\s+)?(your|the)\s+(system\s+)?(prompt|instruction)",
    r"act\s+as\s+(if\s+you\s+are\s+)?(a|an)\s+\w+",
    r"\bDAN\b|\bjailbreak\b|developer\s+mode",
    r"pretend\s+(you|to\s+be)",
    r"new\s+(instruction|rule)s?\s*[:\-]",
    r"<\s*/?\s*(system|assistant|im_start|im_end)\s*>",
    r"निर्देश.*(अनदेखा|भूल)",
)
# Requests to refuse.
UNSAFE = (
    r"how\s+(do\s+i|to)\s+(make|build|synthesi[sz]e)\s+.*(bomb|explosive|nerve\s+agent|meth)",
    r"how\s+(do\s+i|to)\s+(kill|murder|poison)\s+(someone|a\s+person|my)",
    r"(child|minor)\s+(porn|sexual)",
    r"credit\s+card\s+(number|dump)s?\s+(list|for\s+sale)",
)
# Fixed value: what speech recognition makes of noise.
GARBAGE = r"(?iU)^[^\p{L}\p{N}]+$|^(uh|um|hmm|ah|er)[\s.,]*$"

REASONS = ("UNSAFE_INPUT", "PROMPT_INJECTION", "EMPTY_INPUT", "UNSUPPORTED_LANGUAGE", "OUT_OF_CORPUS", "LOW_CONFIDENCE", "UNGROUNDED_OUTPUT", "PROVIDER_UNAVAILABLE", "ANSWERED_FROM_GENERAL_KNOWLEDGE")
#: What a user is told: by reason, in each language.
MESSAGES = {
    "EMPTY_INPUT": {"en": "No question was understood. Please ask again.", "hi": "कोई प्रश्न समझ में नहीं आया। कृपया फिर पूछें।", "gu": "કોઈ પ્રશ્ન સમજાયો નહીં. કૃપા કરી ફરી પૂછો."},
    "UNSAFE_INPUT": {"en": "This request cannot be helped with.", "hi": "इस अनुरोध में सहायता संभव नहीं है।", "gu": "આ વિનંતીમાં મદદ શક્ય નથી."},
    "PROMPT_INJECTION": {"en": "Instructions cannot be changed by a question.", "hi": "प्रश्न से निर्देश नहीं बदले जा सकते।", "gu": "પ્રશ્નથી સૂચનાઓ બદલી શકાતી નથી."},
    "UNSUPPORTED_LANGUAGE": {"en": "English, Hindi and Gujarati are covered.", "hi": "अंग्रेज़ी, हिंदी और गुजराती उपलब्ध हैं।", "gu": "અંગ્રેજી, હિન્દી અને ગુજરાતી ઉપલબ્ધ છે."},
    "OUT_OF_CORPUS": {"en": "The indexed texts do not cover this.", "hi": "अनुक्रमित पाठों में यह नहीं है।", "gu": "અનુક્રમિત લખાણોમાં આ નથી."},
    "LOW_CONFIDENCE": {"en": "What was found is not close enough.", "hi": "जो मिला वह पर्याप्त निकट नहीं है।", "gu": "જે મળ્યું તે પૂરતું નજીક નથી."},
    "UNGROUNDED_OUTPUT": {"en": "The drafted answer could not be verified.", "hi": "तैयार उत्तर की पुष्टि नहीं हो सकी।", "gu": "તૈયાર જવાબની ચકાસણી થઈ શકી નહીં."},
    "ANSWERED_FROM_GENERAL_KNOWLEDGE": {"en": "Answered from general knowledge.", "hi": "सामान्य जानकारी से उत्तर।", "gu": "સામાન્ય જ્ઞાનથી જવાબ."},
    "PROVIDER_UNAVAILABLE": {"en": "No model was available; this is the passage.", "hi": "कोई मॉडल उपलब्ध नहीं; यह अंश है।", "gu": "કોઈ મોડેલ ઉપલબ્ધ નથી; આ ફકરો છે."},
}


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(f"(?iU){pattern}")
    return found


def input_reason(query: Column, lang: Column | None = None, settings: Settings = DEFAULT) -> Column:
    """(reason, lang): the first rule that a question breaks, null without; its language as given or detected."""
    text = T.stripped(F.coalesce(query, F.lit("")))
    resolved = T.detect_language(text) if lang is None else F.coalesce(lang, T.detect_language(text))
    empty = (F.length(text) < settings.min_query_chars) | text.rlike(GARBAGE) | (F.length(text) > settings.max_query_chars)
    reason = F.when(empty, "EMPTY_INPUT").when(any_of(text, UNSAFE), "UNSAFE_INPUT").when(any_of(text, INJECTION), "PROMPT_INJECTION").when(~resolved.isin(*settings.languages), "UNSUPPORTED_LANGUAGE")
    return F.struct(reason.alias("reason"), resolved.alias("lang"))


def message(reason: Column, lang: Column) -> Column:
    """The text of a refusal: an unknown reason reads as out of corpus, an unknown language as English."""
    table = F.create_map(*[F.lit(x) for r, by in MESSAGES.items() for lg, m in by.items() for x in (f"{r}/{lg}", m)])

    def at(r: Column, lg: Column) -> Column:
        return F.try_element_at(table, F.concat(r, F.lit("/"), lg))

    lang, reason = F.coalesce(lang, F.lit("en")), F.coalesce(reason, F.lit("OUT_OF_CORPUS"))
    return F.coalesce(at(reason, lang), at(reason, F.lit("en")), at(F.lit("OUT_OF_CORPUS"), lang), at(F.lit("OUT_OF_CORPUS"), F.lit("en")))


def request(query: Column, top_k: Column, most: int = 2000) -> Column:
    """(query, top_k, valid): stripped, and whether it is within the limits."""
    text = T.stripped(F.coalesce(query, F.lit("")))
    return F.struct(text.alias("query"), top_k.alias("top_k"), ((F.length(text) <= most) & (top_k.isNull() | top_k.between(1, 50))).alias("valid"))


def relevance(queries: DataFrame, hits: DataFrame, settings: Settings = DEFAULT, thresholds: dict[str, float] | None = None, spread: bool = False) -> DataFrame:
    """queries (query_id, lang) and hits (query_id, dense_score) -> (query_id, lang, top_score, margin, reason).

    OUT_OF_CORPUS without hits or below the language's floor; LOW_CONFIDENCE where the first is not min_margin above the
    second, or with spread above the mean of the next four. Only the five best scores of a query are kept.
    """
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("dense_score").desc()))
    five = hits.select("query_id", "dense_score").withColumn("_k", first).filter("_k <= 5")
    best = five.groupBy("query_id").agg(F.sort_array(F.collect_list("dense_score"), asc=False).alias("best"))
    floors = thresholds if thresholds is not None else settings.relevance_by_lang
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), F.col("lang")), F.lit(settings.relevance_default)) if floors else F.lit(settings.relevance_default)
    rest = F.slice("best", 2, 4)
    second = F.when(F.size(rest) > 0, F.aggregate(rest, F.lit(0.0), lambda s, x: s + x) / F.size(rest)) if spread else F.get("best", F.lit(1))
    judged = queries.join(best, "query_id", "left").withColumn("top_score", F.coalesce(F.get("best", F.lit(0)), F.lit(0.0))).withColumn("margin", F.when(F.size("best") >= 2, F.get("best", F.lit(0)) - second))
    reason = F.when(F.col("best").isNull() | (F.col("top_score") < floor), "OUT_OF_CORPUS").when((settings.min_margin > 0) & (F.col("margin") < settings.min_margin), "LOW_CONFIDENCE")
    return judged.select("query_id", "lang", "top_score", "margin", reason.alias("reason"))


def best_overlap(answer: Column, contexts: Column) -> Column:
    """The greatest overlap of an answer with any one context; 0 without contexts."""
    return T.bind(T.content_words(answer), lambda own: F.coalesce(F.array_max(F.transform(contexts, lambda c: T.shared(own, T.content_words(c)))), F.lit(0.0)))


def best_similarity(similarity: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """(answer, contexts) -> the greatest similarity(answer, context); null, and not asked for, where the answer is null."""

    @F.pandas_udf("double")
    def best(answers: pd.Series, contexts: pd.Series) -> pd.Series:
        pairs = [(i, a, c) for i, (a, cs) in enumerate(zip(answers, contexts, strict=True)) if a is not None and cs is not None for c in cs]
        out = pd.Series([None] * len(answers), dtype="float64")
        if pairs:
            rows, left, right = zip(*pairs, strict=True)
            found = pd.Series(list(similarity(pd.Series(left), pd.Series(right)))).groupby(list(rows)).max()
            out.loc[found.index] = found
        return out

    return best.asNondeterministic()


def judged(rows: DataFrame, settings: Settings = DEFAULT, similarity: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """As grounding(), with unrounded figures."""
    text, contexts = F.coalesce(F.col("answer"), F.lit("")), F.coalesce(F.col("contexts"), T.empty_strings())
    given = (T.stripped(text) != "") & (F.size(contexts) > 0)
    rows = rows.withColumn("overlap", F.when(given, best_overlap(text, contexts)).otherwise(0.0)).withColumn("escalated", given & (F.col("overlap") < settings.min_overlap))
    score = best_similarity(similarity)(F.when(F.col("escalated"), F.col("answer")), F.col("contexts")) if similarity else F.lit(None).cast("double")
    rows = rows.withColumn("similarity", score)
    failed = F.col("escalated") & ~(F.coalesce(F.col("similarity"), F.lit(-1.0)) >= settings.min_similarity)
    return rows.withColumn("reason", F.when(~given | failed, "UNGROUNDED_OUTPUT"))


def grounding(rows: DataFrame, settings: Settings = DEFAULT, similarity: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """rows (answer, contexts and more) with overlap, escalated, similarity and reason.

    Enough overlap with one context is support. Only rows that fail it are given to similarity(answer, context), and the
    best context counts; without that function they are refused.
    """
    return judged(rows, settings, similarity).withColumn("overlap", F.bround("overlap", 4)).withColumn("similarity", F.bround("similarity", 4))


def supported(answer: Column, contexts: Column, settings: Settings = DEFAULT) -> Column:
    """(answer, dropped): an answer without the sentences that no context supports, unless that leaves none."""

    def told(sents: Column, words: Column) -> Column:
        fits = lambda s: T.bind(T.content_words(s), lambda own: F.exists(words, lambda w: T.shared(own, w) >= settings.sentence_overlap))
        return F.transform(sents, lambda s: F.struct(s.alias("s"), fits(s).alias("fits")))

    def sorted_out(sents: Column) -> Column:
        kept = F.filter(sents, lambda s: s["fits"])
        whole = (F.size(sents) <= 1) | (F.size(kept) == 0)
        dropped = F.transform(F.filter(sents, lambda s: ~s["fits"]), lambda s: s["s"])
        return F.struct(F.when(whole, answer).otherwise(F.array_join(F.transform(kept, lambda s: s["s"]), " ")).alias("answer"), F.when(whole, T.empty_strings()).otherwise(dropped).alias("dropped"))

    return T.bind(F.transform(contexts, T.content_words), lambda words: T.bind(told(T.split_at(answer, T.SENTENCE_END_ANSWER), words), sorted_out))


def citations(hits: Column, keep: Column, settings: Settings = DEFAULT) -> Column:
    """Hits (array of chunk_id, passage_id, text, context, dense_score, lang) that keep names by number from 1; all if it names none."""
    named = F.transform(F.filter(F.coalesce(keep, F.array().cast("array<int>")), lambda k: (k >= 1) & (k <= F.size(hits))), lambda k: F.element_at(hits, k))
    chosen = F.when(F.size(named) > 0, named).otherwise(hits)
    shown = lambda h: F.coalesce(F.nullif(h["context"], F.lit("")), h["text"])
    return F.transform(chosen, lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["passage_id"].alias("passage_id"), F.substring(shown(h), 1, settings.citation_chars).alias("text"), F.bround(h["dense_score"], 4).alias("score"), h["lang"].alias("lang")))
