"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of a token, and sentence ends by script. White space is that of Unicode, hence (?U).
TOKEN = r"[\p{L}\p{N}_\x{0900}-\x{097F}\x{0A80}-\x{0AFF}]+"
SENTENCE_END = r"(?U)(?<=[।॥.!?])\s+|\n+"
SENTENCE_END_ANSWER = r"(?U)(?<=[।॥.!?])\s+"
SENTENCE_END_INDIC = r"(?U)(?<=[।॥])\s*|\n+"
SENTENCE_END_LATIN = r"(?U)(?<=[.!?])\s+|\n+"
SENTENCE_END_MIXED = r"(?U)(?<=[।॥])\s*|(?<=[.!?])\s+|\n+"
DEVANAGARI, GUJARATI = r"\x{0900}-\x{097F}", r"\x{0A80}-\x{0AFF}"

# Function words that say nothing about support.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "of", "to", "in", "and", "or", "for",
    "on", "it", "that", "this", "with", "as", "by", "at", "from", "be", "has", "have",
    "है", "हैं", "का", "की", "के", "में", "और", "से", "को", "यह", "एक", "पर",
    "છે", "નો", "ની", "ના", "માં", "અને", "થી", "ને", "આ", "એક", "પર",
)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once: what a lambda uses is otherwise evaluated again for each of its elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


#: White space of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACE))


def normalized(text: Column) -> Column:
    """White space collapsed to single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def split_at(text: Column, pattern: str) -> Column:
    """Non-blank parts between the pattern's matches, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), stripped), lambda s: s != "")


def sentences(text: Column) -> Column:
    return split_at(text, SENTENCE_END)


def letters(text: Column, block: str) -> Column:
    """How many letters of a block a text has."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[\p{{L}}&&[{block}]]"))


def detect_language(text: Column) -> Column:
    """hi, gu, en or other, by the script of most letters; ties in that order; en without letters."""
    counts = F.array(letters(text, DEVANAGARI), letters(text, GUJARATI), letters(text, r"\x{0000}-\x{024F}"), letters(text, r"\x{0000}-\x{10FFFF}"))

    def named(c: Column) -> Column:
        hi, gu, en = (F.get(c, F.lit(k)) for k in range(3))
        other = F.get(c, F.lit(3)) - hi - gu - en
        top = F.greatest(hi, gu, en, other)
        return F.when(top == 0, "en").when(hi == top, "hi").when(gu == top, "gu").when(en == top, "en").otherwise("other")

    return bind(counts, named)


def detect_script(text: Column, share: float = 0.75) -> Column:
    """Devanagari, Gujarati or Latin where it has that share of these letters, else Mixed; Unknown without any."""
    names = ("Devanagari", "Gujarati", "Latin")

    def named(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda s, x: s + x)
        out = F.when(total == 0, "Unknown")
        for k, name in enumerate(names):
            out = out.when(F.get(counts, F.lit(k)) / total >= share, name)
        return out.otherwise("Mixed")

    return bind(F.array(letters(text, DEVANAGARI), letters(text, GUJARATI), letters(text, r"\p{IsLatin}")), named)


def runs(text: Column, words: int) -> Column:
    """The default units of size are words with the space after them: a text in runs of so many."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?U)(?:\S++\s*+){{1,{words}}}"), F.lit(0))


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def content_words(text: Column) -> Column:
    """Distinct tokens of two letters or more that are not function words."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    return F.filter(F.array_except(tokens(text), stop), lambda t: F.length(t) > 1)


def shared(own: Column, words: Column) -> Column:
    """Share of own words that are among the words; 0 without any."""
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, words)) / F.size(own))


def overlap(answer: Column, context: Column) -> Column:
    """Share of the answer's content words that the context has; 0 without any."""
    return bind(content_words(answer), lambda own: shared(own, content_words(context)))


def span(text: Column, most: int) -> Column:
    """A text cut to most characters at a word's end, with an ellipsis where it was longer."""
    cut = F.substring(text, 1, most)
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("..."))).otherwise(text)


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def reply(raw: Column) -> Column:
    """A model's reply as (answer, citations, confidence): a fenced or bare JSON object, else the first braces in it; null if neither parses."""
    schema = "answer string, citations string, confidence double"
    bare = F.regexp_replace(stripped(raw), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)

    def parsed(text: Column) -> Column:
        return F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.from_json(text, schema))

    found = F.coalesce(parsed(bare), parsed(inner))
    return F.when(found.isNotNull(), F.struct(F.coalesce(found["answer"], F.lit("")).alias("answer"), cited(found["citations"]).alias("citations"), clamped(F.coalesce(found["confidence"], F.lit(0.5))).alias("confidence")))


def cited(raw: Column) -> Column:
    """Whole numbers of a JSON list or scalar."""
    items = F.transform(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\[\]\"\s]", ""), ","), lambda x: x)
    return F.transform(F.filter(items, lambda x: x.rlike(r"^-*\d+$")), lambda x: F.regexp_replace(x, "^-+", "-").cast("int"))


def prompt(question: Column, contexts: Column) -> Column:
    """Contexts, numbered from 1, and the question."""
    numbered = F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))
    return F.concat(F.array_join(numbered, "\n\n"), F.lit("\n\nQuestion: "), question)


def speech_language(code: Column) -> Column:
    """Language of a speech code: hi-IN is hi; null where empty."""
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit(None)).otherwise(F.element_at(F.split(code, "-"), 1))
