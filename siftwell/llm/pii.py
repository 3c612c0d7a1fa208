"""Personal data: fixed patterns for four kinds, and contextual bootstrapping for identifiers that no pattern knows.

Base spans come from regular expressions with checks (email, ip, card, phone). They are the seeds of a graph between
lexical patterns (the two words before an identifier) and instances (the identifiers). Instances that no base pattern knows
are tokens of five characters or more with three digits or an at sign, and groups of digits joined by spaces, hyphens and
brackets, 7 to 19 digits in all. Rounds of scoring go back and forth: a pattern is as sure of a kind as the weight of its
distinct instances of that kind among those of any kind, where an unknown instance speaks against it by ``DOUBT``; an instance
is as sure as its sure patterns together (noisy or). Instances above the threshold join the known ones for the next round,
and all their occurrences become spans. What base patterns found stays.

Everything is DataFrame functions. Texts are not shuffled: what leaves a document is its identifiers with their contexts.
Counts by pattern and instance are combined before each shuffle, so a context or identifier in a third of the documents
is one row a task.

Time in a text: a run of letters is entered at its start only, and repeats are possessive where nothing can be given back;
what the patterns match is the same. A text is cut once into blocks of ``BLOCK`` characters, from which contexts and what
stands between spans are read. Places of n matches are running sums over two levels of blocks, n^1.5 appends in all. So
100,000 matches in one text take seconds.

Defined cases: null is an empty text without spans; positions are code points, the end exclusive; an identifier without a
word before it has the context of the text's start, which is no pattern; a text that holds the marks U+0001 to U+0004 has
them treated as other characters; rows that repeat get the same spans; columns of the input named as those that are added
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import bind
from siftwell.llm.common import bounded, staged

KINDS = ("email", "ip", "card", "phone")
THRESHOLD, SUPPORT, ROUNDS, DOUBT = 0.8, 3, 3, 0.25
BLOCK = 256
_MARK, _FILL = "\u0001", "\u0004"
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_GROUPS = r"[(]?[0-9]++[)]?(?:[\x20-][(]?[0-9]++[)]?(?![0-9A-Za-z_%+@]))++"
_TOKEN = r"(?=[A-Za-z._%+-]*+[0-9@])[0-9A-Za-z._%+@-]++"
_IDENTIFIER = rf"(?<![0-9A-Za-z._%+@-]|{_FILL})(?:{_GROUPS}|{_TOKEN})(?!{_FILL})"
_CONTEXT = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D(\[\x22'=:#]*+$"
_REACH = 80
_FOUND = "array<struct<start:int,end:int,value:string>>"
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def running(values: Column, f: Callable[[Column, Column], Column], zero: int) -> Column:
    """Of whole numbers x, y, z: f(zero, x), f(f(zero, x), y), ...; f is associative. In blocks, and over the blocks' ends."""
    none = F.array().cast("array<int>")

    def along(part: Column, start: Column) -> Column:
        return F.aggregate(part, none, lambda s, x: F.array_append(s, f(F.coalesce(F.get(s, F.size(s) - 1), start), x)))

    def ended(parts: Column) -> Column:
        ends = along(F.transform(parts, lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.lit(zero))), F.lit(zero))
        return bind(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: bind(F.coalesce(F.get(e, k - 1), F.lit(zero)), lambda before: F.transform(p, lambda x: f(before, x))))))

    def over(v: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        return bind(F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), step), lambda i: along(F.slice(v, i, step), F.lit(zero))), ended)

    return bind(values, over)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of the text in blocks; empty where end is not beyond start."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    near = F.when(last == first, F.get(blocks, first)).otherwise(F.concat(F.get(blocks, first), F.get(blocks, last)))  # a slice copies the array
    joined = F.when(last - first <= 1, near).otherwise(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""))
    return F.when(end > start, F.substring(joined, start - first * BLOCK + 1, end - start)).otherwise("")


def _spliced(text: Column, spans: Column, filled: Callable[[Column, Column], Column]) -> Column:
    """text with its spans, in order of start, replaced by filled(span, where the spans before it end)."""

    def joined(blocks: Column, spans: Column, reach: Column, size: Column) -> Column:
        parts = F.transform(spans, lambda s, i: bind(F.coalesce(F.get(reach, i - 1), F.lit(0)), lambda before: F.concat(_cut(blocks, before, s["start"]), filled(s, before))))
        return F.concat(F.array_join(parts, ""), _cut(blocks, F.get(reach, F.size(reach) - 1), size))

    reach = lambda s: running(F.transform(s, lambda x: x["end"]), F.greatest, 0)
    return bind(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(bind(_blocks(text), lambda b: bind(reach(s), lambda r: bind(F.length(text), lambda n: joined(b, s, r, n))))))


def _matches(text: Column, pattern: str, may: Column) -> Column:
    """All matches of a pattern with their places; empty where ``may``, a cheaper condition that any match needs, is false."""
    pieces = F.split(F.regexp_replace(F.translate(text, "\u0001\u0002", "\u0003\u0003"), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    none = F.array().cast(_FOUND)

    def placed(p: Column) -> Column:
        places = running(F.transform(p, F.length), lambda a, b: a + b, 0)
        every = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
        return bind(places, lambda e: F.transform(every, lambda i: F.struct(F.get(e, i - 1).alias("start"), F.get(e, i).alias("end"), F.get(p, i).alias("value"))))

    return F.when(may, bind(pieces, lambda p: F.when(F.size(p) > 2, placed(p)).otherwise(none))).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0"))).try_cast("int"), F.lit(0)) <= 255))


def _found(text: Column) -> list[Column]:
    """Matches of each kind that pass its checks."""
    email = _matches(text, _EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(_matches(text, _IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda m: _octets(m["value"]))
    card = F.filter(_matches(text, _CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda m: F.length(_digits(m["value"])).between(12, 19))
    phone = F.filter(_matches(text, _PHONE, text.rlike(r"\+[0-9]")), lambda m: F.length(_digits(m["value"])).between(9, 15))
    return [email, ip, F.filter(card, lambda m: _luhn(m["value"])), phone]


def _base(text: Column) -> Column:
    """Base spans as (start, kind, end, value) in order of start, then kind."""

    def of_kind(k: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    return F.array_sort(F.concat(*[of_kind(k, found) for k, found in enumerate(_found(text))]))


def _read(docs: DataFrame) -> DataFrame:
    """docs as (row, id, text, found)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("found", _base(F.col("text")))


def _context(blocks: Column, start: Column) -> Column:
    before = _cut(blocks, F.greatest(start - _REACH, F.lit(0)), start)
    return F.lower(F.regexp_replace(F.regexp_extract(before, _CONTEXT, 1), r"[\x20\x09-\x0D]+", " "))


def _identifiers(text: Column, found: Column) -> Column:
    """Identifiers that no base span touches, as (start, end, value)."""
    masked = _spliced(text, found, lambda s, before: F.repeat(F.lit(_FILL), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], before))))
    named = bind(masked, lambda m: _matches(m, _IDENTIFIER, m.rlike("[0-9@]")))
    trimmed = F.transform(named, lambda m: F.struct(m["start"].alias("start"), F.rtrim(m["value"], F.lit("._%+@-")).alias("value")))

    def fit(value: Column) -> Column:
        digits = F.length(_digits(value))
        grouped = F.contains(value, F.lit(" ")) | F.contains(value, F.lit("("))
        token = (digits >= 3) | value.rlike("[A-Za-z0-9]@[A-Za-z0-9]")
        return F.when(F.length(value) > 100, F.lit(False)).when(grouped, digits.between(7, 19)).otherwise((F.length(value) >= 5) & token)

    return F.transform(F.filter(trimmed, lambda m: fit(m["value"])), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))


def occurrences(text: Column, found: Column) -> Column:
    """The base spans, and the other identifiers (kind null), each with value and context."""

    def seen(kind: Callable[[Column], Column], spans: Column, blocks: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), F.lower(s["value"]).alias("value"), _context(blocks, s["start"]).alias("context"), s["start"].alias("start"), s["end"].alias("end")))

    def both(known: Column, other: Column) -> Column:
        every = bind(_blocks(text), lambda b: F.concat(seen(lambda s: s["kind"], known, b), seen(lambda s: F.lit(None).cast("int"), other, b)))
        return F.when(F.size(known) + F.size(other) > 0, every)

    return bind(found, lambda known: bind(_identifiers(text, known), lambda other: both(known, other)))


def _told(found: DataFrame) -> tuple:
    return tuple(found.agg(F.count("*"), F.sum(F.xxhash64("known", "known_kind").cast("decimal(38,0)"))).first())


def learnt(seen: DataFrame, *, threshold: float = THRESHOLD, support: int = SUPPORT, rounds: int = ROUNDS, doubt: float = DOUBT) -> DataFrame:
    """(kind, value, context) occurrences -> (value, kind): identifiers that patterns induced from the seeds discover.

    At most so many rounds, and none after one that tells what the one before told.
    """
    links = staged(seen.groupBy("context", "value").agg(F.min("kind").alias("kind")), "pattern-links")
    seeds = links.filter("kind is not null").groupBy(F.col("value").alias("known")).agg(F.min("kind").alias("known_kind")).withColumn("sure", F.lit(1.0))
    patterned = links.filter("context <> ''")
    seeds = staged(seeds, "known")
    known, before = seeds, None
    found = None
    every = range(len(KINDS))
    for _ in range(rounds):
        told = patterned.join(bounded(known), F.col("value") == F.col("known"), "left")
        weights = [F.sum(F.when(F.col("known_kind") == k, F.col("sure")).otherwise(0.0)).alias(f"k{k}") for k in every]
        shares = told.groupBy("context").agg(F.count("*").alias("n"), *weights)
        best = F.array_max(F.array(*[F.struct(F.col(f"k{k}").alias("weight"), F.lit(-k).alias("kind")) for k in every]))
        known_weight = sum((F.col(f"k{k}") for k in every), F.lit(0.0))
        against = known_weight + doubt * (F.col("n") - known_weight) + 0.5
        patterns = shares.withColumn("best", best).select(F.col("context").alias("pattern"), (-F.col("best.kind")).alias("pattern_kind"), F.col("best.weight").alias("weight"), (F.col("best.weight") / against).alias("share"))
        patterns = staged(patterns.filter((F.col("weight") >= support) & (F.col("share") >= threshold)), "patterns")
        hits = patterned.filter("kind is null").join(bounded(patterns), F.col("context") == F.col("pattern"))
        scored = hits.groupBy("value", "pattern_kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("share"), F.lit(0.999)))))).alias("sure"))
        top = scored.groupBy("value").agg(F.max(F.struct("sure", (-F.col("pattern_kind")).alias("kind"))).alias("top")).filter(F.col("top.sure") >= threshold)
        found = staged(top.select(F.col("value").alias("known"), (-F.col("top.kind")).alias("known_kind"), F.col("top.sure").alias("sure")), "discovered")
        told_now = _told(found)
        if told_now == before or not told_now[0]:
            break
        before = told_now
        known = seeds.unionByName(found.join(bounded(seeds.select("known")), "known", "left_anti"))
    return found.select(F.col("known").alias("value"), F.col("known_kind").alias("kind"))


def _discovered(read: DataFrame, **options) -> DataFrame:
    """(key_id, key_hash, more): spans that bootstrapping adds to a document, the key being its id and a hash of its text."""
    held = read.select(F.col("id").alias("key_id"), F.xxhash64("id", "text").alias("key_hash"), occurrences(F.col("text"), F.col("found")).alias("seen"))
    seen = held.select("key_id", "key_hash", F.explode_outer("seen").alias("s"))  # without the text, which would be copied for each
    seen = staged(seen.filter("s is not null").select("key_id", "key_hash", "s.*"), "identifiers")
    new = learnt(seen.select("kind", "value", "context"), **options).select(F.col("value").alias("new_value"), F.col("kind").alias("new_kind"))
    hits = seen.filter("kind is null").join(bounded(new), F.col("value") == F.col("new_value"))
    return staged(hits.groupBy("key_id", "key_hash").agg(F.collect_set(F.struct("start", F.col("new_kind").alias("kind"), "end")).alias("more")), "discovered-spans")


def _spanned(docs: DataFrame, **options) -> DataFrame:
    """docs as (row, text, base, spans)."""
    read = _read(docs)
    more = _discovered(read, **options)
    none = F.array().cast(_SPANS)
    if more.take(1):
        read = read.join(bounded(more), F.col("id").eqNullSafe(F.col("key_id")) & (F.xxhash64("id", "text") == F.col("key_hash")), "left")
    else:
        read = read.withColumn("more", none)
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return read.select("row", "text", base.alias("base"), F.coalesce("more", none).alias("more")).select("row", "text", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """docs with ``_base`` and ``_spans``: base spans, and all spans, as (start, kind, end) in order of start, then kind."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("_base", "_spans")]
    return _spanned(docs, **options).select(*kept, F.col("base").alias("_base"), F.col("spans").alias("_spans"))


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; of overlapping spans the first names it. Null stays null."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def named(s: Column, before: Column) -> Column:
        return F.when(s["start"] >= before, F.element_at(names, s["kind"] + 1)).otherwise("")

    text = F.when(F.size("spans") > 0, _spliced(F.col("text"), F.col("spans"), named)).otherwise(F.col("row")["text"])
    return _spanned(docs, **options).select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
