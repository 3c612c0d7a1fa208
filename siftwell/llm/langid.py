"""Language ID by Bayesian evidence fusion: text likelihoods, declared markup language, address suffix, host priors.

The posterior of a language is its prior on the host times the likelihoods of what the text, the markup and the address
say. Text: byte trigrams in a hash space, naive Bayes. The languages are all that the input names; each is fitted on a sample of
its texts (``TRAIN_ROWS`` and about ``TRAIN_CHARS`` of a language, in the order of a hash, one at least), so that neither a rare
language nor one of a few texts many times over is lost. As trigrams overlap and repeat, their evidence is discounted. Markup and address suffix: how often a
declaration or suffix goes with a language, from grouped counts over the whole input. Host: counts of languages on the host
shrunk to those on its domain, those to all; a row's own text is taken out of the counts that judge it.

Counts are combined before the shuffle; a host with a third of the rows is one row of counts. Rows and counts meet by
broadcast while there are few hosts, else by a shuffle of two staged tables, whose skewed keys Spark splits.

Defined cases: null or empty text, url or markup is no evidence; without any evidence the language is the likeliest of
all; rows are independent of repeats but for the counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, staged
from siftwell.llm.words import chunks

TRAIN_ROWS, TRAIN_CHARS = 1500, 6_000_000
SLOTS = 1 << 16
DISCOUNT, CAP = 0.3, 400.0
HOST_WEIGHT, DOMAIN_WEIGHT, EVIDENCE_WEIGHT = 5.0, 20.0, 2.0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32  # digits, punctuation and space say nothing


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all trigrams, and where each text's begin (one more entry than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]].astype(np.uint32)
    offsets = offsets - offsets[0]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    slots = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    good = code != 0x202020
    good[np.concatenate([offsets[1:-1] - 1, offsets[1:-1] - 2]).clip(0, len(good) - 1)] = False  # across two texts
    at = np.flatnonzero(good)
    return slots[at], np.searchsorted(at, offsets)


def fit(texts: DataFrame, key: Column | None = None) -> tuple[list[str], np.ndarray]:
    """(text, lang) rows -> languages in order, and log-likelihoods of the slots, slot x language. A bounded sample is used.

    key: tells rows of one text apart, so that copies are drawn one by one.
    """
    at = F.pmod(F.xxhash64(key if key is not None else F.lit(0), "text"), F.lit(1 << 40))
    rows = texts.filter("lang is not null and text is not null").select("text", "lang", at.alias("at"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"), F.min("at").alias("first")).collect()  # a row for each language
    if not sizes:
        return [], np.zeros((SLOTS, 0), np.float32)
    share = {r.lang: min(1.0, TRAIN_ROWS / r.n, TRAIN_CHARS / max(r["size"] or 0, 1)) for r in sizes}
    until = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, max(int((1 << 40) * share[r.lang]), r.first + 1))])
    drawn = rows.filter(F.col("at") < F.try_element_at(until, F.col("lang")))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).filter(F.col("k") <= TRAIN_ROWS)

    def counted(group: pa.Table) -> pa.Table:
        counts = np.zeros(SLOTS)
        for batch in group.select(["text"]).to_batches():
            for part in chunks(batch):
                counts += np.bincount(_trigrams(part.column("text"))[0], minlength=SLOTS)
        return pa.table({"lang": group["lang"][:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    made = drawn.select("lang", "text").groupBy("lang").applyInArrow(counted, "lang string, counts binary").collect()
    made = sorted(made, key=lambda r: r.lang)
    table = np.stack([np.frombuffer(r.counts) for r in made], axis=1)
    base = table.sum(axis=1) + 1
    base = base / base.sum()
    smooth = 500.0
    return [r.lang for r in made], np.log((table + smooth * base[:, None]) / (table.sum(axis=0) + smooth)).astype(np.float32)


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*+>", " ")


def declared(html: Column) -> Column:
    """Primary subtag of the language that a page's root element declares; empty without."""
    return F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\x22']?([a-z]{2,3})", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def identify(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """rows (key, text, declared, host), key of any type -> (key, lang, confidence, text_lang)."""
    n = len(languages)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                slots, first = _trigrams(part.column("text"))
                sums = np.zeros((part.num_rows, n))
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    for k in range(n):
                        sums[some, k] = np.add.reduceat(table[:, k][slots], first[some], dtype=float)
                size = np.diff(first)[:, None]
                sums *= DISCOUNT * np.minimum(1.0, CAP / np.maximum(size, 1))
                lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * n, sums.ravel())
                known = pa.array(np.where(size[:, 0] > 0, sums.argmax(axis=1), -1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("declared"), part.column("host"), lists, known], ["key", "declared", "host", "ll", "best"])

    key = dict(rows.dtypes)["key"]
    texts = rows.select("key", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("declared", F.lit("")).alias("declared"), F.coalesce("host", F.lit("")).alias("host"))
    if not n:
        return texts.select("key", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    found = texts.mapInArrow(likelihoods, f"key {key}, declared string, host string, ll array<double>, best int")
    found = found.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    found = staged(found, "likelihoods")
    votes = F.array(*[F.sum((F.col("best") == k).cast("double")) for k in range(n)])
    per_host = staged(found.groupBy("host", "domain", "suffix").agg(votes.alias("by_host")), "hosts")

    def up(name: str) -> DataFrame:
        return per_host.groupBy(F.col(name).alias(f"of_{name}")).agg(F.array(*[F.sum(F.col("by_host")[k]) for k in range(n)]).alias(f"by_{name}"))

    overall = per_host.agg(*[F.coalesce(F.sum(F.col("by_host")[k]), F.lit(0.0)) for k in range(n)]).first()
    hosts = per_host.join(bounded(up("domain")), F.col("domain") == F.col("of_domain")).join(bounded(up("suffix")), F.col("suffix") == F.col("of_suffix"))
    hosts = staged(hosts.select(F.col("host").alias("of_host"), "by_host", "by_domain", "by_suffix", F.array(*[F.lit(float(x)) for x in overall]).alias("by_all")), "host-counts")
    said = staged(found.groupBy(F.col("declared").alias("of_declared")).agg(votes.alias("by_declared")), "declared")
    both = found.join(bounded(hosts, 200_000), F.col("host") == F.col("of_host")).join(bounded(said, 10_000), F.col("declared") == F.col("of_declared"))

    def own(name: str, k: int) -> Column:
        """Count of language k without the row's own vote."""
        return F.col(name)[k] - (F.col("best") == k).cast("double")

    def posterior(k: int) -> Column:
        total = sum((own("by_all", j) for j in range(n)), F.lit(0.0))
        everywhere = (own("by_all", k) + 1.0) / (total + n)
        domain = (own("by_domain", k) + DOMAIN_WEIGHT * everywhere) / (sum((own("by_domain", j) for j in range(n)), F.lit(0.0)) + DOMAIN_WEIGHT)
        prior = (own("by_host", k) + HOST_WEIGHT * domain) / (sum((own("by_host", j) for j in range(n)), F.lit(0.0)) + HOST_WEIGHT)

        def evidence(name: str) -> Column:
            """P(what is said | language k) / P(what is said), smoothed to 1."""
            share = (sum((own(name, j) for j in range(n)), F.lit(0.0)) + 1e-9) / (total + 1e-9)
            return (own(name, k) + EVIDENCE_WEIGHT * share) / ((own("by_all", k) + EVIDENCE_WEIGHT) * share)

        markup = F.when(F.col("declared") == "", F.lit(1.0)).otherwise(evidence("by_declared"))
        address = F.when(F.col("suffix") == "", F.lit(1.0)).otherwise(evidence("by_suffix"))
        return F.when(F.col("host") == "", F.log(everywhere)).otherwise(F.log(prior)) + F.log(markup) + F.log(address) + F.col("ll")[k]

    scored = both.withColumn("log_p", F.array(*[F.struct(posterior(k).alias("p"), F.lit(-k).alias("k")) for k in range(n)])).withColumn("top", F.array_max("log_p"))
    names = F.array(*[F.lit(x) for x in languages])
    confidence = 1 / F.aggregate("log_p", F.lit(0.0), lambda a, x: a + F.exp(x["p"] - F.col("top.p")))
    return scored.select("key", F.element_at(names, 1 - F.col("top.k")).alias("lang"), confidence.alias("confidence"), F.when(F.col("best") >= 0, F.element_at(names, F.col("best") + 1)).alias("text_lang"))
