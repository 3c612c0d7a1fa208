"""Registered queries over the driver's tables, and their DuckDB equivalents (in the modules beside this one)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.config import DEFAULT, Settings
from siftwell.functions import text as T
from siftwell.functions.vectors import encode, encoded
from siftwell.operators import answers, chunking, etl, evaluate, guards, index, retrieve
from siftwell.operators.joins import few, sized
from siftwell.plans import sql
from siftwell.sources import files
from siftwell.streaming import stateful

FUSED = Settings(sparse_weight=0.15)
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", T.normalized(F.col("text")).alias("norm")).filter(F.length("norm") >= DEFAULT.min_passage_chars)
    return rows.select("doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").cast("long").alias("chars"))


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return held.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return held.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def q_detect_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.detect_language(F.col("text")).alias("lang"))


def q_detect_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.detect_script(F.col("text")).alias("script"))


def q_span_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.span(F.col("text"), DEFAULT.max_span_chars).alias("span"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("doc_id").cast("string")
    return _docs(spark, sf_dir).select(ids.alias("passage_id"), ids.alias("doc_id"), "text", "lang", F.lit(-1).cast("long").alias("query_id"))


def _chunks(strategy: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = chunking.chunk(_passages(spark, sf_dir), strategy)
        return made.select("chunk_id", "passage_id", "lang", F.md5("text").alias("text_md5"), T.size_of(F.col("text")).cast("long").alias("size"), F.md5("context").alias("context_md5"))

    return query


def q_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.chunk_stats(chunking.chunk(_passages(spark, sf_dir), "sliding"), T.size_of(F.col("text")))


def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files.manifest(chunking.chunk(_passages(spark, sf_dir), "passage_native"), "passage_native", "hash-64", 64, "1970-01-01T00:00:00")
    return made.select("strategy", "passages", "chunks", "model", "dim", F.array_join("langs", ",").alias("langs"), F.array_join(F.transform(F.map_entries("per_lang"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("per_lang"), "built_at")


def q_hash_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = encode(_docs(spark, sf_dir), "doc_id", "text")
    return vecs.select("doc_id", F.posexplode("vec").alias("dim", "x")).filter("x <> 0").select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("x", 9).alias("x"))


def _index_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", "text")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("lang").filter("lang is not null").distinct()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question in every language that documents have: (item_id, query_id, lang, text)."""
    langs = _languages(spark, sf_dir).agg(F.collect_set("lang").alias("_langs")).first()[0]  # a few
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*[F.lit(x) for x in sorted(langs)]).cast("array<string>")).alias("lang"))
    return items.select("item_id", F.concat_ws(":", "item_id", "lang").alias("query_id"), "lang", "text")


def _of_hits(rows: DataFrame, hits: DataFrame, items: DataFrame, on: str = "id") -> DataFrame:
    """rows and the hits of their id, ten of an item at most: where items are few, hits go to the rows, which are not shuffled."""
    return rows.join(F.broadcast(hits) if few(items, 20_000) else hits, on)


def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.search(_items(spark, sf_dir).select(F.col("item_id").alias("query_id"), "lang", "text"), _index_docs(spark, sf_dir), DEFAULT.top_k).select("query_id", "lang", "id", "score", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("part"), F.col("embedding").alias("vec"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every vector whose id is divisible by 100."""
    return _vectors(spark, sf_dir).filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")


def q_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.dense(_asked(spark, sf_dir), _vectors(spark, sf_dir), DEFAULT.top_k)


def q_dense_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).withColumn("part", F.when(F.col("query_id") % 200 == 0, F.lit("unknown")))
    return retrieve.dense(asked, _vectors(spark, sf_dir), DEFAULT.top_k)


def q_dense_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).withColumn("part", F.when(F.col("query_id") % 200 == 0, F.lit("unknown")).otherwise(F.col("part")))
    return retrieve.dense_strict(asked, _vectors(spark, sf_dir), DEFAULT.top_k)


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse hits of the items among the documents of every language."""
    docs, items = _index_docs(spark, sf_dir), _items(spark, sf_dir)
    vecs = encode(table(spark, sf_dir, "benchmark"), "item_id", "text")
    asked = items.join(vecs, "item_id").select("query_id", F.col("lang").alias("part"), "vec")
    held = encode(docs.withColumn("key", F.struct("id", "lang")), "key", "text").select("key.id", F.col("key.lang").alias("part"), "vec")
    found = retrieve.dense(asked, held, DEFAULT.candidates, [r.lang for r in _languages(spark, sf_dir).collect()])
    return found, index.search(items.select("query_id", "lang", "text"), docs, DEFAULT.candidates).select("query_id", "id", "score", "rank")


def q_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.fuse(*_both(spark, sf_dir), DEFAULT.top_k, FUSED)


def q_best_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve.dense(_asked(spark, sf_dir), _vectors(spark, sf_dir), 100).withColumn("passage_id", F.floor(F.col("id") / 5))
    return retrieve.best_passages(hits)


def q_best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve.dense(_asked(spark, sf_dir), _vectors(spark, sf_dir), 10).withColumnRenamed("score", "dense_score")
    return retrieve.best_hit(hits.filter("id <> query_id")).select("query_id", "id", "dense_score", "rank")


def q_input_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("g", guards.input_reason(F.col("text")))
    return rows.select("conv_id", "turn", F.col("g.reason").alias("reason"), F.col("g.lang").alias("lang"), F.when(F.col("g.reason").isNotNull(), guards.message(F.col("g.reason"), F.col("g.lang"))).alias("message"))


def q_relevance_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hits = events.select(F.col("user_id").alias("query_id"), F.round(F.col("value") / (1 + F.abs("value")), 9).alias("dense_score"))
    lang = F.element_at(F.array(F.lit("en"), F.lit("hi"), F.lit("xx")), (F.col("query_id") % 3 + 1).cast("int"))
    queries = events.select(F.col("user_id").alias("query_id")).distinct().withColumn("lang", lang)
    found = guards.relevance(queries, hits, Settings(min_margin=0.0005), {"en": 0.995, "hi": 0.99})
    return found.withColumn("margin", F.round("margin", 9))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the one before it as its context."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("answer"), F.array("context").alias("contexts"))


def q_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.grounding(_replies(spark, sf_dir)).select("conv_id", "turn", "overlap", "escalated", "reason")


def q_citation_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir).withColumn("s", guards.supported(F.col("answer"), F.col("contexts")))
    return rows.select("conv_id", "turn", F.md5("s.answer").alias("answer_md5"), F.size("s.dropped").cast("long").alias("dropped"))


def q_answer_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items answered, in every language, by their best chunk where it supports them, refused otherwise."""
    passages = _passages(spark, sf_dir)
    texts = chunking.chunk(passages, "passage_native").select(F.col("chunk_id").alias("id"), "lang", "text")
    items = _items(spark, sf_dir).select("query_id", "lang", "text")
    top = index.search(items, texts, 1, keys=_index_docs(spark, sf_dir)).select("query_id", "id", "score")
    # only passages of which a chunk was found are cut once more
    of = passages.select("passage_id", "doc_id", "lang", "text", F.concat_ws(":", F.lit("passage_native"), "passage_id").alias("of"))
    found = chunking.chunk(_of_hits(of, top.withColumn("of", F.regexp_replace("id", ":[0-9]+$", "")), items, "of"), "passage_native")
    chosen = found.filter("chunk_id = id").select("query_id", "id", "score", F.col("text").alias("chunk"))
    joined = items.withColumnRenamed("text", "query").join(chosen, "query_id", "left")
    overlap = F.bround(T.overlap(F.col("query"), F.coalesce("chunk", F.lit(""))), 4)
    judged = joined.withColumn("overlap", overlap).withColumn("refused", F.col("overlap") < DEFAULT.min_overlap)
    reason = F.when(F.col("id").isNull(), "OUT_OF_CORPUS").when(F.col("refused"), "UNGROUNDED_OUTPUT")
    answer = F.when(reason.isNull(), F.substring("chunk", 1, DEFAULT.citation_chars)).otherwise(guards.message(reason, F.col("lang")))
    return judged.select("query_id", F.when(reason.isNull(), F.col("id")).alias("chunk_id"), "score", "overlap", F.when(reason.isNull(), "extractive").otherwise("refused").alias("path"), reason.alias("reason"), answer.alias("answer"))


def _routable(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select("query_id", "lang", F.col("text").alias("query"))
    found = retrieve.fuse(*_both(spark, sf_dir), 5, FUSED)
    text = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("l"))
    doc = F.col("id").cast("string")
    hit = F.struct("rank", F.concat_ws(":", F.lit("doc"), doc).alias("chunk_id"), doc.alias("passage_id"), "text", F.lit("").alias("context"), "dense_score", F.col("l").alias("lang"))
    hits = _of_hits(text, found, items).groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))  # five of each
    return items.join(hits, "query_id", "left").withColumn("query_vec", encoded(F.col("query")))


def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings(languages=("en", "de", "es", "fr"), relevance_by_lang={}, relevance_default=0.75, extractive_min_score=0.80, extractive_min_span=0.60)
    return answers.route(_routable(spark, sf_dir), settings).withColumn("citations", F.size("citations"))


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, lang, relevant): documents of the language that have a long sentence of an item."""
    said = lambda df, *ids: df.select(*ids, F.explode_outer(F.array_distinct(F.filter(T.sentences(F.col("text")), lambda s: F.length(s) >= 20))).alias("s")).filter("s is not null").select(*ids, F.md5("s").alias("s"))
    items = _items(spark, sf_dir)
    found = said(_docs(spark, sf_dir), "doc_id", "lang").join(sized(said(items, "query_id", "lang")), ["s", "lang"]).groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("relevant"))
    return items.select("query_id", "lang").join(found, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<bigint>")))


def q_scorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items all of whose relevant documents are long enough for the corpus."""
    corpus = _docs(spark, sf_dir).filter(F.length(T.normalized(F.col("text"))) >= DEFAULT.min_passage_chars).select(F.col("doc_id").alias("id"))
    return evaluate.scorable(_relevant(spark, sf_dir), corpus).select("query_id", F.size("relevant").cast("long").alias("relevant"))


def _by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, items = _relevant(spark, sf_dir).filter(F.size("relevant") > 0), _items(spark, sf_dir).select("query_id", "lang", "text")
    per = evaluate.by_query(asked, index.search(items, _index_docs(spark, sf_dir), 10))
    return per.join(items.select("query_id", "lang"), "query_id")


def q_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.averages(_by_item(spark, sf_dir))


def q_recall_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by language, with the best of each metric marked."""
    return evaluate.marked_best(evaluate.averages(_by_item(spark, sf_dir), ["lang"]), ["recall_at_5", "mrr"], "recall_at_5").drop("rank")


def q_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each item by how near their length is to the item's, where the language is English."""
    items = _items(spark, sf_dir).select("query_id", "lang", "text")
    hits = index.search(items, _index_docs(spark, sf_dir), 10)
    texts = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    full = _of_hits(texts, hits, items).join(items.select("query_id", F.col("text").alias("query")), "query_id")
    made = retrieve.rerank(full, lambda q, t: -(t.str.len() - q.str.len()).abs().astype(float), "en", 5)
    return made.select("query_id", "id", "rank", "rerank_score")


def q_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests."""
    made = table(spark, sf_dir, "conversations").withColumn("r", guards.request(F.col("text"), (F.col("conv_id") % 60).cast("int"), 200))
    return made.select("conv_id", "turn", F.md5("r.query").alias("query_md5"), F.col("r.top_k").cast("long").alias("top_k"), F.col("r.valid").alias("valid"))


def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of a turn as hits, of which some are named."""
    hit = lambda s, i: F.struct(F.concat_ws(":", "conv_id", "turn", i.cast("string")).alias("chunk_id"), F.concat_ws(":", "conv_id", "turn").alias("passage_id"), s.alias("text"), F.lit("").alias("context"), ((i + 1) / 7.0).alias("dense_score"), F.lit("en").alias("lang"))
    keep = F.array((F.col("conv_id") % 4).cast("int"), F.lit(2), F.lit(-1))
    made = table(spark, sf_dir, "conversations").withColumn("s", T.sentences(F.col("text"))).withColumn("c", guards.citations(F.transform("s", hit), keep))
    return made.select("conv_id", "turn", F.array_join(F.transform("c", lambda c: F.concat_ws("/", c["chunk_id"], F.md5(c["text"]), c["score"].cast("decimal(6,4)").cast("string"))), ",").alias("citations"))


def q_model_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model, fenced, bare, amid words and broken, made of the documents' ids and read again."""
    body = F.concat(F.lit('{"answer": "a'), "doc_id", F.lit('", "citations": [1, "-'), F.col("doc_id") % 9, F.lit('", "x"], "confidence": '), F.col("doc_id") % 3, F.lit(".25}"))
    kinds = F.array(body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Sure: "), body, F.lit(" done")), F.lit("{broken"))
    made = _docs(spark, sf_dir).select("doc_id", T.reply(F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))).alias("r"))
    return made.select("doc_id", F.col("r.answer").alias("answer"), F.array_join("r.citations", ",").alias("citations"), F.col("r.confidence").alias("confidence"))


def q_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every turn with the one before as its context, and the language of its speech code."""
    code = F.element_at(F.array(F.lit("hi-IN"), F.lit("en"), F.lit("")), (F.col("conv_id") % 3 + 1).cast("int"))
    return _replies(spark, sf_dir).select("conv_id", "turn", F.md5(T.prompt(F.col("answer"), F.col("contexts"))).alias("prompt_md5"), T.speech_language(code).alias("lang"))


def q_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answered requests, by kind."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), (F.col("value") * 4).alias("core_ms"), (F.col("event_id") % 5 == 0).alias("refused"))
    return evaluate.answered(rows, ["path"])


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: length in thousands of characters as the score of quality."""
    return _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", (F.col("n_chars") / 4096.0).alias("score"), (F.col("quality") == 1).alias("positive"))


def q_roc_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep(_scores(spark, sf_dir)).select("threshold", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "youden")])


def q_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = evaluate.sweep(_scores(spark, sf_dir), ["lang"])
    return evaluate.choose(curve, ["lang"]).select("lang", "threshold", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "youden")])


def q_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.separation(_scores(spark, sf_dir), "lang")


def q_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_scores(spark, sf_dir), ["positive"], (0.05, 0.5, 0.95))


def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events"), F.col("value"))


def q_latency_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events"), F.col("value"), ["event_type"])


def q_path_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.shares(table(spark, sf_dir, "events"), "event_type")


def q_stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("guard_input", "embed", "retrieve", "extract", "generate")])
    stage = F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))
    spans = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), stage.alias("stage"), F.round(F.col("value"), 4).alias("ms"))
    out = evaluate.stage_sums(spans)
    return out.select("request_id", F.array_join(F.map_keys("stages"), ",").alias("stages"), F.round("core_ms", 3).alias("core_ms"), F.round("total_ms", 3).alias("total_ms"), "within_budget")


def q_lang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.counts(_docs(spark, sf_dir))


def q_corpus_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", "lang", F.regexp_count("text", F.lit("\n")).alias("size"))
    n = 2000
    return etl.capped(rows, n, order=["doc_id"], size=F.col("size")).select("doc_id", "lang")


def q_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.stratified(_docs(spark, sf_dir).select("doc_id", "lang"), 100, order="doc_id")


def q_query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.sampled(table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("key")), 50, "13", "key").select("key", "position")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of a parallel corpus: lines are passages, every third is selected."""
    lines = F.split("text", "\n")
    chosen = F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x, i: F.when((i + F.col("doc_id")) % 3 == 0, 1).otherwise(0).cast("int"))
    line = F.get(lines, F.lit(0))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("ordinal"), (F.col("doc_id") % 700).alias("query_id"), line.alias("query"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(line).alias("Eng_Query"), line.alias("Answer"), line.alias("Eng_Answer"), F.struct(chosen.alias("is_selected"), lines.alias("English_passages"), lines.alias("Translated_passages")).alias("passages"), F.when(F.col("lang") == "en", "hi").otherwise(F.col("lang")).alias("target_lang"), F.lit("x").alias("query_type"))


def q_corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = etl.build(_raw(spark, sf_dir), F.col("ordinal") % 2 == 0, 300)
    return made.select("passage_id", "doc_id", "lang", "query_id", "is_selected", F.md5("text").alias("text_md5"))


def q_corpus_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, made = etl.build(_raw(spark, sf_dir), F.col("ordinal") % 2 == 0, 300)
    return made.select("query_id", "lang", F.md5("query").alias("query_md5"), F.array_join("relevant", ",").alias("relevant"))


def q_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    events = turns.select((F.col("conv_id") % 16).alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), encoded(F.col("text")).alias("vec"), T.detect_language(F.col("text")).alias("lang"), (F.col("conv_id") * 10.0).alias("at"))
    return stateful.cache_replay(events)


def q_breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", (F.col("event_id") % 3 == 0).alias("ok"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return stateful.breaker_replay(events.withColumn("at", F.col("at") / 1e6))


def queries() -> dict[str, Query]:
    named = {name: f for name, f in globals().items() if name.startswith("q_")}
    return named | {f"q_chunk_{s}": _chunks(s) for s in chunking.STRATEGIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
