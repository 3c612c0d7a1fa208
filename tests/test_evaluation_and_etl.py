import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.config import Settings
from siftwell.operators import etl, evaluate
from siftwell.sources import files
from siftwell.streaming import stateful


def test_recall_and_rank(spark):
    queries = spark.createDataFrame([(1, [10, 11]), (2, [20]), (3, [30])], "query_id long, relevant array<long>")
    hits = spark.createDataFrame([(1, 9, 1), (1, 10, 2), (1, 11, 6), (2, 20, 1)], "query_id long, id long, rank int")
    out = {r.query_id: r for r in evaluate.by_query(queries, hits).collect()}
    assert (out[1].recall_at_1, out[1].recall_at_5, out[1].recall_at_10, out[1].rr) == (0, 0.5, 1, 0.5)
    assert (out[3].recall_at_10, out[3].rr) == (0, 0)
    assert evaluate.averages(evaluate.by_query(queries, hits)).first().mrr == 0.5
    kept = evaluate.scorable(queries, spark.createDataFrame([(10,), (11,), (20,)], "id long"))
    assert {r.query_id for r in kept.collect()} == {1, 2}


def test_sweep_and_choice(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0.6, 0.2), True) for _ in range(80)] + [(rng.gauss(0.4, 0.2), False) for _ in range(60)]
    df = spark.createDataFrame(rows, "score double, positive boolean")
    curve = {r.threshold: r for r in evaluate.sweep(df).collect()}
    pos, neg = (np.array([s for s, p in rows if p is b]) for b in (True, False))
    assert set(curve) == set(np.unique(np.round(np.concatenate([pos, neg]), 3)).tolist())
    for t, r in curve.items():
        assert (r.tpr, r.fpr) == pytest.approx(((pos >= t).mean(), (neg >= t).mean()))
    ordered = sorted(curve)
    assert all(curve[a].tpr >= curve[b].tpr for a, b in zip(ordered, ordered[1:]))
    best = evaluate.choose(evaluate.sweep(df)).first()
    fit = [r for r in curve.values() if r.fpr <= 0.1]
    assert best.threshold == min(fit, key=lambda r: (-round(r.youden, 4), r.threshold)).threshold
    assert evaluate.choose(evaluate.sweep(df), settings=Settings(target_fpr=-1.0, min_tpr=2.0)).count() == 1


def test_support_pairs(spark):
    queries = spark.createDataFrame([(i, f"answer {i}", [f"p{i}"]) for i in range(30)] + [(99, "none", [])], "query_id long, answer string, relevant array<string>")
    passages = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(3000)], "passage_id string, text string")
    pairs = evaluate.support_pairs(queries, passages, "s").collect()
    gold = {r.query_id: r.text for r in pairs if r.positive}
    assert gold == {i: f"text {i}" for i in range(30)}
    assert len([r for r in pairs if not r.positive]) == 31


def test_latency_and_stages(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(11)], "path string, ms double")
    r = evaluate.latency(df, F.col("ms")).first()
    assert (r.n, r.mean, r.p50, r.p95, r.p100) == (11, 5, 5, 9.5, 10)
    assert evaluate.latency(df.limit(0), F.col("ms")).first().n == 0
    assert evaluate.shares(df, "path").first().share_pct == 100
    spans = spark.createDataFrame([(1, "embed", 150.0), (1, "embed", 60.0), (1, "generate", 900.0), (2, "cache", 1.0)], "request_id long, stage string, ms double")
    out = {r.request_id: r for r in evaluate.stage_sums(spans).collect()}
    assert (out[1].core_ms, out[1].total_ms, out[1].within_budget, out[1].stages["embed"]) == (210, 1110, False, 210) and out[2].within_budget
    best = evaluate.marked_best(spark.createDataFrame([("x", 0.5), ("y", 0.7)], "s string, r double"), ["r"], "r")
    assert [(r.s, r.best_r, r["rank"]) for r in best.orderBy("rank").collect()] == [("y", True, 1), ("x", False, 2)]


def raw_rows():
    rng = random.Random(4)
    out = []
    for i in range(60):
        n = rng.randint(0, 5)
        texts = [("long passage text " * 3 if rng.random() < 0.8 else "short") + str(i) for _ in range(n)]
        out.append((i, i % 25, f"q{i}" if i % 7 else "", f"e{i}" if i % 5 else "", "a", "b", ([int(rng.random() < 0.4) for _ in range(rng.randint(0, n))], texts, texts), ["hi", "gu"][i % 2], "t"))
    return out


def built(rows, cap):
    """The same, told as a loop."""
    made, seen, count = [], set(), {}
    for o, qid, q, eq, _, _, (sel, eng, tra), lang, _ in rows:
        if not any(sel):
            continue
        for lg, query, texts in ([("en", eq, eng)] if o % 2 == 0 else []) + [(lang, q, tra)]:
            if lg == "en":
                if qid in seen:
                    continue
                seen.add(qid)
            if not query or count.get(lg, 0) >= cap:
                continue
            kept = [(i, sel[i] if i < len(sel) else 0) for i, t in enumerate(texts) if len(t) >= 40]
            made += [(f"{lg}:{qid}:{i}", s) for i, s in kept]
            if any(s for _, s in kept):
                count[lg] = count.get(lg, 0) + len(kept)
    return made


@pytest.mark.parametrize("cap", [1, 9, 1000])
def test_corpus_build(spark, cap):
    rows = raw_rows()
    passages, queries = etl.build(spark.createDataFrame(rows, etl.RAW), F.col("ordinal") % 2 == 0, cap)
    assert sorted((r.passage_id, r.is_selected) for r in passages.collect()) == sorted(built(rows, cap))
    assert all(r.relevant for r in queries.collect())


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)], "ordinal long, lang string")
    assert {(r.lang, r["count"]) for r in etl.stratified(df, 10).groupBy("lang").count().collect()} == {("a", 5), ("b", 5)}
    assert etl.stratified(df, 1).count() == 2
    assert [r.ordinal for r in etl.sampled(df, 7, "s", "ordinal").collect()] == [r.ordinal for r in etl.sampled(df, 7, "s", "ordinal").collect()]
    again = [r.ordinal for r in etl.sampled(df, 10, "s", "ordinal", 0.3).collect()]
    assert len(again) == 10 and len(set(again)) == 7


def test_files_and_manifest(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"passage_id":"p","doc_id":"d","text":"t","lang":"en"}\n{"passage_id":"q","doc_id":"d","lang":"hi","query_id":3,"is_selected":1}\n')
    df = files.corpus(spark, str(tmp_path / "c.jsonl"))
    assert [(r.query_id, r.is_selected, r.text) for r in df.orderBy("ordinal").collect()] == [(-1, 0, "t"), (3, 1, "")]
    assert files.corpus(spark, str(tmp_path / "c.jsonl"), 1).count() == 1 and files.corpus(spark, str(tmp_path / "c.jsonl"), 0).count() == 2
    (tmp_path / "o.json").write_text('{"note": "n",\n "queries": [{"lang": "en", "query": "x"}, {"lang": "hi", "query": "y"}]}')
    assert files.outside_queries(spark, str(tmp_path / "o.json")).count() == 2
    chunks = spark.createDataFrame([("c1", "p", "d", "en", "t", "t", 1), ("c2", "q", "d", "hi", "t", "more", 1)], "chunk_id string, passage_id string, doc_id string, lang string, text string, context string, query_id long")
    assert {(r.lang, r.n) for r in files.write_chunks(chunks, str(tmp_path / "chunks")).collect()} == {("en", 1), ("hi", 1)}
    vectors = spark.createDataFrame([("c1", "en", [1.0])], "chunk_id string, lang string, vec array<float>")
    files.write_vectors(vectors, str(tmp_path / "vecs"))
    held = files.read_index(spark, str(tmp_path / "chunks"), str(tmp_path / "vecs")).collect()
    assert [(r.chunk_id, r.context) for r in held] == [("c1", "")]
    made = files.manifest(chunks, "fixed", "m", 1, "now")
    assert made.first().per_lang == {"en": 1, "hi": 1}
    assert {r.check: r.passed for r in files.verify(made, vectors, None, 0.5).collect()} == {"vectors match manifest": False, "postings present": False}
    full, none = chunks.select("chunk_id"), chunks.limit(0)
    assert [r.passed for r in files.verify(made, full, None, 0.0, vectors).collect()] == [True, True, False]
    assert [r.passed for r in files.verify(made, full, None, 0.0, none).collect()] == [True, True]
    files.write_json(chunks, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def axis(i, n=8):
    return [1.0 if k == i else 0.0 for k in range(n)]


def test_cache_rules(spark):
    rows = [("a", 1, axis(0), "en", 0.0), ("a", 2, axis(0), "en", 5.0), ("a", 3, axis(0), "hi", 6.0), ("a", 4, axis(1), "en", 7.0), ("a", 5, axis(1), "en", 5000.0), ("b", 6, axis(0), "en", 8.0)]
    df = spark.createDataFrame(rows, "key string, event_id long, vec array<double>, lang string, at double")
    out = {r.event_id: (r.outcome, r.matched) for r in stateful.cache_replay(df).collect()}
    assert out == {1: ("miss", None), 2: ("hit", 1), 3: ("other language", None), 4: ("miss", None), 5: ("expired", None), 6: ("miss", None)}
    small = stateful.cache_replay(spark.createDataFrame([("a", i, axis(i), "en", float(i)) for i in range(6)], df.schema), Settings(cache_entries=3))
    assert max(r.entries for r in small.collect()) == 3
    assert stateful.cache_stats(stateful.cache_replay(df)).first().hit_rate == round(1 / 6, 4)
    assert stateful.cache_stats(small.limit(0)).first().hit_rate == 0


def test_breaker_rules(spark):
    calls = [(0, False), (1, False), (2, False), (3, True), (40, False), (41, True), (80, True), (81, False)]
    df = spark.createDataFrame([("p", i, ok, float(t)) for i, (t, ok) in enumerate(calls)], "key string, event_id long, ok boolean, at double")
    out = [r.state for r in stateful.breaker_replay(df).orderBy("event_id").collect()]
    assert out == ["closed", "closed", "closed", "open", "half_open", "open", "half_open", "closed"]


def test_streams_equal_replays(spark, tmp_path):
    rng = random.Random(6)
    events = spark.createDataFrame([(f"k{i % 3}", i, rng.random() < 0.3, float(i * 7)) for i in range(90)], "key string, event_id long, ok boolean, at double")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = stateful.breaker_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("breaker_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("breaker_out").collect())) == sorted(map(tuple, stateful.breaker_replay(events).collect()))


def test_capped_ends_with_the_row_that_goes_over(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0, 0, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "ordinal long, lang string, n int").repartition(4)
    want, sums = [], {}
    for i, lang, n in rows:
        if sums.get(lang, 0) < 40:
            want.append(i)
            sums[lang] = sums.get(lang, 0) + n
    got = sorted(r.ordinal for r in etl.capped(df, 40, order=["ordinal"], size=F.col("n")).collect())
    assert got == want and etl.capped(df, 10**6, order=["ordinal"], size=F.col("n")).count() == 300


def test_sweep_counts_scores_at_the_thresholds_they_reach(spark):
    rng = random.Random(4)
    rows = [(rng.choice([k / 1000, k / 1000 + 0.0004, k / 1000 - 0.0004, 0.289, 1.001]), rng.random() < 0.5) for k in range(400)]
    got = {r.threshold: (r.tpr, r.fpr) for r in evaluate.sweep(spark.createDataFrame(rows, "score double, positive boolean")).collect()}
    assert set(got) == {round(x, 3) for x, _ in rows}
    for t, (tpr, fpr) in got.items():
        assert tpr == pytest.approx(np.mean([x >= t for x, p in rows if p])) and fpr == pytest.approx(np.mean([x >= t for x, p in rows if not p]))


def test_vector_store(spark, tmp_path):
    path, kind = str(tmp_path / "store"), "chunk_id string, doc_id string, lang string, vec array<float>"
    held = lambda *docs: sorted((r.chunk_id, r.doc_id, r.lang, r.vec) for r in files.stored_vectors(spark, path, *docs).collect())
    first = spark.createDataFrame([("c1", "d1", "en", [1.0]), ("c1", "d1", "01", [2.0]), ("c2", "d2", "en", [3.0])], kind)
    newer = spark.createDataFrame([("c2", "d3", "en", [4.0]), ("c3", "d1", "en", None), ("c3", "d1", "en", None)], kind)
    files.recreate_vectors(first, path)
    for _ in range(2):  # once more, as after a failure
        files.upsert_vectors(newer, path, 1)
    assert held() == [("c1", "d1", "01", [2.0]), ("c1", "d1", "en", [1.0]), ("c2", "d3", "en", [4.0]), ("c3", "d1", "en", None)]
    assert held(["d2"]) == [] and [r[0] for r in held(["d3"])] == ["c2"] and held([]) == []
    files.recreate_vectors(first.filter("lang = 'en' and chunk_id = 'c2'"), path)
    assert held() == [("c1", "d1", "01", [2.0]), ("c2", "d2", "en", [3.0])]
    files.upsert_vectors(first.limit(0), path, 2)
    assert len(held()) == 2


@pytest.mark.parametrize(("entries", "ttl"), [(1, 0), (3, 0), (40, 5), (17, 30)])
def test_cache_against_a_plain_list(entries, ttl):
    rng, settings = np.random.default_rng(entries), Settings(cache_entries=entries, cache_ttl_seconds=ttl)
    cache, plain, met = stateful.AnswerCache(settings), [], set()
    for i in range(300):
        vec, lang = np.eye(30)[rng.integers(30)], str(rng.choice(["en", "hi"]))
        like = [float(v @ vec) for v, *_ in plain]
        best = max(range(len(plain)), key=lambda k: (like[k], -k), default=None)
        wanted = ("miss", None, None)
        if best is not None and like[best] >= settings.cache_similarity:
            _, of, language, since = plain[best]
            wanted = ("expired", None, None) if i - since > ttl > 0 else ("other language", None, None) if language != lang else ("hit", of, round(like[best], 4))
            if wanted[0] == "expired":
                del plain[best]
        if wanted[0] != "hit":
            plain = (plain[1:] if len(plain) >= entries else plain) + [(vec, i, lang, i)]
        assert cache.ask(i, vec, lang, i) == wanted and len(cache.entries) == len(plain)
        met.add(wanted[0])
    assert {"hit", "miss"} <= met
    cache.clear()
    assert cache.ask(300, np.ones(3), "en", 300)[0] == "miss" and len(cache.entries) == 1
