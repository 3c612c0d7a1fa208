import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.config import Settings
from siftwell.functions import text as T
from siftwell.functions.vectors import distances, dot, encode, encode_with, encoded
from siftwell.operators import chunking

HINDI = "भारत एक देश है। इसकी राजधानी दिल्ली है। यहाँ बहुत लोग रहते हैं।"
GUJARATI = "ગુજરાત ભારતનું રાજ્ય છે. તેની રાજધાની ગાંધીનગર છે."
ENGLISH = "Rivers carry water to the sea. They begin as springs. Some dry out in summer."


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "lang", "script"), [(ENGLISH, "en", "Latin"), (HINDI, "hi", "Devanagari"), (GUJARATI, "gu", "Gujarati"), ("यह मेरा computer science वाला", "en", "Mixed"), ("123 !?", "en", "Unknown"), ("これは何ですか", "other", "Unknown"), (None, "en", "Unknown")])
def test_language_and_script(spark, text, lang, script):
    assert one(spark, text, T.detect_language) == lang
    assert one(spark, text, T.detect_script) == script


def test_sentences_tokens_and_space(spark):
    assert one(spark, HINDI, T.sentences) == [s + "।" for s in HINDI.split("।")[:-1] for s in [s.strip()]]
    assert one(spark, "One. Two!\nThree\n\n", T.sentences) == ["One.", "Two!", "Three"]
    assert one(spark, None, T.sentences) == []
    assert one(spark, "Été, naïve_2 है।", T.tokens) == ["été", "naïve_2", "है।"]
    assert one(spark, " a \t\n b c ", T.normalized) == "a b c"
    assert one(spark, None, T.normalized) == ""


def test_overlap_and_span(spark):
    assert one(spark, "The river Danube", lambda x: T.overlap(x, F.lit("danube is a river"))) == 1.0
    assert one(spark, "is the of", lambda x: T.overlap(x, F.lit("anything"))) == 0.0
    assert one(spark, "word " * 100, lambda x: T.span(x, 20)) == "word word word word..."
    assert one(spark, "short", lambda x: T.span(x, 20)) == "short"


@pytest.mark.parametrize(("raw", "answer", "citations", "confidence"), [
    ('{"answer": "yes", "citations": [1, 2], "confidence": 0.5}', "yes", [1, 2], 0.5),
    ('```json\n{"answer": "yes", "citations": 3, "confidence": 5.0}\n```', "yes", [3], 1.0),
    ('Sure: {"answer": "no", "citations": ["2", "x"], "confidence": -2} bye', "no", [2], 0.0),
])
def test_replies(spark, raw, answer, citations, confidence):
    assert tuple(one(spark, raw, T.reply)) == (answer, citations, confidence)


@pytest.mark.parametrize("raw", ["no json here", "", None, "{broken"])
def test_replies_that_do_not_parse(spark, raw):
    assert one(spark, raw, T.reply) is None


def test_prompt_and_speech_language(spark):
    assert one(spark, "Why?", lambda x: T.prompt(x, F.array(F.lit("a"), F.lit("b")))) == "[1] a\n\n[2] b\n\nQuestion: Why?"
    assert [one(spark, x, T.speech_language) for x in ("hi-IN", "en", "", None)] == ["hi", "en", None, None]


def test_encoders_agree(spark):
    df = spark.createDataFrame([(1, ENGLISH), (2, "rivers")], "k long, t string")
    slow = {r.k: r.v for r in df.select("k", encoded(F.col("t")).alias("v")).collect()}
    fast = {r.k: r.vec for r in encode(df, "k", "t").collect()}
    assert slow[1] == pytest.approx(fast[1]) and slow[2] == pytest.approx(fast[2])
    assert one(spark, ENGLISH, lambda x: dot(encoded(x), encoded(x))) == pytest.approx(1)


PASSAGES = "passage_id string, doc_id string, text string, lang string"
LONG = " ".join(f"w{i}" for i in range(700))


@pytest.mark.parametrize("strategy", chunking.STRATEGIES)
def test_every_strategy_keeps_the_rules(spark, strategy):
    rows = [("e", "e", ENGLISH, "en"), ("h", "h", HINDI, "hi"), ("g", "g", GUJARATI, "gu"), ("l", "l", LONG + "word " * 900, "en"), ("b", "b", " \n ", "en"), ("n", "n", None, "en"), ("p", "p", f"{ENGLISH}\n\n{LONG}\n{HINDI}", "en")]
    out = chunking.chunk(spark.createDataFrame(rows, PASSAGES), strategy).collect()
    assert {r.passage_id for r in out} == {"e", "h", "g", "l", "p"}
    assert len({r.chunk_id for r in out}) == len(out)
    assert all(r.text.strip() == r.text != "" and len(r.text.split()) <= 512 for r in out)
    for p, _, text, _ in rows[:3]:  # no word is lost
        held = {w for r in out if r.passage_id == p for w in r.text.split()}
        assert held == set(text.split())


def test_parent_child_keeps_its_parent(spark):
    parent = " ".join(f"Sentence number {i} has exactly seven words." for i in range(20))
    out = chunking.chunk(spark.createDataFrame([("a", "a", parent, "en")], PASSAGES), "parent_child").collect()
    assert len(out) > 1 and all(r.context == parent and len(r.text) < len(parent) for r in out)


def test_script_is_recorded_and_unknown_names_are_refused(spark):
    df = spark.createDataFrame([("h", "h", HINDI, "hi")], PASSAGES)
    assert chunking.chunk(df, "indic_aware").first().meta == {"script": "Devanagari"}
    with pytest.raises(ValueError, match="no chunking strategy"):
        chunking.chunk(df, "nonsense")
    assert chunking.chunk(df, "mine", custom={"mine": lambda t: F.split(t, " ")}).count() == len(HINDI.split())


def packed(units, budget, overlap):
    """Greedy packing, told plainly."""
    done, open_ = [], []
    size = lambda us: sum(len(u.split()) for u in us)
    for unit in units:
        words = unit.split()
        if len(words) > budget:
            done += [" ".join(open_)] if open_ else []
            done += [" ".join(words[i : i + budget]) for i in range(0, len(words), budget)]
            open_ = []
            continue
        if open_ and size(open_) + len(words) > budget:
            done.append(" ".join(open_))
            open_ = next((open_[i:] for i in range(len(open_)) if size(open_[i:]) <= overlap), [])
        open_ = [*open_, unit]
        if size(open_) > budget + overlap:
            raise AssertionError
    return done + ([" ".join(open_)] if open_ else [])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 14), min_size=1, max_size=25), st.integers(5, 12), st.integers(0, 4))
def test_pack_is_greedy(spark, sizes, budget, overlap):
    units = [" ".join(f"u{i}_{k}" for k in range(n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(units,)], "u array<string>")
    assert df.select(chunking.pack(F.col("u"), budget, overlap).alias("c")).first().c == packed(units, budget, overlap)


def test_semantic_cuts_where_topics_change(spark):
    text = "Cats purr softly. Cats purr loudly. Cats purr often. Stocks fell today. Stocks fell sharply. Stocks fell again."
    out = [r.text for r in chunking.chunk(spark.createDataFrame([("a", "a", text, "en")], PASSAGES), "semantic").orderBy("chunk_id").collect()]
    assert out == [text[: text.index("Stocks") - 1], text[text.index("Stocks") :]]


def test_encoder_limit(spark):
    df = spark.createDataFrame([("a", "a", "word " * 4000, "en"), ("b", "b", "short", "en")], PASSAGES)
    out = chunking.chunk(df, "recursive", Settings(chunk_sizes={"recursive": (10_000, 0)})).collect()
    assert [r.text for r in out if r.passage_id == "b"] == ["short"]
    assert [len(r.text.split()) for r in out if r.passage_id == "a"] == [504] * 7 + [472]


def test_models_and_chunkers_from_outside(spark):
    df = spark.createDataFrame([("a", "a", "one two;three", "en"), ("n", "n", None, "en")], PASSAGES)

    def load():
        def model(texts):
            return [[float(len(t)), 0.0] if t != "passage: " else [0.0, 0.0] for t in texts]

        return model

    assert {r.passage_id: r.vec for r in encode_with(df, "passage_id", "text", "length", load).collect()} == {"a": [1.0, 0.0], "n": [0.0, 0.0]}
    out = chunking.chunk_with(df, "semicolon", lambda t: t.split(";")).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text) for r in out] == [("semicolon:a:0", "one two"), ("semicolon:a:1", "three")]


def test_semantic_encodes_in_batches_as_the_expression_does(spark):
    made = [" ".join(f"{w} {w if k % 3 else 'é ' + w} {k % 7}." for w in ("red", "blue", "...", "sky")) for k in range(300)]
    texts = ["", None, "One.", "Alpha beta. Alpha beta gamma! ... New\n\nÉté là. ΑΣ ΟΔΟΣ.\nΟΔΟΣ", " ".join(made), *made[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    text = F.coalesce("t", F.lit(""))
    fast, plain = (chunking.with_topic_runs(df, text, 128, 78.0, e) for e in (encoded, lambda s: encoded(s)))
    assert "ArrowEvalPython" in fast._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r._runs for r in fast.collect()} == {r.k: r._runs for r in plain.collect()}
    sents = df.select("k", T.sentences(text).alias("s"))
    apart = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: 1.0 - dot(encoded(F.get("s", i - 1)), encoded(F.get("s", i))))
    want = {r.k: r.d for r in sents.filter("size(s) > 1 and k <> 4").select("k", apart.alias("d")).collect()}
    assert want.items() <= {r.k: r.d for r in sents.select("k", distances(F.col("s")).alias("d")).collect()}.items()
