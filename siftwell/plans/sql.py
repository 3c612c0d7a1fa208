"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from siftwell.functions.text import STOP_WORDS
from siftwell.operators.guards import INJECTION, MESSAGES, UNSAFE


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_\x{{0900}}-\x{{097F}}\x{{0A80}}-\x{{0AFF}}]+')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def parts(x: str, marks: list[tuple[str, str]]) -> str:
    """Split where the marks are replaced by a separator; stripped, none blank."""
    for pattern, kept in marks:
        x = f"regexp_replace({x}, '{pattern}', '{kept}' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({x}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


ANY_END, LINE, LATIN_END = (r"([।॥.!?])\s+", r"\1"), (r"\n+", ""), (r"([.!?])\s+", r"\1")


def sent(x: str) -> str:
    return parts(x, [ANY_END, LINE])


def size(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def pieces(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+\s*')"


def cut(x: str, n: int) -> str:
    """A text in windows of n units."""
    p = pieces(x)
    return f"case when len({p}) <= {n} then [{x}] else list_transform(range(0, len({p}), {n}), lambda i: {strip(f'array_to_string(list_slice({p}, i + 1, i + {n}), chr(32)[1:0])')}) end"


def limited(x: str) -> str:
    whole = f"list_filter(list_transform({x}, lambda s: {strip('s')}), lambda s: s <> '')"
    return f"flatten(list_transform({whole}, lambda q: case when length(q) <= 512 or {size('q')} <= 512 then [q] else {cut('q', 504)} end))"


def pack(units: str, budget: int, overlap: int) -> str:
    """Greedy packing as a fold over (text, size)."""
    empty = "[]::struct(u varchar, n bigint)[]"
    total = "coalesce(list_sum(list_transform({0}, lambda z: z.n)), 0)::bigint"
    joined = "list_append(a.done, array_to_string(list_transform(a.open, lambda z: z.u), ' '))"
    closed = f"case when len(a.open) > 0 then {joined} else a.done end"
    tail = f"list_filter(a.open, lambda w, i: {total.format('list_slice(a.open, i, len(a.open))')} <= {overlap})"
    step = (
        f"case when x.n > {budget} then {{'done': list_concat({closed}, {cut('x.u', budget)}), 'open': {empty}, 'n': 0::bigint}} "
        f"when a.n + x.n > {budget} and len(a.open) > 0 then {{'done': {closed}, 'open': list_append({tail}, x), 'n': ({total.format(tail)} + x.n)::bigint}} "
        f"else {{'done': a.done, 'open': list_append(a.open, x), 'n': (a.n + x.n)::bigint}} end"
    )
    sized = f"list_transform({units}, lambda u: {{'u': u, 'n': {size('u')}::bigint}})"
    folded = f"list_reduce({sized}, lambda a, x: {step}, {{'done': []::varchar[], 'open': {empty}, 'n': 0::bigint}})"
    return f"list_transform([{folded}], lambda a: {closed})[1]"


def chunks(strategy: str, expression: str, context: str = "part") -> str:
    return f"""
    with made as (select doc_id::varchar as passage_id, lang, text, {limited(expression)} as parts from documents),
    rows as (select passage_id, lang, text, unnest(parts) as part, unnest(range(len(parts))) as i from made)
    select '{strategy}:' || passage_id || ':' || i as chunk_id, passage_id, lang, md5(part) as text_md5, {size('part')}::bigint as size, md5({context}) as context_md5 from rows"""


SLIDING = f"case when len({pieces('text')}) <= 64 then [text] else list_transform(range(0, (ceil((len({pieces('text')}) - 64) / 48.0) * 48)::bigint + 1, 48), lambda i: {strip(f'array_to_string(list_slice({pieces('text')}, i + 1, i + 64), chr(32)[1:0])')}) end"


def _descended() -> str:
    def split_large(arr: str, by: str) -> str:
        return f"flatten(list_transform({arr}, lambda q: case when {size('q')} <= 96 then [q] else {by} end))"

    arr = f"list_filter([{strip('text')}], lambda s: s <> '')"
    for by in (parts("q", [(r"\n\n", "")]), parts("q", [(r"\n", "")]), sent("q"), cut("q", 96)):
        arr = split_large(arr, by)
    return arr


LETTERS = r"regexp_replace({0}, '[^\p{{L}}]', '', 'g')"


def letters(x: str, block: str) -> str:
    return f"length(regexp_replace({LETTERS.format(x)}, '[^{block}]', '', 'g'))"


def lang_of(x: str) -> str:
    hi, gu, en, every = letters(x, r"\x{0900}-\x{097F}"), letters(x, r"\x{0A80}-\x{0AFF}"), letters(x, r"\x{0000}-\x{024F}"), f"length({LETTERS.format(x)})"
    return f"(select case when greatest(h, g, e, o) = 0 then 'en' when h = greatest(h, g, e, o) then 'hi' when g = greatest(h, g, e, o) then 'gu' when e = greatest(h, g, e, o) then 'en' else 'other' end from (select {hi} as h, {gu} as g, {en} as e, {every} - {hi} - {gu} - {en} as o))"


STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


def content(x: str) -> str:
    return f"list_filter(list_distinct({tok(x)}), lambda t: length(t) > 1 and not list_contains([{STOP}], t))"


def overlap(a: str, c: str) -> str:
    return f"case when len({content(a)}) = 0 then 0.0::double else len(list_intersect({content(a)}, {content(c)}))::double / len({content(a)}) end"


def _quoted(patterns: tuple[str, ...]) -> str:
    return " or ".join(f"regexp_matches(q, '(?i){p}')" for p in patterns)


def _message(reason: str, lang: str) -> str:
    arms = " ".join(f"when {reason} = '{r}' and {lang} = '{lg}' then '{m}'" for r, by in MESSAGES.items() for lg, m in by.items())
    english = " ".join(f"when {reason} = '{r}' then '{by['en']}'" for r, by in MESSAGES.items())
    return f"case {arms} {english} end"


def bm25(queries: str, docs: str, limit: int) -> str:
    """queries: (query_id, lang, text); docs: (id, lang, text). CTE hits (query_id, lang, id, score, rank)."""
    return f"""
    held as (select id, lang, {tok('text')} as terms from ({docs})),
    stats as (select lang, count(*) as n, avg(len(terms)) as avgdl from held group by lang),
    df as (select lang, term, count(*) as df from (select lang, unnest(list_distinct(terms)) as term from held) group by all),
    raw as (select lang, term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df join stats using (lang)),
    idf as (select lang, term, case when raw < 0 then 0.25 * (avg(raw) over (partition by lang)) else raw end as idf from raw),
    asked as (select query_id, lang, term, count(*) as times from (select query_id, lang, unnest({tok('text')}) as term from ({queries})) group by all),
    postings as (select lang, id, term, dl, count(*) as tf from (select lang, id, len(terms) as dl, unnest(terms) as term from held) group by all),
    scored as (select query_id, lang, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
      from asked join postings using (lang, term) join idf using (lang, term) join stats using (lang) group by query_id, lang, id),
    hits as (select * from (select *, row_number() over (partition by query_id, lang order by score desc, id) as rank from scored) where rank <= {limit} and score > 0)"""


def encode(docs: str, key: str) -> str:
    """(key, vec) of hashed counts at unit length."""
    return f"""(select {key}, list_transform(counts, lambda c: c / norm) as vec from (select {key}, counts, sqrt(list_sum(list_transform(counts, lambda c: c * c))) as norm from (
      select {key}, list_transform(range(0, 64), lambda k: len(list_filter(b, lambda y: y = k))::double) as counts from (
      select {key}, list_transform({tok('text')}, lambda t: ('0x' || substr(md5(t), 1, 8))::bigint % 64) as b from ({docs})))) where norm > 0)"""


def dense(asked: str, vectors: str, condition: str, limit: int) -> str:
    return f"""select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from (
      select q.query_id, v.id, round(list_inner_product(q.vec::double[], v.vec::double[]), 9) as score from ({asked}) q join ({vectors}) v on {condition})) where rank <= {limit}"""


VECTORS = "select vec_id as id, label::varchar as part, embedding as vec from embeddings"
ASKED = "select vec_id as query_id, label::varchar as part, embedding as vec from embeddings where vec_id % 100 = 0"
LANG_DOCS = "select doc_id as id, lang, text from documents"
LANG_ITEMS = "select item_id || ':' || lang as query_id, lang, text from benchmark cross join (select distinct lang from documents where lang is not null)"
RRF = f"""
    dense_hits as ({dense(f"select query_id, lang, vec from ({LANG_ITEMS}) join {encode('select item_id, text from benchmark', 'item_id')} on query_id = item_id || ':' || lang", f"select id, lang, vec from {encode(LANG_DOCS, 'id')} join ({LANG_DOCS}) using (id)", 'q.lang = v.lang', 40)}),
    fused as (select query_id, id, round(sum(share), 9) as rrf, max(dense_score) as dense_score, string_agg(tag, ',' order by tag) as sources from (
      select query_id, id, 1.0::double / (60 + rank) as share, score as dense_score, 'dense' as tag from dense_hits
      union all select query_id, id, 0.15::double / (60 + rank), 0.0, 'sparse' from hits) group by query_id, id)"""
SCORES = "select doc_id, lang, n_chars / 4096.0::double as score, quality = 1 as positive from documents join labels using (doc_id)"
REPLIES = "select t.conv_id, t.turn, t.text as answer, b.text as context from turns t join turns b on t.conv_id = b.conv_id and t.turn = b.turn + 1"
TURNS = "turns as (select conv_id, turn, min(text) as text from conversations group by all)"
LINES = f"list_distinct(list_filter({sent('text')}, lambda s: length(s) >= 20))"
RELEVANT = f"""
    doc_lines as (select doc_id, lang, unnest({LINES}) as line from documents),
    item_lines as (select query_id, lang, unnest({LINES}) as line from ({LANG_ITEMS})),
    relevant as (select query_id, lang, doc_id from item_lines join doc_lines using (line, lang) group by all)"""
PER_ITEM = f"""{bm25(LANG_ITEMS, LANG_DOCS, 10)}, {RELEVANT},
      per as (select r.query_id, r.lang, count(*) as n, count(h.rank) filter (where h.rank <= 1) as n1, count(h.rank) filter (where h.rank <= 5) as n5, count(h.rank) as n10, min(h.rank) as first
        from relevant r left join hits h on h.query_id = r.query_id and h.id = r.doc_id group by r.query_id, r.lang)"""
RECALL = "count(*) as n, round(avg(n1 / n), 6) as recall_at_1, round(avg(n5 / n), 6) as recall_at_5, round(avg(n10 / n), 6) as recall_at_10, round(avg(coalesce(1.0 / first, 0)), 6) as mrr"
SWEEP = """
    marks as (select distinct {by} round(score, 3) as threshold from scores),
    curve as (select {by} threshold, avg(case when score >= threshold then 1.0 else 0.0 end) filter (where positive) as tpr,
      avg(case when score >= threshold then 1.0 else 0.0 end) filter (where not positive) as fpr from marks join scores {using} group by all)"""
NORM = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"


def latency(by: str) -> str:
    group = f"group by {by}" if by else ""
    cols = ", ".join(f"round(quantile_cont(value, {p}), 2) as p{int(p * 100)}" for p in (0.5, 0.7, 0.9, 0.95, 0.99, 1.0))
    return f"select {by + ', ' if by else ''}count(value) as n, round(avg(value), 2) as mean, {cols} from events {group}"


CORPUS = f"""
    raw as (select doc_id as ordinal, doc_id % 700 as query_id, string_split(text, chr(10)) as lines, lang, doc_id from documents),
    shaped as (select *, list_transform(range(0, greatest(len(lines) - 1, 1)), lambda i: case when (i + doc_id) % 3 = 0 then 1 else 0 end) as sel from raw),
    chosen as (select * from shaped where list_contains(list_slice(sel, 1, len(lines)), 1)),
    sides as (
      select ordinal, 0 as side, query_id, {NORM.format('case when doc_id % 11 = 0 then chr(32) else lines[1] end')} as query, lines, sel, 'en' as lang from chosen where ordinal % 2 = 0
      union all select ordinal, 1, query_id, {NORM.format('lines[1]')}, lines, sel, case when lang = 'en' then 'hi' else lang end from chosen),
    firsts as (select * from (select *, case when lang = 'en' then row_number() over (partition by lang, query_id order by ordinal, side) else 1 end as r from sides) where r = 1 and query <> ''),
    listed as (select *, list_filter(list_transform(range(0, len(lines)), lambda i: {{'text': {NORM.format('lines[i + 1]')}, 'i': i, 's': coalesce(sel[i + 1], 0)}}), lambda p: length(p.text) >= 40) as kept from firsts),
    marked as (select *, len(list_filter(kept, lambda p: p.s <> 0)) > 0 as positive from listed),
    capped as (select * from (select *, coalesce(sum(case when positive then len(kept) else 0 end) over (partition by lang order by ordinal, side rows between unbounded preceding and 1 preceding), 0) as before from marked) where before < 300)"""

ORACLES = {
    "q_normalize": f"select doc_id, md5(norm) as norm_md5, length(norm)::bigint as chars from (select doc_id, {NORM.format('text')} as norm from documents) where length(norm) >= 40",
    "q_tokens": f"select doc_id, len(t)::bigint as tokens, len(list_distinct(t))::bigint as distinct_tokens, md5(array_to_string(t, '|')) as tokens_md5 from (select doc_id, {tok('text')} as t from documents)",
    "q_sentences": f"select doc_id, len(s)::bigint as sentences, md5(array_to_string(s, '|')) as sentences_md5 from (select doc_id, {sent('text')} as s from documents)",
    "q_detect_lang": f"select conv_id, turn, {lang_of('text')} as lang from conversations",
    "q_detect_script": rf"""select doc_id, case when d + g + l = 0 then 'Unknown' when d >= 0.75 * (d + g + l) then 'Devanagari' when g >= 0.75 * (d + g + l) then 'Gujarati' when l >= 0.75 * (d + g + l) then 'Latin' else 'Mixed' end as script
      from (select doc_id, {letters('text', r'\x{0900}-\x{097F}')} as d, {letters('text', r'\x{0A80}-\x{0AFF}')} as g, {letters('text', r'\p{Latin}')} as l from documents)""",
    "q_span_trim": "select doc_id, case when length(text) > 400 then regexp_replace(substr(text, 1, 400), ' [^ ]*$', '') || '...' else text end as span from documents",
    "q_chunk_fixed": chunks("fixed", cut("text", 64)),
    "q_chunk_sliding": chunks("sliding", SLIDING),
    "q_chunk_passage_native": chunks("passage_native", cut("text", 512)),
    "q_chunk_parent_child": chunks("parent_child", f"case when len({sent('text')}) = 0 then [text] else {pack(sent('text'), 48, 12)} end", strip("text")),
    "q_chunk_indic_aware": chunks("indic_aware", pack(f"case when len({parts('text', [LATIN_END, LINE])}) = 0 then [text] else {parts('text', [LATIN_END, LINE])} end", 96, 24)),
    "q_chunk_recursive": chunks("recursive", pack(_descended(), 96, 24)),
    "q_chunk_stats": f"""with c as ({chunks('sliding', SLIDING)})
      select (select count(*) from c) as chunks, (select count(distinct passage_id) from c) as passages, round(avg(size), 6) as mean_size, round(quantile_cont(size, 0.95), 6) as p95_size,
        round((select count(*) from c) / (select count(distinct passage_id) from c), 6) as chunks_per_passage from (select size from c order by chunk_id limit 4000)""",
    "q_manifest": f"""with c as ({chunks('passage_native', cut('text', 512))}), by_lang as (select lang, count(*) as n from c group by lang)
      select 'passage_native' as strategy, (select count(distinct passage_id) from c) as passages, sum(n)::bigint as chunks, 'hash-64' as model, 64 as dim, string_agg(lang, ',' order by lang) as langs,
        string_agg(lang || '=' || n, ',' order by lang) as per_lang, '1970-01-01T00:00:00' as built_at from by_lang""",
    "q_hash_encode": f"select doc_id, dim, round(x, 9) as x from (select doc_id, unnest(range(0, 64)) as dim, unnest(vec) as x from {encode('select doc_id, text from documents', 'doc_id')}) where x <> 0",
    "q_bm25_topk": f"with {bm25('select item_id as query_id, lang, text from benchmark cross join (select distinct lang from documents)', 'select doc_id as id, lang, text from documents', 10)} select query_id, lang, id, score, rank from hits",
    "q_dense_topk": dense(ASKED, VECTORS, "q.part = v.part", 10),
    "q_dense_all_parts": dense(ASKED, VECTORS, "true", 10),
    "q_dense_strict": dense(f"select query_id, case when query_id % 200 = 0 then 'unknown' else part end as part, vec from ({ASKED})", VECTORS, "q.part = v.part", 10),
    "q_rrf": f"with {bm25(LANG_ITEMS, LANG_DOCS, 40)}, {RRF} select * from (select *, row_number() over (partition by query_id order by rrf desc, id) as rank from fused) where rank <= 10",
    "q_best_passages": f"""select * from (select query_id, passage_id, best, row_number() over (partition by query_id order by best, passage_id) as rank from (
      select query_id, floor(id / 5)::bigint as passage_id, min(rank) as best from ({dense(ASKED, VECTORS, "q.part = v.part", 100)}) group by all)) where rank <= 10""",
    "q_best_hit": f"""select query_id, id, score as dense_score, rank from (select *, row_number() over (partition by query_id order by score desc, rank) as r from ({dense(ASKED, VECTORS, "q.part = v.part", 10)}) where id <> query_id) where r = 1""",
    "q_input_guard": f"""with given as (select conv_id, turn, {strip("coalesce(text, '')")} as q from conversations), judged as (
      select conv_id, turn, {lang_of('q')} as lang, case when length(q) < 3 or regexp_matches(q, '(?i)^[^\\p{{L}}\\p{{N}}]+$|^(uh|um|hmm|ah|er)[\\s.,]*$') or length(q) > 512 then 'EMPTY_INPUT'
        when {_quoted(UNSAFE)} then 'UNSAFE_INPUT' when {_quoted(INJECTION)} then 'PROMPT_INJECTION' end as r from given),
      named as (select conv_id, turn, lang, coalesce(r, case when lang not in ('en', 'hi', 'gu') then 'UNSUPPORTED_LANGUAGE' end) as reason from judged)
      select conv_id, turn, reason, lang, case when reason is not null then {_message('reason', 'lang')} end as message from named""",
    "q_relevance_guard": """with s as (select user_id as query_id, round(value / (1 + abs(value)), 9) as x from events), r as (select *, row_number() over (partition by query_id order by x desc) as k from s),
      t as (select query_id, case query_id % 3 when 0 then 'en' when 1 then 'hi' else 'xx' end as lang, max(x) as top_score, round(max(x) - max(x) filter (where k = 2), 9) as margin from r group by query_id)
      select query_id, lang, top_score, margin, case when top_score < case lang when 'en' then 0.995 when 'hi' then 0.99 else 0.884 end then 'OUT_OF_CORPUS' when margin < 0.0005 then 'LOW_CONFIDENCE' end as reason from t""",
    "q_grounding": f"""with {TURNS}, r as ({REPLIES}), o as (select conv_id, turn, case when {strip('answer')} = '' then 0 else {overlap('answer', 'context')} end as x, {strip('answer')} <> '' as given from r)
      select conv_id, turn, round_even(x, 4) as overlap, given and x < 0.231 as escalated, case when not given or x < 0.231 then 'UNGROUNDED_OUTPUT' end as reason from o""",
    "q_citation_enforcement": f"""with {TURNS}, r as (select *, {parts('answer', [ANY_END])} as s from ({REPLIES})), k as (select *, list_filter(s, lambda y: {overlap('y', 'context')} >= 0.12) as kept from r)
      select conv_id, turn, md5(case when len(s) <= 1 or len(kept) = 0 then answer else array_to_string(kept, ' ') end) as answer_md5, (case when len(s) <= 1 or len(kept) = 0 then 0 else len(s) - len(kept) end)::bigint as dropped from k""",
    "q_answer_slice": f"""with made as (select doc_id::varchar as passage_id, lang, {limited(cut('text', 512))} as parts from documents),
      pieces as (select 'passage_native:' || passage_id || ':' || i as id, lang, part as text from (select passage_id, lang, unnest(parts) as part, unnest(range(len(parts))) as i from made)),
      {bm25(LANG_ITEMS, 'select id, lang, text from pieces', 1)},
      judged as (select b.query_id, b.lang, h.id, h.score, p.text as chunk, round_even({overlap('b.text', "coalesce(p.text, '')")}, 4) as overlap from ({LANG_ITEMS}) b left join hits h on h.query_id = b.query_id left join pieces p on p.id = h.id),
      named as (select *, case when id is null then 'OUT_OF_CORPUS' when overlap < 0.231 then 'UNGROUNDED_OUTPUT' end as reason from judged)
      select query_id, case when reason is null then id end as chunk_id, score, overlap, case when reason is null then 'extractive' else 'refused' end as path, reason, case when reason is null then substr(chunk, 1, 600) else {_message('reason', 'lang')} end as answer from named""",
    "q_scorable": f"with {RELEVANT} select query_id, count(*) as relevant from relevant join (select doc_id, length({NORM.format('text')}) >= 40 as long from documents) using (doc_id) group by query_id having bool_and(long)",
    "q_recall_mrr": f"""with {PER_ITEM} select {RECALL} from per""",
    "q_recall_by_lang": f"""with {PER_ITEM}, told as (select lang, {RECALL} from per group by lang)
      select *, recall_at_5 = max(recall_at_5) over () as best_recall_at_5, mrr = max(mrr) over () as best_mrr from told""",
    "q_rerank": f"""with {bm25(LANG_ITEMS, LANG_DOCS, 10)}, full_hits as (select h.*, i.text as query, d.text as doc, count(*) over (partition by h.query_id) as n from hits h join ({LANG_ITEMS}) i on i.query_id = h.query_id join documents d on d.doc_id = h.id),
      reordered as (select *, case when lang = 'en' and n >= 2 and rank <= 5 then -abs(length(doc) - length(query))::double end as rerank_score from full_hits)
      select query_id, id, row_number() over (partition by query_id order by rerank_score is null, rerank_score desc, rank) as rank, rerank_score from reordered""",
    "q_request": f"""select conv_id, turn, md5(q) as query_md5, (conv_id % 60)::bigint as top_k, length(q) <= 200 and conv_id % 60 between 1 and 50 as valid from (select conv_id, turn, {strip("coalesce(text, '')")} as q from conversations)""",
    "q_citations": f"""with s as (select conv_id, turn, {sent("coalesce(text, '')")} as s from conversations),
      k as (select *, list_filter([conv_id % 4, 2, -1], lambda i: i >= 1 and i <= len(s)) as k from s)
      select conv_id, turn, array_to_string(list_transform(case when len(k) > 0 then k else range(1, len(s) + 1) end, lambda i: conv_id || ':' || turn || ':' || (i - 1) || '/' || md5(substr(s[i], 1, 600)) || '/' || round_even(i / 7.0::double, 4)::decimal(6, 4)), ',') as citations from k""",
    "q_model_reply": """select doc_id, case when doc_id % 4 < 3 then 'a' || doc_id end as answer, case when doc_id % 4 < 3 then '1,' || (-(doc_id % 9)) end as citations, case when doc_id % 4 < 3 then least(1.0, doc_id % 3 + 0.25)::double end as confidence from documents""",
    "q_prompt": f"""with {TURNS}, r as ({REPLIES}) select conv_id, turn, md5('[1] ' || context || chr(10) || chr(10) || 'Question: ' || answer) as prompt_md5, case conv_id % 3 when 0 then 'hi' when 1 then 'en' end as lang from r""",
    "q_answered": """select event_type as path, count(*) as n, count(*) filter (where event_id % 5 = 0) as refused, round(100.0::double * avg(case when value * 4 <= 200 then 1.0 else 0.0 end), 1) as within_budget_pct,
      round(quantile_cont(value * 4, 0.5), 2) as p50, round(quantile_cont(value * 4, 0.95), 2) as p95 from events group by event_type""",
    "q_breaker_replay": """with recursive e as (select user_id::varchar as key, event_id, event_id % 3 = 0 as ok, epoch_us(ts::timestamp) / 1e6 as since, row_number() over (partition by user_id order by epoch_us(ts::timestamp), event_id) as k from events),
      r as (select key, event_id, k, 'closed' as state, case when ok then 0 else 1 end as failures, null::double as opened from e where k = 1
        union all select key, event_id, k, state, failures, case when state = 'open' then opened when failures = 0 then null when failures >= 3 then since else opened end from (
          select key, event_id, k, since, state, opened, case when state = 'open' then prior when ok then 0 else prior + 1 end as failures from (
            select e.key, e.event_id, e.k, e.ok, e.since, r.opened, r.failures as prior, case when r.opened is null then 'closed' when e.since - r.opened >= 30 then 'half_open' else 'open' end as state from r join e on e.key = r.key and e.k = r.k + 1)))
      select key, event_id, state, state <> 'open' as allowed, failures from r""",
    "q_roc_sweep": f"with scores as ({SCORES}), {SWEEP.format(by='', using='on true')} select threshold, round(tpr, 9) as tpr, round(fpr, 9) as fpr, round(tpr - fpr, 9) as youden from curve",
    "q_threshold": f"""with scores as ({SCORES}), {SWEEP.format(by='lang,', using='using (lang)')},
      ordered as (select *, row_number() over (partition by lang order by case when fpr <= 0.10 and tpr >= 0 then 0 when tpr >= 0 then 1 else 2 end, round(tpr - fpr, 4) desc, threshold) as r from curve)
      select lang, threshold, round(tpr, 9) as tpr, round(fpr, 9) as fpr, round(tpr - fpr, 9) as youden from ordered where r = 1""",
    "q_separation": f"""select lang, n_pos, n_neg, round(in_mean, 6) as in_mean, round(in_p10, 6) as in_p10, round(ood_mean, 6) as ood_mean, round(ood_p90, 6) as ood_p90, round(in_p10 - ood_p90, 6) as separation from (
      select lang, count(*) filter (where positive) as n_pos, count(*) filter (where not positive) as n_neg, avg(score) filter (where positive) as in_mean, quantile_cont(score, 0.1) filter (where positive) as in_p10,
        avg(score) filter (where not positive) as ood_mean, quantile_cont(score, 0.9) filter (where not positive) as ood_p90 from ({SCORES}) group by lang) where n_pos >= 20 and n_neg >= 5""",
    "q_score_summary": f"select positive, count(*) as n, round(avg(score), 6) as mean, round(quantile_cont(score, 0.05), 6) as p05, round(quantile_cont(score, 0.5), 6) as p50, round(quantile_cont(score, 0.95), 6) as p95 from ({SCORES}) group by positive",
    "q_latency": latency(""),
    "q_latency_by_path": latency("event_type"),
    "q_path_share": "select event_type, count(*) as n, round(100.0::double * count(*) / (sum(count(*)) over ()), 1) as share_pct from events group by event_type",
    "q_stage_rollup": """with s as (select user_id as request_id, ['guard_input', 'embed', 'retrieve', 'extract', 'generate'][event_id % 5 + 1] as stage, round(value, 4) as ms from events)
      select request_id, string_agg(distinct stage, ',' order by stage) as stages, round(sum(case when stage <> 'generate' then ms else 0 end), 3) as core_ms, round(sum(ms), 3) as total_ms, round(sum(case when stage <> 'generate' then ms else 0 end), 6) <= 200 as within_budget from s group by request_id""",
    "q_lang_counts": "select lang, count(*) as n from documents group by lang",
    "q_corpus_cap": "select doc_id, lang from (select doc_id, lang, coalesce(sum(length(text) - length(replace(text, chr(10), ''))) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents) where before < 2000",
    "q_stratified": "select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as r, (select count(distinct lang) from documents) as g from documents) where r <= greatest(1, floor(100 / g))",
    "q_query_sample": "select key, row_number() over (order by h, key) as position from (select key, h from (select conv_id || ':' || turn as key, md5('13|' || conv_id || ':' || turn) as h from conversations where role = 'user') order by h, key limit 50)",
    "q_corpus_build": f"with {CORPUS} select doc_id || ':' || i as passage_id, doc_id, lang, query_id, is_selected, md5(text) as text_md5 from (select lang || ':' || query_id as doc_id, lang, query_id, p.i as i, p.s as is_selected, p.text as text from (select lang, query_id, unnest(kept) as p from capped))",
    "q_corpus_queries": f"with {CORPUS} select query_id, lang, md5(query) as query_md5, array_to_string(list_transform(list_filter(kept, lambda p: p.s <> 0), lambda p: lang || ':' || query_id || ':' || p.i), ',') as relevant from capped where positive",
}
