"""All queries of the core, by name, and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, chunking, evaluation, evidence, index, prompting, reader, rerank, retrieval, submission
from ..runtime import stored, table
from ..schemas import chunk_rules, hit_rules, violations
from . import pipeline
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]

DIRECT = prompting.Template("direct", "1", "Bạn là trợ lý pháp luật. Trả lời ngắn gọn, đúng quy định.\n\nCâu hỏi: {question}\nTrả lời:")
RAG = prompting.Template("rag", "1", "Chỉ dùng các trích đoạn sau.\n\n{evidence}\n\nCâu hỏi: {question}\nTrả lời:")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ---- pieces of SQL -------------------------------------------------------------------------

def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SPACES = f"'[{X.SPACE}]+'"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({x}), {SPACES}, ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({x}), '\\r\\n?', chr(10), 'g'), '^[{X.SPACE}]+', ''), '[{X.SPACE}]+$', '')"


def legal(x: str) -> str:
    return f"regexp_extract_all({squeezed(x)}, {_quote(X.LEGAL_TOKEN)}, 1)"


def evals(x: str) -> str:
    return f"regexp_extract_all({stripped(x)}, {_quote(X.EVAL_TOKEN)}, 1)"


def folded(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def wordlist(x: str) -> str:
    return f"regexp_extract_all({folded(x)}, {_quote(X.WORD_TOKEN)}, 1)"


def key(x: str) -> str:
    return folded(squeezed(x))


def not_blank(x: str) -> str:
    return f"regexp_matches({x}, '[^{X.SPACE}]')"


def _strip_only(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{X.SPACE}]+', ''), '[{X.SPACE}]+$', '')"


def one_line(x: str) -> str:
    return _strip_only(f"replace(replace({x}, chr(13), ' '), chr(10), ' ')")


# ---- text and index ------------------------------------------------------------------------

@query(f"{T.ctes('c')} select chunk_id, len(t)::bigint n_tokens, len(list_distinct(t))::bigint n_distinct from (select chunk_id, {legal('retrieval_text')} t from c)")
def token_counts(spark, d):
    t = T.chunks(spark, d).select("chunk_id", X.legal_tokens(F.col("retrieval_text")).alias("t"))
    return t.select("chunk_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(f"{T.ctes('c')} select chunk_id, term, count(*)::int tf from (select chunk_id, unnest({legal('retrieval_text')}) term from c) group by 1, 2")
def index_postings(spark, d):
    return index.postings(T.chunks(spark, d))


@query(f"{T.ctes('c')} select term, count(distinct chunk_id)::bigint df from (select chunk_id, unnest({legal('retrieval_text')}) term from c) group by 1")
def index_df(spark, d):
    return index.build(T.chunks(spark, d)).df


@query(
    f"{T.ctes('c')}, t as (select chunk_id, {legal('retrieval_text')} t from c), v as (select count(distinct x)::bigint vocabulary from (select unnest(t) x from t)) "
    "select count(*)::bigint n_docs, sum(len(t))::bigint total_tokens, round(avg(len(t)), 6) avg_dl, any_value(vocabulary) vocabulary from t, v"
)
def index_stats(spark, d):
    return index.build(T.chunks(spark, d)).stats.select("n_docs", "total_tokens", F.round("avg_dl", 6).alias("avg_dl"), "vocabulary")


@query(
    "select chunk_id, document_length::bigint document_length, counted from (select chunk_id, document_length, list_sum(list_transform(term_frequencies, lambda x: x.tf))::bigint counted "
    "from (select distinct chunk_id, term_frequencies, document_length from indexed_documents where term_frequencies is not null)) where coalesce(counted, 0) <> document_length"
)
def index_inconsistencies(spark, d):
    rows = table(spark, d, "indexed_documents").select("chunk_id", "term_frequencies", "document_length").distinct()
    return index.inconsistent(rows).select("chunk_id", F.col("document_length").cast("bigint").alias("document_length"), F.col("counted").cast("bigint").alias("counted"))


_ASKED = "try_cast(id as bigint) % 50 = 0"
_BM25 = f"""{T.ctes('q', 'c', 'd')}, t as (select chunk_id, {legal('retrieval_text')} t from c),
len as (select chunk_id, len(t) dl from t), post as (select chunk_id, term, count(*) tf from (select chunk_id, unnest(t) term from t) group by 1, 2),
df as (select term, count(*) df from post group by 1), st as (select count(*)::double n, avg(dl) a from len),
qt as (select distinct id, unnest({legal('question')}) term from q where {_ASKED}),
sc as (select id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) s
  from qt join post using (term) join df using (term) join len using (chunk_id), st group by 1, 2),
top as (select id, chunk_id, row_number() over (partition by id order by s desc, chunk_id) rk, s from sc where s > 0 qualify rk <= 12)"""


def _asked(spark, d):
    return T.questions(spark, d).where(T.asked())


def _bm25(spark, d, top=12):
    c = T.chunks(spark, d).select("chunk_id", "retrieval_text")
    return retrieval.bm25(_asked(spark, d), index.build(stored(c)), top)


@query(f"{_BM25} select id, chunk_id, rk::int rank, round(s, 6) bm25_score from top")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("id", "chunk_id", "rank", F.round("bm25_score", 6).alias("bm25_score"))


_LINE = squeezed("retrieval_text").replace("nfc_normalize(retrieval_text)", "retrieval_text")


@query(
    f"{_BM25} select top.id, rk::int rank, chunk_id, document_id, coalesce(d.name, document_id) document_name, coalesce(section_label, '(unlabeled)') section_label, round(s, 6) bm25_score, "
    f"case when length(line) > 240 then regexp_replace(left(line, 237), '[{X.SPACE}]+$', '') || '...' else line end preview "
    f"from (select *, {_LINE} line from c) c join top using (chunk_id) left join d on d.id = document_id"
)
def bm25_inspect(spark, d):
    rows = retrieval.inspect(_bm25(spark, d), T.chunks(spark, d), T.documents(spark, d))
    return rows.withColumn("bm25_score", F.round("bm25_score", 6))


def _cases(spark, d):
    q = T.questions(spark, d).where("split = 'train' and answer is not null")
    return q.select(F.col("id").alias("case_id"), F.col("id").alias("pos"), F.col("answer").alias("context"))


_READER = f"""{T.ctes('q')}, k as (select id case_id, {wordlist('answer')} t, answer from q where split = 'train' and answer is not null),
post as (select case_id, term, count(*) tf from (select case_id, unnest(t) term from k) group by 1, 2), df as (select term, count(*) df from post group by 1),
st as (select count(*)::double n, greatest(avg(len(t)), 1) a from k), qt as (select id, term, count(*) times from (select id, unnest({wordlist('question')}) term from q where {_ASKED}) group by 1, 2),
sc as (select id, case_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / a))), 9) s
  from qt join post using (term) join df using (term) join k using (case_id), st group by 1, 2),
al as (select id, case_id, coalesce(s, 0) s from (select id from q where {_ASKED}) cross join (select case_id from k) left join sc using (id, case_id)),
top as (select id, case_id, row_number() over (partition by id order by s desc, case_id) rk, s from al qualify rk <= 5)"""


def _reader_hits(spark, d):
    return retrieval.reader_bm25(_asked(spark, d), stored(_cases(spark, d)), 5)


@query(f"{_READER} select id, case_id, rk::int rank, round(s, 6) score from top")
def reader_bm25_topk(spark, d):
    return _reader_hits(spark, d).withColumn("score", F.round("score", 6))


_CANDIDATES = f"""{_READER}, own as (select id, 0 place, 'original' origin, id source_case_id, answer context from q where {_ASKED} and answer is not null),
allc as (select * from own union all select id, rk, 'train_retrieval', case_id, k.answer from top join k using (case_id) where id in (select id from own)),
ded as (select *, row_number() over (partition by id, context order by place) cp from allc), cand as (select id, (row_number() over (partition by id order by place) - 1) position, origin, source_case_id, context from ded where cp = 1)"""


def _candidates(spark, d):
    q = _asked(spark, d).where("answer is not null").select("id", F.col("answer").alias("context"))
    hits = _reader_hits(spark, d).join(q.select("id"), "id", "left_semi")
    return retrieval.reader_candidates(q, hits, _cases(spark, d).select("case_id", "context"))


@query(f"{_CANDIDATES} select id, position::int as position, origin, source_case_id, context from cand")
def reader_candidates(spark, d):
    return _candidates(spark, d)


def _by_length(question: str, context: str) -> reader.Span:
    """A stand-in for a model: the opening of the context, the surer the shorter it is."""
    return reader.Span(context[:50], round(1.0 / (1 + len(context) // 100), 6))


@query(f"{_CANDIDATES} select id, left(context, 50) answer, confidence, source_case_id, origin source_origin from (select *, round(1.0 / (1 + length(context) // 100), 6) confidence from cand) qualify row_number() over (partition by id order by confidence desc, position) = 1")
def reader_best(spark, d):
    """Own and retrieved contexts read by a mock reader, the most confident span of each question."""
    q = _asked(spark, d).where("answer is not null").select("id", "question", F.col("answer").alias("context"))
    done = reader.run(q, reader.mock(_by_length), "tuned_bm25_reader", stored(_cases(spark, d)), 5)
    return done.predictions.select("id", "answer", "confidence", "source_case_id", "source_origin")


# ---- hits, reranking, evidence -------------------------------------------------------------

def _runs(spark, d):
    """Stored hits of every question and method, as one question id each."""
    return T.hits(spark, d).withColumn("id", F.concat_ws("|", "id", "method"))


_RUNS = T.ctes("h", "c", "d", "q") + ", r as (select id || '|' || method id, chunk_id, document_id, source_path, rank, bm25_score, rerank_score from h)"


@query(f"{_RUNS} select id, chunk_id, row_number() over (partition by id order by rerank_score desc, chunk_id, old)::int rank, bm25_score, rerank_score from (select *, round(1.0 / rank, 9) rerank_score, rank old from (select * exclude (rerank_score) from r))")
def rerank_mock(spark, d):
    r = rerank.mock(_runs(spark, d).withColumn("old", F.col("rank")).drop("rerank_score"))
    return r.select("id", "chunk_id", "rank", "bm25_score", "rerank_score")


@query(f"{_RUNS} select id, chunk_id, rank, bm25_score, null::double rerank_score, false used, 'reranking_disabled' fallback_reason from r")
def rerank_noop(spark, d):
    return rerank.noop(_runs(spark, d)).select("id", "chunk_id", "rank", "bm25_score", "rerank_score", "used", "fallback_reason")


@query(
    "with q as (select vec_id query_id, embedding e from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id, round(list_dot_product(e::double[], embedding::double[]) / (sqrt(list_dot_product(e::double[], e::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) score "
    "from q, embeddings where vec_id <> query_id) select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id)::int rank, score from s qualify rank <= 10"
)
def nearest_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rerank.nearest(e, e.where("vec_id % 50 = 0"), 10)


@query(
    f"{T.ctes('h')}, s as (select method, case when rerank_score is null then 'reranker_unavailable' end reason, rerank_score is not null used from h) select method, "
    "case when bool_and(used) then 'true' when not bool_or(used) then 'false' else 'mixed' end used, count(*)::bigint n, coalesce(list_sort(list(distinct reason) filter (reason is not null)), []) reasons from s group by 1"
)
def rerank_status(spark, d):
    shown = {"used": F.col("rerank_score").isNotNull(), "fallback_reason": F.when(F.col("rerank_score").isNull(), "reranker_unavailable")}
    return rerank.status(T.hits(spark, d).withColumns(shown), "method")


@query(
    f"{_RUNS}, k as (select r.*, {key('retrieval_text')} key from r join c using (chunk_id)) select id, chunk_id, rank, first_value(chunk_id) over w kept_chunk_id, first_value(chunk_id) over w <> chunk_id dropped from k window w as (partition by id, key order by rank, chunk_id)"
)
def dedup_exact(spark, d):
    return evidence.exact_duplicates(_runs(spark, d), T.chunks(spark, d)).select("id", "chunk_id", "rank", "kept_chunk_id", "dropped")


#: Pairs of hits of one question from the same place, and their longest common run.
_PLACES = f"""{_RUNS}, t as (select chunk_id, {key('retrieval_text')} key, document_id || chr(1) || source_path || chr(1) || coalesce(source_member, '') || chr(1) || {key("coalesce(section_label, '')")} place from c),
hp as (select r.id, r.chunk_id, r.rank, key, place, row_number() over (partition by r.id order by rank, r.chunk_id) n from r join t using (chunk_id)),
pr as (select distinct x.chunk_id a, y.chunk_id b from hp x join hp y on x.id = y.id and x.place = y.place and x.chunk_id < y.chunk_id),
w as (select chunk_id, string_split(key, ' ') t from t),
ta as (select a, b, generate_subscripts(t, 1) i, unnest(t) tok from pr join w on chunk_id = a), tb as (select a, b, generate_subscripts(t, 1) j, unnest(t) tok from pr join w on chunk_id = b),
mt as (select a, b, i, i - j dd from ta join tb using (a, b, tok)), isl as (select a, b, dd, i - row_number() over (partition by a, b, dd order by i) g from mt),
run as (select a, b, count(*) n from isl group by a, b, dd, g), best as (select a, b, max(n) n from run group by 1, 2),
share as (select a, b, coalesce(n, 0)::bigint longest, coalesce(n, 0) / least(len(wa.t), len(wb.t)) ratio from pr left join best using (a, b) join w wa on wa.chunk_id = a join w wb on wb.chunk_id = b)"""


@query(f"{_PLACES} select a, b, longest, round(ratio, 6) ratio from share")
def contiguous_overlap(spark, d):
    """Longest common run of all hits of one question that de-duplication compares, distinct pairs once."""
    c = T.chunks(spark, d)
    key = X.dedup_key(F.col("retrieval_text"))
    place = ("document_id", "source_path", "member", "label")
    t = c.select("chunk_id", "document_id", "source_path", F.coalesce("source_member", F.lit("")).alias("member"), X.dedup_key(F.coalesce("section_label", F.lit(""))).alias("label"))
    placed = stored(_runs(spark, d).select("id", "chunk_id").distinct().join(t, "chunk_id"))
    a, b = placed.withColumnRenamed("chunk_id", "a"), placed.withColumnRenamed("chunk_id", "b")
    pairs = a.join(b, ["id", *place]).where("a < b").select("a", "b").distinct()
    w = stored(c.select("chunk_id", F.split(key, " ").alias("t")))
    pairs = pairs.join(w.select(F.col("chunk_id").alias("a"), F.col("t").alias("a_tokens")), "a").join(w.select(F.col("chunk_id").alias("b"), F.col("t").alias("b_tokens")), "b")
    return evidence.overlap_pairs(pairs).select("a", "b", F.col("longest").cast("bigint").alias("longest"), F.round("ratio", 6).alias("ratio"))


_DEDUP = f"""{_PLACES.replace('with ', 'with recursive ', 1)}, near as (select x, list({{'y': y, 'ratio': ratio}}) ys from (select a x, b y, ratio from share union all select b, a, ratio from share) where ratio >= 0.8 group by 1),
hh as (select hp.*, coalesce(ys, []) ys from hp left join near on x = hp.chunk_id),
fold as (select id, 0::bigint n, null::varchar chunk_id, null::int rank, []::struct(c varchar, k varchar, p varchar)[] kept, null::varchar duplicate_of, null::varchar reason, null::double ratio from (select distinct id from hh)
  union all select id, n, chunk_id, rank, case when e is null and o is null then list_append(kept, {{'c': chunk_id, 'k': key, 'p': place}}) else kept end, coalesce(e, o), case when e is not null then 'exact_normalized_duplicate' when o is not null then 'same_source_article_high_overlap' end,
    case when e is null and o is not null then list_filter(ys, lambda z: z.y = o)[1].ratio end
  from (select hh.id, hh.n, hh.chunk_id, hh.rank, hh.key, hh.place, hh.ys, kept, list_filter(kept, lambda z: z.k = hh.key)[1].c e, list_filter(kept, lambda z: z.p = hh.place and list_contains(list_transform(hh.ys, lambda q: q.y), z.c))[1].c o from fold join hh on hh.id = fold.id and hh.n = fold.n + 1)),
ded as (select id, chunk_id, rank, reason is null kept, duplicate_of, reason, round(ratio, 6) overlap_ratio from fold where n > 0)"""


@query(f"{_DEDUP} select * from ded")
def dedup_greedy(spark, d):
    return evidence.deduplicate(_runs(spark, d), T.chunks(spark, d)).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


def _packed(spark, d, of=None):
    """Packed evidence of all runs, or of those whose ids ``of`` holds."""
    c = stored(T.chunks(spark, d))
    runs = _runs(spark, d).select("id", "chunk_id", "rank")
    runs = stored(runs if of is None else runs.join(of.select("id"), "id", "left_semi"))
    kept = evidence.cut_to(evidence.deduplicate(runs, c), 4).where("included").select("id", "chunk_id", "rank")
    return evidence.pack(kept, c, T.documents(spark, d))


_BREAK = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
_PACK = f"""{_DEDUP}, chosen as (select id, chunk_id, rank, row_number() over (partition by id order by rank, chunk_id) n from ded where kept qualify n <= 4),
f0 as (select chosen.*, c.document_id, coalesce(raw_text, '') raw, {_strip_only("coalesce(section_label, '')")} hint, coalesce(nullif(section_label, ''), 'Không xác định') section, c.source_member, c.source_path, d.id did, d.name dname, coalesce(nullif(d.link, ''), d.source_path) dsource
  from chosen join c using (chunk_id) left join d on d.id = c.document_id),
f1 as (select *, {one_line("case when did is not null then dname else coalesce(nullif(source_member, ''), string_split(source_path, '/')[-1]) end")} nm, {one_line('section')} sec,
  {one_line("case when did is not null then dsource when source_member <> '' then source_path || '::' || source_member else source_path end")} src, regexp_replace(raw, '^[\\r\\n \\t]+', '') body from f0),
f2 as (select *, chr(10) || 'Văn bản: ' || coalesce(nm, '') || chr(10) || 'Mã tài liệu: ' || {one_line('document_id')} || chr(10) || 'Điều/Khoản: ' || coalesce(sec, '') || chr(10) || 'Nguồn: ' || coalesce(src, '') || chr(10) || 'Nội dung:' head,
  regexp_extract(body, '^([^{_BREAK[1:]}*)', 1) line, regexp_extract(body, '^[^{_BREAK[1:]}*(\\r\\n|{_BREAK}|)', 1) mk from f1),
f3 as (select *, substring(body, (length(line) + length(mk) + 1)::int) behind, case when replace(replace(mk, chr(13), ''), chr(10), '') = '' then line else line || mk end first from f2),
f4 as (select *, behind = '' and hint <> '' and body <> '' by_hint, starts_with({folded('first')}, {folded('hint')}) opens from f3),
f5 as (select id, chunk_id, document_id, rank, n, raw, head, case when by_hint then hint else first end ld, case when not by_hint then behind when opens then substring(first, (length(hint) + 1)::int) else first end tl from f4),
pk as (select id, 0::bigint n, null::varchar chunk_id, null::varchar document_id, null::int rank, 0::bigint spent, 0::int shown, []::varchar[] docs, null::varchar state, null::varchar reason, null::varchar block from (select distinct id from f5)
  union all select id, n, chunk_id, document_id, rank, case when blk is null then spent else 4000 - free + length(blk) end, case when blk is null then shown else shown + 1 end, case when blk is null then docs else list_append(docs, document_id) end,
    case when blk is null then 'dropped' when whole then 'included' else 'truncated' end, case when blk is null then case when many then 'max_chunks_per_document' else 'max_total_chars' end end, blk
  from (select *, case when many then null when whole then full_block when length(ld) > 0 and room >= 0 then hd || chr(10) || ld || left(tl, room::int) || chr(10) || '… [ĐÃ CẮT PHẦN ĐUÔI]' end blk
    from (select *, length(full_block) <= free whole, free - length(hd) - 1 - {len(evidence.TRUNCATION_MARK)} - length(ld) room from (select *, hd || chr(10) || raw full_block
      from (select f5.*, pk.spent, pk.shown, pk.docs, 4000 - pk.spent - case when pk.shown > 0 then 2 else 0 end free, len(list_filter(pk.docs, lambda z: z = f5.document_id)) >= 2 many, '[TRÍCH ĐOẠN ' || (pk.shown + 1) || ']' || head hd from pk join f5 on f5.id = pk.id and f5.n = pk.n + 1))))),
packed as (select id, chunk_id, document_id, rank, state, reason, case when block is not null then shown end position, block from pk where n > 0)"""


@query(f"{_PACK} select id, chunk_id, document_id, rank, state, reason, position::int as position, length(block)::int block_chars, sha256(block) block_sha256 from packed")
def pack_evidence(spark, d):
    return _packed(spark, d).select("id", "chunk_id", "document_id", "rank", "state", "reason", "position", F.length("block").alias("block_chars"), F.sha2("block", 256).alias("block_sha256"))


_SHOWN = f"{_PACK}, ev as (select id, string_agg(block, chr(10) || chr(10) order by position) ev, count(*)::int n_included from packed where block is not null group by 1)"


@query(
    f"{_SHOWN}, pt as (select ev.id, n_included, replace(replace({_quote(RAG.text)}, '{{question}}', question), '{{evidence}}', ev) prompt from ev join q on q.id = string_split(ev.id, '|')[1]) "
    f"select id, length(prompt)::int prompt_chars, sha256(prompt) prompt_sha256, n_included from pt".replace("pt as", "pt as")
)
def rag_prompts(spark, d):
    """Retrieve, de-duplicate, pack and render: digest and length of the prompt of every question and method."""
    e = evidence.render(_packed(spark, d)).where("evidence <> ''")
    q = T.questions(spark, d).select(F.col("id").alias("qid"), "question")
    rows = e.withColumn("qid", F.split("id", r"\|")[0]).join(q, "qid")
    prompt = prompting.render(RAG, F.col("question"), F.col("evidence"))
    return rows.select("id", F.length(prompt).alias("prompt_chars"), F.sha2(prompt, 256).alias("prompt_sha256"), F.size("included_ids").alias("n_included"))


@query(f"{_PACK} select id, list_sort(list(distinct document_id)) document_ids from packed where block is not null group by 1")
def evidence_documents(spark, d):
    """Distinct documents of the packed evidence."""
    return audit.case_documents(_packed(spark, d))


@query(f"{T.ctes('h', 'c', 'd')} select method, count(*)::bigint n_hits, count(*) filter (c.chunk_id is null)::bigint n_without_chunk, count(*) filter (c.chunk_id is not null and d.id is null)::bigint n_without_document from h left join c using (chunk_id) left join d on d.id = c.document_id group by 1")
def hit_lookups(spark, d):
    c = T.chunks(spark, d).select("chunk_id", F.col("document_id").alias("doc"), F.lit(1).alias("has_c"))
    doc = T.documents(spark, d).select(F.col("id").alias("doc"), F.lit(1).alias("has_d"))
    rows = T.hits(spark, d).join(c, "chunk_id", "left").join(doc, "doc", "left")
    return rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("has_c").isNull()).alias("n_without_chunk"),
        F.count_if(F.col("has_c").isNotNull() & F.col("has_d").isNull()).alias("n_without_document"),
    )


# ---- chunking ------------------------------------------------------------------------------

@query(
    f"""{T.ctes('d')}, l as (select id, passage, length(passage) n, greatest(ceil((length(passage) - 1200) / 1000.0), 0)::int k from d where passage is not null),
s as (select id, passage, n, unnest(case when n <= 1200 then [{{'a': 0, 'b': n}}] else list_distinct(list_concat(list_transform(range(k), lambda i: {{'a': (i * 1000)::bigint, 'b': (i * 1000 + 1200)::bigint}}), [{{'a': (case when n - k * 1000 >= 100 then k * 1000 else n - 1200 end)::bigint, 'b': n}}])) end) w from l),
x as (select id document_id, w.a start_offset, w.b end_offset, substring(passage, (w.a + 1)::int, (w.b - w.a)::int) raw_text from s)
select document_id, (row_number() over (partition by document_id order by start_offset) - 1)::int chunk_no, start_offset::int start_offset, end_offset::int end_offset, raw_text, sha256(raw_text) content_hash
from x qualify {not_blank('raw_text')}"""
)
def chunk_windows(spark, d):
    return chunking.chunk_windows(T.documents(spark, d))


@query()
def chunk_ladder(spark, d):
    return chunking.chunk_documents(T.documents(spark, d)).drop("raw_text", "retrieval_text")


@query(f"{T.ctes('c')} select count(*)::bigint n_chunks, count(distinct document_id)::bigint n_documents, sum(length(raw_text))::bigint total_chars, min(length(raw_text))::int min_chars, max(length(raw_text))::int max_chars from c")
def chunk_summary(spark, d):
    return chunking.summary(T.chunks(spark, d))


@query(
    f"""{T.ctes('c')}, v as (select chunk_id, unnest([case when chunk_id is null or not {not_blank('chunk_id')} then 'chunk_id_blank' end, case when document_id is null or not {not_blank('document_id')} then 'document_id_blank' end,
case when raw_text is null or not {not_blank('raw_text')} then 'raw_text_blank' end, case when retrieval_text is null or not {not_blank('retrieval_text')} then 'retrieval_text_blank' end,
case when (start_offset is null) <> (end_offset is null) then 'one_offset_missing' end, case when end_offset <= start_offset then 'offsets_not_ascending' end]) rule from c) select * from v where rule is not null"""
)
def chunk_violations(spark, d):
    return violations(T.chunks(spark, d), "chunk_id", chunk_rules())


@query(
    f"""{T.ctes('h')}, v as (select id, unnest([case when rank is null or rank <= 0 then 'rank_not_positive' end, case when bm25_score is null or not isfinite(bm25_score) then 'score_not_finite' end,
case when rerank_score is not null and not isfinite(rerank_score) then 'rerank_not_finite' end]) rule from h) select * from v where rule is not null"""
)
def hit_violations(spark, d):
    return violations(T.hits(spark, d), "id", hit_rules())


# ---- prompts and answers -------------------------------------------------------------------

@query(
    f"{T.ctes('q')}, x as (select id, replace({_quote(DIRECT.text)}, '{{question}}', question) prompt from q) "
    f"select id, length(prompt)::int prompt_chars, case when {not_blank('prompt')} then 'Mock response [' || left(sha256(prompt), 16) || '].' end raw_answer, 'success' status from x where prompt is not null"
)
def mock_generate(spark, d):
    prompts = T.questions(spark, d).where("question is not null").select("id", prompting.render(DIRECT, F.col("question")).alias("prompt"))
    answers = prompting.mock_generate(prompts)
    return prompts.join(answers, "id").select("id", F.length("prompt").alias("prompt_chars"), "raw_answer", "status")


_ROUND = "case when starts_with(f, 'FINAL_ANSWER:') then substring(f, 14) when starts_with(f, 'CÂU TRẢ LỜI:') then substring(f, 13) else f end"
def _unfenced(x: str) -> str:
    return f"regexp_replace({x}, '(?s)\\A[ \\t]*```[A-Za-z0-9_-]*[ \\t]*\\n(.*)\\n[ \\t]*```[ \\t]*\\z', '\\1')"


@query(
    f"{T.ctes('p')}, a as (select id, method, {_strip_only('regexp_replace(answer, chr(13) || chr(10) || chr(63), chr(10), ' + chr(39) + 'g' + chr(39) + ')')} t from p where answer is not null), "
    f"f1 as (select id, method, {_strip_only(_unfenced('t'))} f from a), p1 as (select id, method, {_strip_only(_ROUND)} t from f1), f2 as (select id, method, {_strip_only(_unfenced('t'))} f from p1) "
    f"select id, method, {_strip_only(_ROUND)} answer from f2"
)
def clean_answers(spark, d):
    return T.predictions(spark, d).where("answer is not null").select("id", "method", prompting.clean_answer(F.col("answer")).alias("answer"))


# ---- evaluation ----------------------------------------------------------------------------

def _gold(spark, d):
    return T.questions(spark, d).where("answer is not null").select("id", "answer")


def _pairs(spark, d):
    """Predictions with their references: id is question and method."""
    g = _gold(spark, d).select("id", F.col("answer").alias("reference"))
    return T.predictions(spark, d).join(g, "id").select(F.concat_ws("|", "id", "method").alias("id"), "method", "reference", F.col("answer").alias("prediction"))


_EV = f"""{T.ctes('q', 'p')}, a as (select p.id || '|' || method id, method, q.answer reference, p.answer prediction from p join q using (id) where q.answer is not null),
n as (select id, method, {stripped("coalesce(reference, '')")} r, {stripped("coalesce(prediction, '')")} pr, {evals('reference')} rt, {evals('prediction')} pt from a),
s as (select *, case when pr = '' then 'empty_prediction' when r = '' then 'empty_reference' else 'scored' end status from n),
er as (select id, tok, ps, row_number() over (partition by id, tok order by ps) k from (select id, unnest(rt) tok, generate_subscripts(rt, 1) ps from s where status = 'scored')),
ep as (select id, tok, ps, row_number() over (partition by id, tok order by ps) k from (select id, unnest(pt) tok, generate_subscripts(pt, 1) ps from s where status = 'scored')),
m as (select er.id, er.ps rp, er.ps <> 1 + lag(er.ps) over (partition by er.id order by ep.ps) brk from er join ep using (id, tok, k)),
mm as (select id, count(*) n, sum(case when brk is null or brk then 1 else 0 end) ch from m group by 1),
me as (select s.id, method, status, coalesce(n, 0)::bigint matches, coalesce(ch, 0)::bigint chunks, case when len(pt) > 0 then coalesce(n, 0) / len(pt) else 0 end pc, case when len(rt) > 0 then coalesce(n, 0) / len(rt) else 0 end rc from s left join mm using (id)),
ms as (select *, case when status = 'scored' then case when rc + 9 * pc > 0 then 10 * pc * rc / (rc + 9 * pc) else 0 end * (1 - case when chunks > 1 then 0.5 * pow(chunks / matches, 3) else 0 end) end meteor from me)"""


@query(f"{_EV} select id, matches, chunks, round(pc, 6) \"precision\", round(rc, 6) recall, round(meteor, 6) meteor from ms where status = 'scored'")
def meteor_cases(spark, d):
    p = _pairs(spark, d)
    ok = p.where((X.eval_text(F.coalesce("prediction", F.lit(""))) != "") & (X.eval_text(F.col("reference")) != ""))
    cases = stored(ok.select("id", X.eval_tokens(F.col("reference")).alias("reference_tokens"), X.eval_tokens(F.col("prediction")).alias("prediction_tokens")))
    return evaluation.meteor(cases).select("id", "matches", "chunks", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("meteor", 6).alias("meteor"))


def _scores(spark, d):
    p = stored(_pairs(spark, d))
    return stored(evaluation.score_cases(p, "method")), p


_LCS = f"""{_EV.replace('with ', 'with recursive ', 1)}, tk as (select id, rt, pt from s where status = 'scored'),
dp as (select id, 0 i, unnest(range(1, len(pt) + 1)) j, 0 v from tk
  union all select id, i + 1, j, max(greatest(v, diagonal)) over (partition by id order by j) from (select dp.id, i, j, v, coalesce(lag(v) over (partition by dp.id order by j), 0) + (rt[i + 1] = pt[j])::int diagonal from dp join tk using (id) where i < len(rt))),
lc as (select dp.id, max(v) lcs from dp join tk using (id) where i = len(rt) group by 1),
sc as (select ms.id, method, ms.status, meteor, case when ms.status = 'scored' then coalesce(2.0 * lcs / (len(rt) + len(pt)), 0) end rouge_l from ms left join tk using (id) left join lc using (id))"""


@query(f"{_LCS} select id, method, status, round(meteor, 6) meteor, round(rouge_l, 6) rouge_l from sc")
def score_cases(spark, d):
    s, _ = _scores(spark, d)
    return s.select("id", "method", "status", F.round("meteor", 6).alias("meteor"), F.round("rouge_l", 6).alias("rouge_l"))


@query(f"{_EV} select method, count(*)::bigint n_cases, count(*) filter (status = 'scored')::bigint n_scored, count(*) filter (status = 'empty_prediction')::bigint n_empty_prediction, count(*) filter (status = 'empty_reference')::bigint n_empty_reference, round(avg(meteor), 6) meteor from ms group by 1")
def macro_meteor(spark, d):
    s, _ = _scores(spark, d)
    return evaluation.macro(s, "method").drop("rouge_l").withColumn("meteor", F.round("meteor", 6))


@query(
    f"""{T.ctes('q', 'p')}, a as (select p.id || '|' || method id, {wordlist('q.answer')} r, {wordlist("coalesce(p.answer, '')")} t from p join q using (id) where q.answer is not null),
cr as (select id, x, count(*) n from (select id, unnest(r) x from a) group by 1, 2), cp as (select id, x, count(*) n from (select id, unnest(t) x from a) group by 1, 2),
o as (select id, sum(least(cr.n, cp.n)) n from cr join cp using (id, x) group by 1)
select id, (r = t)::int::double exact_match, round(case when len(r) = 0 and len(t) = 0 then 1 when coalesce(n, 0) = 0 then 0 else 2 * n / (len(r) + len(t)) end, 6) token_f1 from a left join o using (id)"""
)
def reader_em_f1(spark, d):
    return evaluation.exact_match_f1(_pairs(spark, d)).withColumn("token_f1", F.round("token_f1", 6))


@query(f"{T.ctes('q', 'p')}, g as (select id from q where answer is not null), m as (select distinct id from p), x as (select coalesce(g.id, m.id) id, g.id gi, m.id mi from g full join m on g.id = m.id) select id, case when mi is null then 'missing' else 'extra' end issue from x where gi is null or mi is null")
def align_issues(spark, d):
    return evaluation.alignment_issues(_gold(spark, d), T.predictions(spark, d).select("id", "answer").dropDuplicates(["id"]))


def _rated(spark, d):
    """The report of all cases with the state of their packed evidence."""
    s, p = _scores(spark, d)
    refs, preds = p.select("id", F.col("reference").alias("answer")), p.select("id", F.col("prediction").alias("answer"))
    shown = F.when(F.col("block").isNotNull(), F.struct("rank", "chunk_id", "document_id", "block"))
    packed = _packed(spark, d, p).groupBy("id").agg(F.array_sort(F.collect_list(shown)).alias("blocks")).withColumn("status", F.lit("success"))
    return evaluation.error_report(s, refs, preds, evaluation.retrieval_status(packed))


_REPORT = f"""{_PACK}, {_LCS[_LCS.index('a as ('):]}, np as (select id, count(block)::int n from packed group by 1),
er1 as (select sc.*, case when n is null then 'not_available' when n = 0 then 'miss' else 'success' end retrieval_status, n from sc left join np using (id))"""


@query(
    f"{_REPORT.replace('h as (', 'p as (' + T.SQL['p'][len('p as ('):] + ', h as (', 1)} select row_number() over (order by m nulls first, coalesce(rl, -1), id) place, id, status, m meteor, rl rouge_l, retrieval_status, coalesce(n, -1) n_previews from (select *, round(meteor, 9) m, round(rouge_l, 9) rl from er1)".replace("m meteor, rl rouge_l", "round(m, 6) meteor, round(rl, 6) rouge_l")
)
def error_report(spark, d):
    """Worst cases first, with the state of their retrieval."""
    report = _rated(spark, d)
    return report.select("place", "id", "status", F.round("meteor", 6).alias("meteor"), F.round("rouge_l", 6).alias("rouge_l"), "retrieval_status", F.coalesce(F.size("previews"), F.lit(-1)).alias("n_previews"))


# ---- audits --------------------------------------------------------------------------------

_PROFILE = f"""select count(*)::bigint n_rows, count(distinct id)::bigint n_ids, (count(*) - count(distinct id))::bigint n_repeated, count(*) filter (question is null or not {not_blank('question')})::bigint n_blank_questions,
count(*) filter (answer is null)::bigint n_missing_answers, count(*) filter (answer is not null and not {not_blank('answer')})::bigint n_blank_answers from legal_questions"""


@query(_PROFILE)
def question_profile(spark, d):
    return audit.question_profile(table(spark, d, "legal_questions"))


@query(
    f"{T.ctes('q')} select split, count(question)::bigint n, min(length(question))::bigint min, max(length(question))::bigint max, round(avg(length(question)), 6) mean, round(quantile_cont(length(question), 0.5), 6) p50, round(quantile_cont(length(question), 0.9), 6) p90, "
    f"round(quantile_cont(length(question), 0.95), 6) p95, count(distinct id)::bigint n_ids, count(*) filter (answer is null)::bigint n_missing_answers, count(*) filter (not {not_blank('question')})::bigint n_blank_questions from q group by 1"
)
def split_profile(spark, d):
    s = audit.split_profile(T.questions(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if c in ("mean", "p50", "p90", "p95") else c for c in s.columns])


@query(f"{T.ctes('d')} select source_path, min(length(passage))::bigint min, round(avg(length(passage)), 6) mean, quantile_disc(length(passage), 0.95)::bigint p95, max(length(passage))::bigint max from d where passage is not null group by 1")
def passage_lengths(spark, d):
    return audit.length_summary(T.documents(spark, d).where("passage is not null"), F.length("passage"), "source_path")


@query(
    f"""{T.ctes('q')}, k as (select split, question q, {key('question')} n, {_strip_only("coalesce(answer, '')")} a from q), e as (select split, count(*) filter (c > 1)::bigint exact_groups from (select split, q, count(*) c from k group by 1, 2) group by 1),
nn as (select split, count(*) filter (c > 1)::bigint normal_groups from (select split, n, count(*) c from k group by 1, 2) group by 1), pp as (select split, count(*) filter (c > 1)::bigint pair_groups from (select split, n, a, count(*) c from k group by 1, 2, 3) group by 1)
select split, exact_groups, normal_groups, pair_groups from e join nn using (split) join pp using (split)"""
)
def duplicate_groups(spark, d):
    return audit.duplicate_groups(T.questions(spark, d), "split")


@query(
    f"""{T.ctes('q')}, k as (select distinct split, id, {key('question')} n from q where split in ('train', 'warmup', 'public', 'private')), s as (select distinct split from (values ('train'), ('warmup'), ('public'), ('private')) v(split)),
pr as (select a.split x, b.split y from s a join s b on a.split < b.split), i as (select a.split x, b.split y, count(distinct a.id) c from k a join k b on a.id = b.id and a.split < b.split group by 1, 2),
n as (select a.split x, b.split y, count(distinct a.n) c from k a join k b on a.n = b.n and a.split < b.split group by 1, 2)
select x || '__' || y pair, coalesce(i.c, 0)::bigint n_ids, coalesce(n.c, 0)::bigint n_questions from pr left join i using (x, y) left join n using (x, y)"""
)
def split_overlap(spark, d):
    return audit.split_overlaps(T.questions(spark, d))


@query(
    f"{T.ctes('q', 'c')}, g as (select distinct answer from q where {not_blank('answer')}), x as (select chunk_id, coalesce(contains(retrieval_text, answer), false) t, contains(chunk_id, answer) or coalesce(contains(document_id, answer), false) "
    "or coalesce(contains(source_path, answer), false) or coalesce(contains(source_member, answer), false) or coalesce(contains(section_label, answer), false) f from c, g) "
    "select chunk_id, count(*) filter (t)::bigint n_in_text, count(*) filter (f)::bigint n_in_fields from x where t or f group by 1"
)
def gold_leaks(spark, d):
    """Chunks that hold any answer of any split literally: one row per failing chunk, with its numbers of distinct answers.

    The string fields are searched beside the text, as the index exposes both.
    """
    g = T.questions(spark, d).select(F.col("answer").alias("needle"))
    fields = F.array("chunk_id", "document_id", "source_path", "source_member", "section_label")
    c = T.chunks(spark, d).select(F.col("chunk_id").alias("text_id"), F.col("retrieval_text").alias("text"), fields.alias("fields"))
    return audit.holders(g, c).withColumnRenamed("text_id", "chunk_id")


_SUPPORT = f"""{T.ctes('q', 'h', 'c')}, f as (select h.id || '|' || method id, rank, q.answer, c.retrieval_text ev from h join c using (chunk_id) join q on q.id = h.id where q.answer is not null),
o as (select id, rank, {legal('answer')} a, {legal('ev')} e, answer, ev from f)"""


@query(f"{_SUPPORT} select id, rank, coalesce(contains(ev, answer) and {not_blank('answer')}, false) exact, case when len(a) > 0 then round(len(list_intersect(list_distinct(a), e)) / len(list_distinct(a)), 6) end overlap from o")
def answer_support(spark, d):
    """Support by each hit alone; ``evidence_support`` measures the packed evidence."""
    q = T.questions(spark, d).where("answer is not null").select(F.col("id").alias("qid"), "answer")
    c = T.chunks(spark, d).select("chunk_id", F.col("retrieval_text").alias("ev"))
    rows = _runs(spark, d).join(c, "chunk_id").withColumn("qid", F.split("id", r"\|")[0]).join(q, "qid")
    return rows.select("id", "rank", audit.contains_text(F.col("ev"), F.col("answer")).alias("exact"), F.round(audit.token_overlap(F.col("answer"), F.col("ev")), 6).alias("overlap"))


@query(
    f"{_SHOWN}, up as (select packed.id, string_agg(c.raw_text, chr(10) order by position) filter (position <= 1) t1, string_agg(c.raw_text, chr(10) order by position) filter (position <= 3) t3 from packed join c using (chunk_id) where block is not null group by 1), "
    f"ue as (select id rid, coalesce(ev, '') ev, coalesce(t1, '') t1, coalesce(t3, '') t3 from (select distinct id from r) u left join ev using (id) left join up using (id)), "
    f"cs as (select rid id, q.answer, ev, t1, t3 from ue join q on q.id = string_split(rid, '|')[1] where q.answer is not null), "
    f"tt as (select *, list_distinct({legal('answer')}) a, {legal('ev')} e from cs) "
    f"select id, case when answer <> '' then contains(ev, answer) and {not_blank('answer')} end exact, case when answer <> '' then contains({key('ev')}, {key('answer')}) and {not_blank(key('answer'))} end normal, case when answer <> '' then contains(t1, answer) and {not_blank('answer')} end top1_exact, case when answer <> '' then contains({key('t1')}, {key('answer')}) and {not_blank(key('answer'))} end top1_normal, case when answer <> '' then contains(t3, answer) and {not_blank('answer')} end top3_exact, case when answer <> '' then contains({key('t3')}, {key('answer')}) and {not_blank(key('answer'))} end top3_normal, case when answer <> '' and ev <> '' then case when len(a) > 0 then round(len(list_intersect(a, e)) / len(a), 6) else 0 end end overlap from tt"
)
def evidence_support(spark, d):
    """Support of every answer by the rendered packed evidence of its question and method; beside it by the first one and three included chunks.

    Runs of which nothing was packed have empty evidence; empty answers have no flags.
    """
    packed = stored(_packed(spark, d))
    raw = T.chunks(spark, d).select("chunk_id", "raw_text")
    first = packed.where("position <= 3").select("id", "chunk_id", "position").join(raw, "chunk_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "raw_text"))).alias("first"))
    runs = _runs(spark, d).select("id").distinct().withColumn("qid", F.split("id", r"\|")[0])
    q = T.questions(spark, d).where("answer is not null").select(F.col("id").alias("qid"), "answer")
    cases = runs.join(q, "qid").join(evidence.render(packed).select("id", "evidence"), "id", "left").join(first, "id", "left")
    upto = lambda n: F.coalesce(F.array_join(F.transform(F.slice("first", 1, n), lambda x: x["raw_text"]), "\n"), F.lit(""))
    return audit.case_support(cases.select("id", "answer", F.coalesce("evidence", F.lit("")).alias("evidence"), upto(1).alias("top1"), upto(3).alias("top3"))).withColumn("overlap", F.round("overlap", 6))


@query(
    f"{T.ctes('q')}, t as (select id, answer, len({legal('question')}) nq, len({legal(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')')}) na, len({legal('replace(' + _quote(DIRECT.text) + ', ' + chr(39) + '{question}' + chr(39) + ', question)')}) np from q where question is not null) "
    f"select id, case when answer is null or not {not_blank('answer')} then 'no_target' when nq + na + 32 > 160 then 'TARGET_DOES_NOT_FIT' when np + na <= 160 then 'fits' else 'evidence_truncated_needed' end fit from t"
)
def fit_policy(spark, d):
    q = T.questions(spark, d).where("question is not null")
    return q.select("id", audit.fit_status(F.col("question"), F.col("answer"), prompting.render(DIRECT, F.col("question")), 160).alias("fit"))


@query(f"{T.ctes('p')} select method, count(*)::bigint n, count(*) filter (status = 'error')::bigint n_errors, round(count(*) filter (status = 'error') / count(*), 6) error_rate, round(count(fallback_reason) / count(*), 6) fallback_rate, coalesce(list_sort(list(distinct fallback_reason) filter (fallback_reason is not null)), []) reasons from p group by 1")
def run_counts(spark, d):
    rounded = {c: F.round(c, 6) for c in ("error_rate", "fallback_rate")}
    n = pipeline.counts(T.predictions(spark, d), "method").withColumns(rounded)
    return n.select("method", F.col("n_cases").alias("n"), "n_errors", "error_rate", "fallback_rate", F.col("fallback_reasons").alias("reasons"))


# ---- submission and manifests --------------------------------------------------------------

_SUB = f"{T.ctes('q', 'p')}, e as (select id from q where split = 'public'), s as (select id, any_value(answer order by method) answer from p where method = 'direct' group by 1)"


@query(f"{_SUB} select coalesce(e.id, s.id) id, case when s.id is null then 'SUBMISSION_MISSING_QUESTION_ID' when e.id is null then 'SUBMISSION_EXTRA_QUESTION_ID' when answer is null then 'SUBMISSION_ANSWER_NOT_STRING' else 'SUBMISSION_EMPTY_ANSWER' end code from e full join s on e.id = s.id where s.id is null or e.id is null or answer is null or not {not_blank('answer')}")
def submission_violations(spark, d):
    expected = T.questions(spark, d).where("split = 'public'").select("id", F.col("id").alias("pos"))
    rows = T.predictions(spark, d).where("method = 'direct'").select("id", F.col("id").alias("pos"), "answer")
    return submission.violations(expected, rows).select("id", "code")


@query("with a as (select source_path path, count(*)::bigint size, min(content_hash) sha256 from (select distinct id, source_path, content_hash from legal_documents) group by 1), b as (select source_path path, count(distinct document_id)::bigint size, min(content_hash) sha256 from legal_chunks group by 1), x as (select coalesce(a.path, b.path) path, a.path ap, b.path bp, a.size s1, b.size s2, a.sha256 h1, b.sha256 h2 from a full join b on a.path = b.path) select path, case when bp is null then 'missing' when ap is null then 'extra' else 'mismatch' end issue from x where ap is null or bp is null or s1 <> s2 or h1 is distinct from h2")
def manifest_diff(spark, d):
    a = table(spark, d, "legal_documents").select("id", "source_path", "content_hash").distinct().groupBy(F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("size"), F.min("content_hash").alias("sha256"))
    b = table(spark, d, "legal_chunks").groupBy(F.col("source_path").alias("path")).agg(F.count_distinct("document_id").alias("size"), F.min("content_hash").alias("sha256"))
    return submission.manifest_diff(a, b)
