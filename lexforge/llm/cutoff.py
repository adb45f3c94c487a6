"""Problem 10: texts that stop before their end, from word trigrams inside texts and at ends.

Cut notices behind the text are taken off, and what then stands last decides:

* a broken character, an open bracket, a comma or the like, or a bare list mark is a cut;
* a full stop behind a number, a question or an exclamation mark is judged like other ends
  only where a number stands before the stop (amounts are written with stops inside);
* any other end is judged by its last three words: how often, in lines of the same kind,
  does this trigram stand at an unpunctuated end, and how often inside?  Trigrams seen too
  rarely are judged by their shape (numbers and capitalised words as classes).

Kinds of lines are list items (by source), short and longer single statements (texts of one
line, labelled answers) and running text.  In running text only a trigram that often stands
at an unpunctuated end (signatures, forms) may end a text without a stop; in the other kinds
an end is a cut if its trigram hardly ever ends anything, a prior that the sightings in
lines of its own kind correct.  The beginning of a word recurs at cuts, never inside, so the
longer words behind the same two count as sightings inside.  All counts run over all documents, equal texts once; everything is SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import small, stored, table
from .forms import consistent_form

#: Marks and notices that may follow a cut (fixed values).
NOTICES = (
    r"\[(?:\.\.\.|…)\]", "…", r"(?<!\.)\.\.\.(?=\s*\z)", r"\x{FFFD}", r"</?[a-z]+\s*/?>", "```[a-z]*", r"\"\}+",
    r"\((?:còn nữa|còn tiếp|hết trang|tiếp theo|xem tiếp|còn|hết|bị cắt|cắt bớt|lược bớt|continued|truncated|to be continued|cont\.?|more)[^()\n]{0,20}\)",
    r"\[(?:còn nữa|còn tiếp|hết trang|tiếp theo|xem tiếp|bị cắt|cắt bớt|lược bớt|continued|truncated|more)[^\[\]\n]{0,20}\]",
    r"(?:^|[\n….\s])[ \t]*(?:(?:tải|nhấn|bấm|đăng nhập|đăng ký|mời|vui lòng|click|download|log in|sign in)[^\n.!?]{0,40}[ \t])?(?:để[ \t]|to[ \t])?(?:đọc tiếp|xem tiếp|đọc thêm|xem thêm|xem toàn bộ|xem đầy đủ|xem bản đầy đủ|read more|see more|show more|continue reading)[.!\s]*\z",
    r"\n[ \t]*[-–—_*=~]{2,}[ \t]*(?=\s*\z)",
)
NOTICE = r"(?isu)(?:(?<!\s)\s++|" + "|".join(NOTICES) + r")+\z"
#: A line of nothing but notices, rules and blanks.
IDLE_LINE = r"(?isu)\A(?:(?<!\s)\s++|" + "|".join(NOTICES) + r"|\A[ \t]*[-–—_*=~]{2,}[ \t]*\z)*\z"
#: What a notice, rule or fence can end with (fixed values); a text that ends otherwise has none.
NOTICE_ENDS = ("]", "…", "\ufffd", ">", "`", "}", ")", "-", "–", "—", "_", "*", "=", "~", "...")
NOTICE_WORDS = ("tiếp", "thêm", "bộ", "đủ", "more", "reading")
#: What counts as a token of the statistics; numbers keep their separators.
TOKEN = r"\d+(?:[.,/:-]\d+)*(?![\p{L}\p{N}])|[\p{L}\p{N}]+"
#: A trigram is judged itself from this many sightings in other texts on, else by its shape.
SUPPORT = 4
#: Ends that are unpunctuated ends in less than this part of all sightings are cuts.
RARELY = 0.1
#: Numbers and abbreviations before a stop that are seldom an end: the stop belongs to them.
RARELY_STOPPED = 0.03

#: Most grams (8 bytes each) that are broadcast to drop the others before they are counted.
BROADCAST_GRAMS = 1_000_000
#: The same for what stands before an open end.
BROADCAST_CONTEXTS = 4_000_000

#: Words that cannot close even a short phrase (fixed values).
FUNCTION_WORDS = (
    "và của với cho thì là mà để từ theo tại trong khi nếu các những một được bị không vì do về đến tới ra vào lên "
    "bằng hay hoặc như đã sẽ đang có phải cần nên ở trên dưới giữa sau trước cùng rồi nhưng song còn bởi hỏi "
    "the a an of to in on at for and or by with from that which is are be shall must may"
).split()

#: A text without what follows its cut.  Only texts whose last characters can belong to a
#: notice are looked through: their idle last lines go, then the notices that close the line before.
_SQL_BODIES = """
with trimmed as (
  select doc_id, source, case when endswith(form, ' ') or endswith(form, '\\n') then rtrim(' \\n', form) else form end as t,
         contains(form, '�') and form rlike '�[^\\\\p{L}\\\\p{N}]*\\\\z' as broken
  from {forms}
), last as (
  select *, substring_index(substring_index(t, '\\n', -1), ' ', -1) as piece from trimmed
), marked as (
  select doc_id, source, t, broken, {ends} or contains(t, '```')
           or lower(case when endswith(piece, '.') or endswith(piece, '!') then case when ltrim('.!', piece) = '' then rtrim(' \\n.!', t) else rtrim('.!', piece) end else piece end) rlike '(?:{words})$' as noticed
  from last
), cut as (
  select *, case when noticed then split(regexp_replace(t, ' {2,}', ' '), '\\n') end as rows from marked
), kept as (
  select *, case when noticed then int(array_size(rows) + 1 - coalesce(nullif(array_position(transform(reverse(rows), x -> x rlike '{idle}'), false), 0), array_size(rows) + 1)) end as upto
  from cut
), stripped as (
  select doc_id, source, broken,
         case when not noticed then t
              when upto = 0 then ''
              else array_join(array_append(slice(rows, 1, upto - 1), regexp_replace(rows[upto - 1], '{notice}', '')), '\\n') end as raw
  from kept
)
select doc_id, source, broken,
       case when raw rlike '^[ \\n]' or endswith(raw, ' ') or endswith(raw, '\\n') then trim(both ' \\n' from raw) else raw end as body
from stripped
"""

#: What the form of a last line says of its end, by its last piece without blanks; the ends with
#: a question mark are left to the counts.
_SAID = """case when broken then 'character'
       when line rlike '^(?:[•*·▪◦►+–-]|[(]?[0-9]{1,3}[.)]|[a-zđ][)])$' or piece rlike '^(?:[0-9]{1,2}[.)]|[a-zđ][)])$' and line rlike '[.;:] +[^ ]+$'
            or piece rlike '^[0-9]+[.:)]?$' and line rlike '(?iu)(?:^|[.;] +)(?:điều|khoản|chương|mục|article|clause|section) [^ ]+$' then 'list mark'
       when piece rlike 'https?://[^.]*$' then 'link'
       when piece rlike '(?:https?://|www[.]).+$' then 'complete'
       when contains(line, '(') and not contains(substring_index(line, '(', -1), ')') then 'bracket'
       when piece rlike '[.]{3,}$|_{2,}$' then 'complete'
       when piece rlike '[,:;(/–-]["”’]?$' then 'sentence'
       when piece rlike '[!?。][)"”’»]*$' then 'complete'
       when piece rlike '^(?:[0-9][0-9.]*|[\\\\p{Lu}]{1,3})[.]$' then 'number?'
       when piece rlike '[.][)"”’»/]*[.]?$' then 'complete'
       else 'open?' end"""

#: The lines of a text with their kind and, where an end is left open, their tokens; {which} picks the last line or all.
_SQL_LINES = """
with each as (
  {which}
), marked as (
  select *, case when contains(line, ':') then line rlike '^(?iu:đáp|trả lời|answer|a)\\\\s*:' else false end as labelled,
         right(rtrim(')"”’»', substring_index(line, ' ', -1)), 1) in ('.', '!', '?', ':', ';', ',') as stopped
  from each
)
select *, case when left(line, 1) in ('•', '*', '·', '▪', '◦', '►', '+', '–', '-') then concat('item ', coalesce(source, ''))
              when (alone or labelled) and not line rlike '[.!?;] +[\\\\p{Lu}\\\\p{N}"]'
                then case when line rlike '^(?:[^ ]+ +){0,15}[^ ]+ *$' then 'short' else 'single' end
              else 'running' end as kind,
       case when said in ('open?', 'number?')
         then regexp_extract_all(case when labelled then regexp_replace(line, '^(?iu:đáp|trả lời|answer|a)\\\\s*:', '') else line end, '{token}', 0) end as tokens
from marked
"""
_LAST = f"""select *, {_SAID} as said
  from (select *, substring_index(line, ' ', -1) as piece from (select doc_id, source, broken, not contains(body, '\\n') as alone, trim(substring_index(body, '\\n', -1)) as line from {{docs}}))"""
_EVERY = """select source, alone, trim(row) as line, 'open?' as said
  from (select source, not contains(body, '\\n') as alone, explode_outer(split(body, '\\n')) as row from {docs} where first_copy) where trim(row) <> ''"""


def _at(i: str) -> tuple[str, str]:
    """SQL of the word and the shape of the i-th token (from 0): '^' before the line, classes for numbers.

    Tokens that begin with a small ASCII letter are words as they are; others in lower case.
    """
    token = f"get(tokens, {i})"
    number = f"case when translate({token}, '/:-', '') = {token} then '#' else 'D' end"
    word = f"case when {i} < 0 then '^' when {token} >= 'a' and {token} < '{{' then {token} when {token} >= ':' then lower({token}) else {number} end"
    shape = (
        f"case when {i} < 0 then '^' when {token} >= 'a' and {token} < '{{' then {token} "
        f"when {token} >= ':' then case when startswith({token}, lower(left({token}, 1))) then {token} else 'X' end else {number} end"
    )
    return word, shape


#: What stands before the last word, at the levels of words and shapes.
_WORD_BEFORE = "xxhash64('w', w2, w1)"
_SHAPE_BEFORE = "xxhash64('s', s2, s1)"
#: A gram is a hash of its level and its words: words and shapes of three, shapes of two.
_WORD_GRAM = f"xxhash64({_WORD_BEFORE}, w0)"
_SHAPE_GRAM = f"xxhash64({_SHAPE_BEFORE}, s0)"
_PAIR_GRAM = "xxhash64('b', s1, s0)"


def _three(i: str) -> str:
    """SQL of the words w0, w1, w2 and shapes s0, s1, s2 of the token at i and the two before it."""
    return ", ".join(f"{sql} as {name}{back}" for back in range(3) for name, sql in zip("ws", _at(f"({i} - {back})")))


#: The last line of each text: what its form says of the end, and the grams where that leaves it open.
_SQL_ENDS = f"""
with parts as (
  select *, {_three("(array_size(tokens) - 1)")} from {{lines}}
)
select doc_id, source, kind, stopped, said, array_size(tokens) as n_words, w0 as last_word,
  {_WORD_GRAM} as word_gram, {_SHAPE_GRAM} as shape_gram, {_PAIR_GRAM} as pair_gram,
  case when w0 >= ':' then xxhash64({_WORD_BEFORE}, left(w0, 1)) end as word_context, case when s0 = w0 and w0 >= ':' then xxhash64({_SHAPE_BEFORE}, left(s0, 1)) end as shape_context
from parts
"""

_KNOWN = "left join {contexts} w on w.context = word_before_1 left join {contexts} s on s.context = shape_before_1"
#: Sightings inside and at ends of lines, of the grams that leave an end open; the others are
#: dropped before anything is counted.  Behind what stands before such an end, a word is also a
#: ``longer`` sighting of each of its beginnings: a cut leaves a beginning that never stands inside.
_SQL_GRAMS = f"""
with tokens as (
  select kind, stopped, tokens, array_size(tokens) - 1 as last, i from {{lines}} lateral view outer posexplode(tokens) t as i, token
), three as (
  select kind, stopped, i = last as at_end, {_three("i")} from tokens where i is not null
), before as (
  select kind, stopped, at_end, w0, s0, {_PAIR_GRAM} as pair_gram, {_WORD_BEFORE} as word_before, {_SHAPE_BEFORE} as shape_before, length(w0) > 1 and w0 >= ':' as letters from three
), first as (
  select *, case when letters then xxhash64(word_before, left(w0, 1)) end as word_before_1, case when letters and s0 = w0 then xxhash64(shape_before, left(s0, 1)) end as shape_before_1 from before
), known as (
  select /*+ BROADCAST(w), BROADCAST(s) */ first.*, w.context is not null as begun, s.context is not null as shape_begun from first {_KNOWN}
), begun as (
  -- without functions of arrays, which would leave the compiled code; 0 is the word itself
  select known.*, n from known lateral view explode(sequence(0, case when begun or shape_begun then length(w0) - 1 else 0 end)) t as n
)
select kind, stopped, at_end, n > 0 as longer, gram
from begun lateral view explode(case when n = 0 then array(xxhash64(word_before, w0), xxhash64(shape_before, s0), pair_gram)
  else array(case when begun then xxhash64(word_before, left(w0, n)) end, case when shape_begun then xxhash64(shape_before, left(s0, n)) end) end) t as gram
where gram is not null
"""

_SQL_COUNTS = """
select kind, gram,
       count_if(not longer) as seen,
       count_if(at_end and not stopped and not longer) as open_ends,
       count_if(at_end and stopped and not longer) as closed_ends,
       count_if(longer) as longer
from {grams} group by kind, gram
"""

_SQL_JUDGE = """
with judged as (
  select e.*,
         coalesce(w.seen, 1) - 1 as w_seen, coalesce(w.open_ends, 0) - int(not e.stopped) as w_open, coalesce(w.closed_ends, 0) - int(e.stopped) as w_closed,
         coalesce(s.seen, 1) - 1 as s_seen, coalesce(s.open_ends, 0) - int(not e.stopped) as s_open, coalesce(s.closed_ends, 0) - int(e.stopped) as s_closed,
         coalesce(b.seen, 1) - 1 as b_seen, coalesce(b.open_ends, 0) - int(not e.stopped) as b_open,
         coalesce(p.seen, 1) - 1 as p_seen, coalesce(p.ends, 0) - 1 as p_ends,
         coalesce(w.longer, 0) as w_longer, coalesce(s.longer, 0) as s_longer, coalesce(p.longer, 0) as p_longer
  from {ends} e
  left join {counts} w on e.kind = w.kind and e.word_gram = w.gram
  left join {counts} s on e.kind = s.kind and e.shape_gram = s.gram
  left join {counts} b on e.kind = b.kind and e.pair_gram = b.gram
  left join {pooled} p on e.word_gram = p.gram
), beginnings as (
  -- outside running text names end lines, and one may begin another: only what hardly stands inside is a beginning
  select *, kind = 'running' or 10 * (p_seen - p_ends) <= p_longer as begun,
         case when last_word in ({function_words}) then 1 else 30 end as short_ends, case when last_word in ({function_words}) then 1 else 3 end as single_ends
  from judged
), sightings as (
  select *, w_seen + if(begun, w_longer, 0) as w_all, s_seen + if(begun, s_longer, 0) as s_all
  from beginnings
), rates as (
  select *,
         case when kind = 'running' then case when w_all >= {support} then w_open / w_all when s_all >= {support} then s_open / s_all / 3 else 0 end
              when begun and p_longer >= {support} then p_ends / (p_seen + p_longer)
              when n_words <= 6 and kind = 'short' and p_seen >= {support} and not last_word in ({function_words}) then 1
              when kind = 'short' and p_seen >= {support} then (w_open + 4 * p_ends / p_seen) / (w_seen + 4) * short_ends
              when p_seen >= {support} then (w_open + 4 * p_ends / p_seen) / (w_seen + 4) * single_ends
              when s_all >= {support} then s_open / s_all
              when b_seen >= {support} then b_open / b_seen
              when kind = 'short' and n_words <= 6 and not last_word in ({function_words}) then 1
              else 0 end as open_rate,
         case when w_seen >= {support} then w_closed / w_seen when s_seen >= {support} then s_closed / s_seen end as closed_rate
  from sightings
)
select doc_id, source, kind, open_rate, closed_rate, w_seen, s_seen,
  case when said = 'number?' and closed_rate < {rarely_stopped} then 'number'
       when said = 'open?' and open_rate < {rarely} then 'sentence or word' end as cut
from rates
"""


def _sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """The query over the given tables, whose names stand in braces in it."""
    names = {k: f"lexforge_{k}_{uuid.uuid4().hex}" for k in tables}
    for k, df in tables.items():
        df.createOrReplaceTempView(names[k])
        query = query.replace("{" + k + "}", names[k])
    result = spark.sql(query)
    for name in names.values():
        spark.catalog.dropTempView(name)
    return result


def _escaped(pattern: str) -> str:
    """The pattern as the inside of an SQL string."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _bodies(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(doc_id, source, broken, body) of (doc_id, source, form)."""
    ends = " or ".join(f"endswith(t, '{e}')" for e in NOTICE_ENDS)
    query = _SQL_BODIES.replace("{ends}", ends).replace("{words}", "|".join(NOTICE_WORDS)).replace("{idle}", _escaped(IDLE_LINE)).replace("{notice}", _escaped(NOTICE))
    return _sql(spark, query, forms=forms)


def cut_texts(docs: DataFrame, rarely: float = RARELY, consistent: bool = False) -> DataFrame:
    """Operator: docs (doc_id, text, source) -> one row per document with text, and ``cut``.

    ``cut`` says where the text stops (null: it is complete).  Null, empty and blank texts
    give no rows; equal texts are counted once and judged alike.  Only ends that their own
    form leaves open are looked up in the counts, so only their grams are counted, over all texts.
    ``consistent``: the texts are in their consistent form already.
    """
    spark = docs.sparkSession
    form = docs.where("text is not null").select("doc_id", "source", (F.col("text") if consistent else consistent_form(F.col("text"))).alias("form"))
    # what is left behind a stripped notice keeps its own last mark; a form of notices only counts as blank
    bodies = stored(_bodies(spark, form).where("body <> ''")).withColumn("text_key", F.xxhash64("body"))
    # only the repeated texts need a shuffle by document: which copies do not count
    first = bodies.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("text_key", "first")
    copies = stored(bodies.select("doc_id", "text_key").join(first, "text_key").where("doc_id <> first").select("doc_id", F.lit(False).alias("first_copy")))
    bodies = bodies.join(small(copies, copies.count()), "doc_id", "left").withColumn("first_copy", F.coalesce("first_copy", F.lit(True)))
    lines = _SQL_LINES.replace("{token}", _escaped(TOKEN))
    ends = stored(_sql(spark, _SQL_ENDS, lines=_sql(spark, lines.replace("{which}", _LAST), docs=bodies)))
    undecided = ends.where(F.col("said").isin("open?", "number?"))
    wanted = stored(undecided.select(F.explode(F.array("word_gram", "shape_gram", "pair_gram")).alias("gram")).distinct())
    contexts = stored(undecided.select(F.explode(F.array("word_context", "shape_context")).alias("context")).where("context is not null").distinct())
    sql = _SQL_GRAMS
    if contexts.count() > BROADCAST_CONTEXTS:  # beyond, the beginnings of all words are counted
        sql = sql.replace(_KNOWN, "left join (select 0L as context) w on word_before_1 is not null left join (select 0L as context) s on shape_before_1 is not null")
    grams = _sql(spark, sql, lines=_sql(spark, lines.replace("{which}", _EVERY), docs=bodies), contexts=contexts)
    if wanted.count() <= BROADCAST_GRAMS:  # beyond, all grams are counted
        grams = grams.join(F.broadcast(wanted), "gram", "left_semi")
    counts = stored(_sql(spark, _SQL_COUNTS, grams=grams))
    pooled = counts.groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum(F.col("open_ends") + F.col("closed_ends")).alias("ends"), F.sum("longer").alias("longer"))
    judge = _SQL_JUDGE.replace("{support}", str(SUPPORT)).replace("{rarely}", str(rarely)).replace("{rarely_stopped}", str(RARELY_STOPPED))
    judge = judge.replace("{function_words}", ", ".join(f"'{w}'" for w in FUNCTION_WORDS))
    judged = _sql(spark, judge, ends=undecided, counts=counts, pooled=pooled).select("doc_id", "source", "kind", "cut")
    said = F.when(F.col("said") != "complete", F.col("said")).alias("cut")
    return ends.where(~F.col("said").isin("open?", "number?")).select("doc_id", "source", "kind", said).unionByName(judged)


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "source")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_texts(_docs(spark, folder)).where("cut is not null").select("doc_id").distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents with text, cut ones, and the rate."""
    return (
        cut_texts(_docs(spark, folder))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count("cut").alias("n_cut"), (F.count("cut") / F.count(F.lit(1))).alias("rate"))
    )
