"""The operator queries over their whole tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.llm import (
    byte_bpe,
    conversation_repair,
    decontaminate,
    html_extract,
    jaccard_join,
    language_id,
    lexical_search,
    line_dedup,
    quality_gbt,
    quality_rules,
    sampling,
    secret_scan,
    toxicity,
    url_filter,
)

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rank_file(folder: str = TOKENIZERS, name: str = RANK_FILE) -> str:
    """Place of a public rank file; the folder is a parameter and nothing is copied from it."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(folder, name)
    return public_tokenizers.path(name)


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    sample = sampling.labelled(docs, _read(spark, sf_dir, "labels"), "quality", "doc_id", "text", 5, 0, quality_gbt.SAMPLE_ROWS_EACH)
    scored = quality_gbt.classify(docs, quality_gbt.train(sample))
    return scored.select("doc_id", (sampling.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    done = line_dedup.drop_lines(docs, count_as="n_dropped")
    return done.select("doc_id", "source", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_read(spark, sf_dir, "documents"), n=4, percent=85)


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(_read(spark, sf_dir, "documents"), rank_file())


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    sample = sampling.labelled(docs, _read(spark, sf_dir, "labels"), "toxic", "doc_id", "text", 3, 1, toxicity.SAMPLE_ROWS_EACH)
    scored = toxicity.score(docs, toxicity.train(sample))
    return scored.select("doc_id", (sampling.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
                         F.size("passages").cast("long").alias("n_passages"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.mark(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = docs.filter(F.col("lang").isNotNull() & (sampling.remainder("doc_id", 4) != 2) & F.col("doc_id").isNotNull())
    model = language_id.train(sampling.bounded(known, "doc_id", "lang", language_id.SAMPLE_ROWS_EACH), "text", "lang")
    named = language_id.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (sampling.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs)))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return conversation_repair.digest(rows, conversation_repair.repair(conversation_repair.damage(rows)))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op3_quality_rules"] = r"""
with d as (
  select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
w as (
  select doc_id, r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) as upper_chars, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as letters from d),
ln as (
  select r, sum(n - 1) as n_dup_lines from (
    select r, l, count(*) as n from (select r, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r, l)
  group by r),
tok as (
  select r, unnest(ws) as x, generate_subscripts(ws, 1) as i from w),
tri as (
  select r, i, x, lead(x) over o as y, lead(x, 2) over o as z, lag(x) over o as p from tok window o as (partition by r order by i)),
rep as (
  select r, i, count(*) over (partition by r, x, y, z) as n from tri where z is not null),
hit as (
  select r, count(distinct j) as n_repeat_words from (
    select r, unnest([i, i + 1, i + 2]) as j from rep where n > 1) group by r),
per as (
  select r, sum(length(x)) as word_chars, count_if(regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]')) as lettered, count_if(x = p) as doubled from tri group by r),
s as (
  select w.doc_id, len(w.ws)::bigint as n_words, coalesce(per.word_chars, 0)::bigint as word_chars, w.n_symbols::bigint as n_symbols,
         coalesce(ln.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(hit.n_repeat_words, 0)::bigint as n_repeat_words,
         w.upper_chars, w.letters, coalesce(per.lettered, 0) as lettered, coalesce(per.doubled, 0) as doubled
  from w left join ln using (r) left join hit using (r) left join per using (r)),
b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 2 * n_words <= word_chars and word_chars <= 20 * n_words and 10 * n_symbols <= word_chars
       and 20 * n_dup_lines <= n_words and 2 * upper_chars <= letters and 10 * lettered >= 7 * n_words and 10 * doubled <= 3 * n_words as kept
from b
"""

#: Lines with their place, and the lines of a host over the ratio (as ``line_dedup`` defines them).
_LINES = r"""
d as (
  select doc_id, source, text, row_number() over () as r from documents),
l as (
  select r, source, text, whole, line, i from (
    select r, source, text, unnest(string_split(text, chr(10))) as whole, generate_subscripts(string_split(text, chr(10)), 1) as i,
           regexp_replace(unnest(string_split(text, chr(10))), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from d)),
h as (
  select source, count(distinct coalesce(text, '')) as pages from d group by source),
bad as (
  select s.source, s.line from (select source, line, count(distinct text) as n from l where line <> '' group by source, line) s
  join h on s.source is not distinct from h.source where s.n >= 3 and s.n > 0.1 * h.pages),
m as (
  select l.*, bad.line is not null as drop_it from l left join bad on l.source is not distinct from bad.source and l.line = bad.line),
done as (
  select r, string_agg(whole, chr(10) order by i) filter (where not drop_it) as text, count_if(drop_it) as n_dropped from m group by r)"""

ORACLE["op5_line_dedup"] = f"""
with {_LINES}
select d.doc_id, d.source, coalesce(done.n_dropped, 0)::bigint as n_dropped, length(case when d.text is null then null else coalesce(done.text, '') end)::bigint as n_chars_left,
       sha256(case when d.text is null then null else coalesce(done.text, '') end) as text_sha256
from d left join done using (r)
"""

ORACLE["op9_decontamination"] = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select coalesce(item_id::varchar, 'null') as item, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
g as (
  select distinct item, least(10, len(ws)) as n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') as gram from (
    select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as s from b where len(ws) > 0)),
sizes as (
  select distinct n from g),
x as (
  select r, s, n, array_to_string(ws[s:s + n - 1], ' ') as gram from (
    select r, ws, n, unnest(range(1, len(ws) - n + 2)) as s from d, sizes where len(ws) >= n)),
hit as (
  select x.r, x.s, x.n, g.item from x join g on x.n = g.n and x.gram = g.gram),
words as (
  select r, count(distinct w) as n_hit from (select r, unnest(range(s, s + n)) as w from hit) group by r),
items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by r)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(words.n_hit, 0)::bigint as n_hit, coalesce(items.n_items, 0)::bigint as n_items,
       sha256(coalesce(items.ids, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
""".replace("LOWERED", _LOWER)

ORACLE["op11_lexical_search"] = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, row_number() over () as k, unnest(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark),
s as (
  select count(*) as docs, sum(len(ws))::bigint as terms from d where len(ws) > 0),
tf as (
  select r, term, count(*) as tf from (select r, unnest(ws) as term from d) group by r, term),
w as (
  select term, floor(1000 * ln((2 * s.docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, s group by term, s.docs),
m as (
  select r, doc_id, 100 - 75 + ((75 * len(ws) * s.docs) // s.terms) as m from d, s where len(ws) > 0),
x as (
  select b.k, b.item_id, m.doc_id, m.r, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::bigint as score
  from b join tf using (term) join w using (term) join m using (r) group by all),
ranked as (
  select *, row_number() over (partition by k order by score desc, doc_id nulls last) as rank from x where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
""".replace("LOWERED", _LOWER)

ORACLE["op13_conversation_repair"] = r"""
with recursive
k as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
d as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, row_number() over () as r,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)),
                         lambda a, x: xor(a >> 8, k.t[(xor(a, x) & 255) + 1])), 4294967295) % 20 as act
  from conversations, k),
e as (
  select conv_id, turn, case when act = 4 then 'user' else role end as role,
         case when act = 1 then '' when act = 2 then translate(text, '.!?', '') else text end as text, unnest(case when act = 3 then [1, 2] else [1] end) as copy
  from d where act <> 0),
o as (
  select dense_rank() over (order by conv_id nulls first) as g, *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from e),
f as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by g, role, text order by i) > 1 then 2
                 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 3 else 0 end as fault,
         lag(role[1]) over (partition by g order by i) || role[1] as pair
  from o),
n as (
  select g, any_value(conv_id) as conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 1) as blank, count_if(fault = 2) as duplicate,
         count_if(fault = 3) as truncated, count_if(pair not in ('su', 'ua', 'au')) as illegal
  from f group by g),
walk as (
  select g, 0::bigint as i, [{c: 0::bigint, a: '', s: 0, t: ''}] as l from n
  union all
  select g, i, list_filter(list_transform([0, 1, 2, 3], lambda s: list_min(list_filter(x, lambda y: y.s = s))), lambda y: y is not null) as l from (
    select g, i, list_concat(
        list_transform(l3, lambda y: {c: y.c + 2, a: y.a || 'D', s: y.s, t: y.t}),
        case when fault in (1, 2) then [] else list_concat(
          list_transform(l3, lambda y: {c: y.c + 1 + late, a: y.a || 'R', s: case when y.s = 2 then 3 else 2 end,
                                        t: y.t || case when y.t = '' then '' else chr(10) end || case when y.s = 2 then 'assistant:' else 'user:' end || text}),
          list_transform(list_filter(l3, lambda y: (y.s = 0 and role[1] = 's') or (y.s <> 2 and role[1] = 'u') or (y.s = 2 and role[1] = 'a')),
                         lambda y: {c: y.c + late, a: y.a || 'K', s: case role[1] when 's' then 1 when 'u' then 2 else 3 end,
                                    t: y.t || case when y.t = '' then '' else chr(10) end || role || ':' || text})) end) as x
    from (
      select g, i, fault, role, text, case when fault = 3 then 5 else 0 end as late, list_concat(l2, list_transform(l1, INS)) as l3 from (
        select *, list_concat(l, l1) as l2 from (
          select walk.g, walk.i + 1 as i, f.fault, f.role, f.text, walk.l, list_transform(walk.l, INS) as l1 from walk join f on f.g = walk.g and f.i = walk.i + 1))))),
done as (
  select n.*, list_min(list_filter(list_concat(l, list_transform(l, INS), list_transform(list_transform(l, INS), INS)), lambda y: y.s in (0, 3))) as b
  from n join walk on walk.g = n.g and walk.i = n.n)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(b.t, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join done on done.conv_id is not distinct from c.conv_id
""".replace("INS", "lambda z: {c: z.c + 5, a: z.a || 'I', s: case when z.s = 2 then 3 else 2 end, t: z.t || case when z.t = '' then '' else chr(10) end || case when z.s = 2 then 'assistant:' else 'user:' end}")
