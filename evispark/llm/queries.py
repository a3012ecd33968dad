"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from evispark.llm import bpe, coder, dialogue, exactdup, langid, linedup, packing, phrases, pii, sharding, shingles, tokencount, vectors
from evispark.llm.common import load, scratch_path, vocabulary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_language_id")
def op1(spark, sf_dir):
    return langid.identify(load(spark, sf_dir, "documents"))


SQL_OP2 = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
), ok as (
  select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b
  on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach(vec_id, other) as (
  select vec_id, vec_id from v union select r.vec_id, l.b from reach r join link l on r.other = l.a
), comp as (select vec_id, min(other) as component_id from reach group by vec_id),
deg as (select a, count(*) as n from link group by a)
select c.vec_id, coalesce(d.n, 0) as n_links, c.component_id, c.vec_id = c.component_id as kept
from comp c left join deg d on c.vec_id = d.a
"""


@query("op2_embedding_neardup", SQL_OP2)
def op2(spark, sf_dir):
    return vectors.link(load(spark, sf_dir, "embeddings"))


@query("op3_sharding")
def op3(spark, sf_dir):
    return sharding.shard_documents(load(spark, sf_dir, "documents"), 16)


@query("op4_bpe_trie")
def op4(spark, sf_dir):
    return bpe.digests(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


SQL_OP5 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh
  from w
), n as (select doc_id, len(sh) as n from s),
t as (select doc_id, md5(x) as x from (select doc_id, unnest(sh) as x from s)),
hits as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from t a join t b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2
), link as (
  select a, b from hits join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)
), edge as (select a, b from link union all select b, a from link),
reach(doc_id, other) as (
  select doc_id, doc_id from n union select r.doc_id, e.b from reach r join edge e on r.other = e.a
)
select n.doc_id, n.n as n_shingles, c.component_id
from n join (select doc_id, min(other) as component_id from reach group by doc_id) c on n.doc_id = c.doc_id
"""


@query("op5_shingle_join", SQL_OP5)
def op5(spark, sf_dir):
    return shingles.near_duplicates(load(spark, sf_dir, "documents"))


SQL_OP6 = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents
), g as (
  select text_sha256, count(*) as group_size, arg_min(doc_id, struct_pack(c := -chars, d := doc_id)) as keep_id from t group by 1
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""


@query("op6_exact_dedup", SQL_OP6)
def op6(spark, sf_dir):
    return exactdup.deduplicate(load(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    return packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


# The key is an example; a user passes a secret of their own.
KEY = "example key"


@query("op8_pii_pseudonyms")
def op8(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, KEY, count_col="n_values")


@query("op9_token_output")
def op9(spark, sf_dir):
    return coder.round_trip(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op10_line_dedup")
def op10(spark, sf_dir):
    return linedup.drop_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_removed")


@query("op11_token_counts")
def op11(spark, sf_dir):
    # The cache starts empty, so that every run does its own work.
    return tokencount.count_tokens(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), scratch_path(spark, "token-counts"))


# crc32 bit by bit; each round of the recursion reads one turn and keeps the
# cheapest edits for each letter put out last. An insertion (5) never pays: taking it and a neighbour out costs 2, or 4
# with the system turn, so the recursion has none.
SQL_OP12 = r"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations
), fate as (
  select *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(k) + 1), lambda i: [256 + ascii(substring(k, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: case when b >= 0 then xor(c, b - 256) when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295) % 20 as f from src
), damaged as (
  select conv_id, turn, case when f = 4 then 'user' else role end as role,
    case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when f = 3 then [1, 2] else [1] end) as copy
  from fate where f <> 0
), ranked as (
  select *, row_number() over w as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
    lag(left(role, 1)) over w as before, rtrim(text, E' \t\n\x0b\x0c\r') as kept
  from damaged window w as (partition by conv_id order by turn nulls first, role, text, copy)
), turns as (
  select conv_id, turn, role, text, i, left(role, 1) as initial, before || left(role, 1) as pair,
    case when kept = '' then 'blank' when again > 1 then 'duplicate' when right(kept, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from ranked
), stats as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from turns group by 1
), step(state, edit, role, cost, next) as (
  values ('', 'D', null, 2, ''), ('s', 'D', null, 2, 's'), ('u', 'D', null, 2, 'u'), ('a', 'D', null, 2, 'a'),
    ('', 'K', 's', 0, 's'), ('', 'K', 'u', 0, 'u'), ('', 'R', 'u', 1, 'u'), ('s', 'K', 'u', 0, 'u'), ('s', 'R', 'u', 1, 'u'),
    ('u', 'K', 'a', 0, 'a'), ('u', 'R', 'a', 1, 'a'), ('a', 'K', 'u', 0, 'u'), ('a', 'R', 'u', 1, 'u')
), walk as (
  select conv_id, cast(0 as bigint) as i, '' as state, cast(0 as bigint) as cost, '' as audit, cast([] as varchar[]) as out from stats
  union all
  select conv_id, i, state, cost, audit, out from (
    select w.conv_id, t.i, s.next as state, w.cost + s.cost + case when s.edit <> 'D' and t.fault = 'truncated' then 5 else 0 end as cost, w.audit || s.edit as audit,
      case when s.edit = 'D' then w.out when s.edit = 'K' then list_append(w.out, t.role || ':' || t.text)
        else list_append(w.out, case s.role when 'u' then 'user:' else 'assistant:' end || t.text) end as out
    from walk w join turns t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1 join step s on s.state = w.state
    where s.edit = 'D' or (t.fault not in ('blank', 'duplicate') and ((s.edit = 'K' and t.initial = s.role) or (s.edit = 'R' and t.initial <> s.role)))
  ) qualify row_number() over (partition by conv_id, state order by cost, audit) = 1
), best as (
  select w.conv_id, w.cost, w.audit, array_to_string(w.out, chr(10)) as repaired from walk w join stats s on w.conv_id is not distinct from s.conv_id and w.i = s.n
  where w.state in ('', 'a') qualify row_number() over (partition by w.conv_id order by w.cost, w.audit) = 1
)
select c.conv_id, coalesce(s.gaps, 0) as gaps, coalesce(s.blank, 0) as blank, coalesce(s.duplicate, 0) as duplicate, coalesce(s.truncated, 0) as truncated,
  coalesce(s.illegal, 0) as illegal, coalesce(b.cost, 0) as cost, coalesce(b.audit, '') as audit, sha256(coalesce(b.repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join stats s on c.conv_id is not distinct from s.conv_id left join best b on c.conv_id is not distinct from b.conv_id
"""


@query("op12_dialogue_repair", SQL_OP12)
def op12(spark, sf_dir):
    return dialogue.repair_damaged(load(spark, sf_dir, "conversations"))


SQL_OP13 = r"""
with piece as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws from documents
), gram as (
  select lang, m, list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' ')) as g from piece, range(1, 6) t(m)
), f as (
  select lang, phrase, any_value(m) as m, count(*) as n from (select lang, m, unnest(g) as phrase from gram) group by lang, phrase
), total as (select lang, sum(n) as n from f where m = 1 group by 1),
candidate as (select lang, phrase, m, n, string_split(phrase, ' ') as ws from f where m > 1 and n >= 100),
cut as (
  select c.lang, c.phrase, c.n as a, k, array_to_string(c.ws[1:k], ' ') as x, array_to_string(c.ws[k + 1:], ' ') as y from candidate c, range(1, 5) t(k) where k < c.m
), scored as (
  select cut.lang, cut.phrase, cut.a, k, l.n as l, r.n as r, total.n as n, (1000 * cut.a::hugeint * total.n::hugeint) // (l.n::hugeint * r.n::hugeint) as score
  from cut join f l on l.lang = cut.lang and l.phrase = x join f r on r.lang = cut.lang and r.phrase = y join total on total.lang = cut.lang
), best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, array_to_string(ws[i:i + s - 1], ' ') as phrase, max(n) as longer from candidate, range(1, 5) t(i), range(2, 5) u(s) where s < m and i + s - 1 <= m group by 1, 2
)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from (
  select best.*, row_number() over (partition by best.lang order by score desc, a desc, encode(best.phrase)) as rank
  from best left join inside on inside.lang = best.lang and inside.phrase = best.phrase where longer is null or 100 * longer < 100 * a
) where rank <= 2000
"""


@query("op13_phrase_collocations", SQL_OP13)
def op13(spark, sf_dir):
    return phrases.collocations(load(spark, sf_dir, "documents"), top=2000).drop("doc_id", "at")
