"""DuckDB SQL for the operators that SQL can express, over whole tables; written apart from the operators' code."""

from __future__ import annotations

from .quality import BOILERPLATE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"


MINHASH = f"""
with recursive d as (
  select doc_id, {_words(_low("coalesce(text, '')"))} as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [md5(array_to_string(w, ' '))]
    else [md5(array_to_string(w[i:i + 4], ' ')) for i in range(1, len(w) - 3)] end) as sh from d
), n as (
  select doc_id, count(*) as n from s group by 1
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), e as (
  select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)
), pairs2 as (
  select x, y from e union select y, x from e
), r(x, y) as (
  select x, y from pairs2 union select r.x, pairs2.y from r join pairs2 on pairs2.x = r.y
), m as (
  select x, least(x, min(y)) as component_id from r group by 1
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.component_id, d.doc_id) as component_id, coalesce(m.component_id, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join m on m.x = d.doc_id
"""

CHAT = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, length(regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g')) as n_text, length(regexp_replace(role, '(\\|###|</turn>|:|' || chr(10) || ')', 'x\1', 'g')) as n_role,
    lag(role, 1, '') over (partition by conv_id order by turn) as before from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(4 + n_role + 2 + n_text + 9)::bigint as formatted_chars,
  bool_and((before = '' and role in ('system', 'user')) or (before in ('system', 'assistant') and role = 'user') or (before = 'user' and role = 'assistant')) as valid
from e group by conv_id
"""

_QUALITY_LINE = r"""
  not regexp_matches(line, '[.!?:;"'')\]…”’»。！？](?:[\x09-\x0D\x20]|$)')
  or 10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > n
  or (n >= 5 and 5 * length(regexp_replace(line, '[^A-Z]', '', 'g')) > 3 * length(regexp_replace(line, '[^A-Za-z]', '', 'g')))
  or (dividers >= 2 and 10 * dividers >= n)
"""
QUALITY = rf"""
with d as (
  select doc_id, text as raw, coalesce(text, '') as text, {_words("coalesce(text, '')")} as w from documents
), l as (
  select doc_id, line, no, {_words("line")} as lw from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from d)
), m as (
  select *, len(lw) as n, len(list_filter(lw, lambda x: x in ('|', '>', '»', '•', '·', '-'))) as dividers, row_number() over (partition by doc_id, line order by no) as nth from l where len(lw) > 0
), f as (
  select *, ({_QUALITY_LINE} or {" or ".join(f"contains({_low('line')}, '{_quoted(b.decode())}')" for b in BOILERPLATE)}) as failed from m
), per as (
  select doc_id, count_if(nth > 1)::bigint as n_dup_lines, coalesce(sum(n) filter (where failed), 0)::bigint as n_lost_words, count_if(failed)::bigint as n_failed_lines from f group by 1
), rest as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.no) as cleaned from l left join f on f.doc_id = l.doc_id and f.no = l.no where not coalesce(f.failed, false) group by 1
), t as (
  select doc_id, i, md5(array_to_string(w[i:i + 2], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d where len(w) >= 3)
), twice as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, h) as c from t) where c > 1
), rep as (
  select doc_id, count(distinct i + k)::bigint as n_repeat_words from twice cross join (values (0), (1), (2)) as o(k) group by 1
), j as (
  select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lost_words, 0) as n_lost_words, coalesce(n_failed_lines, 0) as n_failed_lines,
    case when raw is not null then sha256(coalesce(cleaned, '')) end as clean_sha256
  from d left join per using (doc_id) left join rep using (doc_id) left join rest using (doc_id)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_lost_words <= 0.3 * n_words as kept from j
"""

TOPK = """
with v as materialized (
  select row_number() over () as row_no, vec_id, [floor(256 * x::double)::bigint for x in embedding] as q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), p as (
  select a.row_no, a.vec_id as query_id, b.vec_id, list_inner_product(a.q::double[], b.q::double[])::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.row_no <> b.row_no and len(a.q) = len(b.q)
), r as (
  select *, row_number() over (partition by row_no order by score desc, vec_id) as rank from p
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

LINES = rf"""
with l as (
  select doc_id, no, line, {_words(_low("line"))} as w from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents)
), c as (
  select array_to_string(w, ' ') as k, any_value(w) as w, min((doc_id, no)) as first from l where len(w) >= 1 group by 1
), v as (
  select k, first, 0 as pos, hash(k) as h from c where len(w) >= 8
  union all select k, first, i, hash(array_to_string(w[:i - 1] || w[i + 1:], ' ')) from (select k, first, w, unnest(range(1, len(w) + 1)) as i from c where len(w) >= 8)
), near as (
  select distinct b.k from v a join v b on a.h = b.h and a.first < b.first and (a.pos = b.pos or a.pos = 0 or b.pos = 0)
), x as (
  select l.*, len(l.w) >= 1 and ((l.doc_id, l.no) > c.first or near.k is not null) as gone from l left join c on len(l.w) >= 1 and c.k = array_to_string(l.w, ' ') left join near on near.k = c.k
), t as (
  select doc_id, count(*)::int as n_lines, count_if(coalesce(gone, false))::int as n_dropped, coalesce(string_agg(line, chr(10) order by no) filter (where not coalesce(gone, false)), '') as kept from x group by 1
)
select d.doc_id, coalesce(n_lines, 0)::int as n_lines, coalesce(n_dropped, 0)::int as n_dropped, coalesce(n_dropped > 0 and not regexp_matches(kept, '[^\x20\x09-\x0D]'), false) as emptied,
  case when d.text is not null then sha256(coalesce(kept, '')) end as text_sha256 from documents d left join t using (doc_id)
"""
