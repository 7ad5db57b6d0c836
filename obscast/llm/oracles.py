"""DuckDB SQL of the operators' queries that SQL can state."""

from __future__ import annotations

from obscast.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, SYMBOLS

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STOP = ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS for w in line.split()}))


def _rule(num: str, den: str, low: int | None, high: int | None) -> str:
    parts = [f"{num} * 1000 >= {den} * {low}"] if low is not None else []
    parts += [f"{num} * 1000 <= {den} * {high}"] if high is not None else []
    return " and ".join(parts)


def _blank(x: str) -> str:
    return f"translate({x}, {_WS}, '')"


OP1 = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i : i + 2], ' '))) end as s from w),
t as materialized (select doc_id, len(s) as n, unnest(s) as g from s),
o as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as c from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from o where 100 * c >= 90 * (n + m - c)),
e as materialized (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as root from s union select e.b, r.root from r join e on e.a = r.node where r.root < e.b)
select s.doc_id, len(s)::bigint as n_shingles, min(r.root) as component_id from s join r on r.node = s.doc_id group by 1, 2"""

OP3 = f"""
with l as materialized (select doc_id, i, ls[i] as line, translate(trim(ls[i], {_WS}), {_AZ}) as key from
  (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), unnest(range(1, len(ls) + 1)) t(i)),
k as (select key, max(doc_id) as top from l where length(key) >= 20 group by 1 having count(distinct doc_id) >= 3),
m as (select l.*, k.top is not null and l.doc_id <> k.top as gone from l left join k using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by 1"""

OP6 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select payload_digest, max(page_id) as top from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest, case when top <> page_id then 'revisit' else 'response' end as record_type,
  case when top <> page_id then top end as refers_to from p left join g using (payload_digest)"""

OP8 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, v.t, v.r, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
f as (select *, replace(replace(role, '\', '\\'), '<|', '<\|') as r, replace(replace(text, '\', '\\'), '<|', '<\|') as x from c),
a as (select conv_id, count(*)::bigint as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
  coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
  sum(length('<|im_start|>' || replace(r, chr(10), '\n') || chr(10) || x || '<|im_end|>' || chr(10)))::bigint as formatted_chars from f group by 1)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from a"""

OP9 = rf"""
with b as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: length({_blank("x")}) > 0) as l from b),
g as materialized (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from
  (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from w, unnest(range(1, greatest(1, len(w) - 1))) t(i))),
r as (select doc_id, count(distinct i + d) as n_repeat_words from g, (values (0), (1), (2)) v(d) where n > 1 group by 1),
s as (select w.doc_id, len(w)::bigint as n_words, length({_blank("text")})::bigint as word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({_STOP}))) as n_stop_words, len(l) as n_lines,
  len(list_filter(l, lambda x: rtrim(x, ' ') like '%...' or rtrim(x, ' ') like '%…')) as n_ellipsis_lines,
  len(list_filter(l, lambda x: left(ltrim(x, ' '), 1) in ('-', '*', '•'))) as n_bullet_lines from w left join r using (doc_id)),
v as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(_rule(*rule[1:]) for rule in RULES)} as kept from v"""


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: unicode(c)::bigint)),
  lambda r, b: list_reduce(list_concat([xor(r, b)], list_transform(range(8), lambda i: 0::bigint)), lambda c, z: xor(c >> 1, (c & 1) * 3988292384::bigint))), 4294967295::bigint)"""

OP11 = f"""
with recursive leaf as materialized (select row_number() over () as k, doc_id, coalesce('=' || lang, '') as grp, {_LEAF.format(n="n_chars")} as leaf,
  case when {_CRC} % 7 = 0 then {_LEAF.format(n="(n_chars + 1)")} else {_LEAF.format(n="n_chars")} end as mine,
  row_number() over (partition by lang order by doc_id, {_LEAF.format(n="n_chars")}) - 1 as pos, count(*) over (partition by lang) as n from documents),
tree as (select grp, 0 as lvl, pos, leaf as h, n from leaf
  union all select grp, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from tree where n > 1 group by grp, lvl, pos // 2),
nodes as materialized (select * from tree),
sub as materialized (select grp, h as subroot, lvl as height, row_number() over (order by grp) - 1 as pos, count(*) over () as n from nodes where n = 1),
over as (select 0 as lvl, pos, subroot as h, n from sub union all select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from over where n > 1 group by lvl, pos // 2),
tops as materialized (select * from over),
low as materialized (select l.k, v.lvl as step, l.pos >> v.lvl as spot, o.h as other from leaf l join sub using (grp), unnest(range(sub.height)) v(lvl)
  left join nodes o on o.grp = l.grp and o.lvl = v.lvl and o.pos = xor(l.pos >> v.lvl, 1)),
high as materialized (select l.k, sub.height + v.lvl as step, sub.pos >> v.lvl as spot, o.h as other from leaf l join sub using (grp), unnest(range((select max(lvl) from tops))) v(lvl)
  left join tops o on o.lvl = v.lvl and o.pos = xor(sub.pos >> v.lvl, 1)),
path as materialized (select * from low union all select * from high),
fold as (select k, 0::bigint as step, mine as h from leaf
  union all select k, step + 1, sha256(case when other is null then h when spot % 2 = 1 then other || h else h || other end) from fold join path using (k, step)),
last as (select k, arg_max(h, step) as folded_root from fold group by k),
proof as (select k, sha256(coalesce(string_agg(other, '' order by step), '')) as proof_sha256 from leaf left join path using (k) group by k)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
from leaf join sub using (grp) join last using (k) join proof using (k), (select h as root from tops where n = 1)"""

OP12 = """
with recursive v as materialized (select row_number() over () as k, vec_id, embedding::double[] as e,
  embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as usable from embeddings),
l as materialized (select a.k as a, b.k as b, b.vec_id as other from v a join v b on a.k <> b.k and a.usable and b.usable and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select k, vec_id as low from v union select l.b, r.low from r join l on l.a = r.k join v on v.k = l.b where r.low < v.vec_id),
n as (select a as k, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, min(low) as component_id, vec_id = min(low) as kept from v join r using (k) left join n using (k) group by k, vec_id, n.n"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1,
    "op3_line_dedup": OP3,
    "op6_warc_revisits": OP6,
    "op8_chat_trees": OP8,
    "op9_quality_rules": OP9,
    "op11_merkle_manifest": OP11,
    "op12_vector_links": OP12,
}
