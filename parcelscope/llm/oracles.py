r"""DuckDB texts of the operators that SQL can express over whole tables."""

from __future__ import annotations

#: Distinct prefixes by grouping every (conversation, depth), subtrees by the prefixes of each node's smallest member.
PREFIX_TRIE = """
with recursive told as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos,
         sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as id, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
ids as (select distinct conv_id from told),
-- crc32 by bits: eight steps a byte
crc as (
  select conv_id, conv_id::varchar as s, 0 as step, 4294967295::bigint as v from ids
  union all
  select conv_id, s, step + 1,
         case when (case when step % 8 = 0 then xor(v, ascii(substr(s, step // 8 + 1, 1))::bigint) else v end) & 1 = 1
              then xor((case when step % 8 = 0 then xor(v, ascii(substr(s, step // 8 + 1, 1))::bigint) else v end) >> 1, 3988292384::bigint)
              else (case when step % 8 = 0 then xor(v, ascii(substr(s, step // 8 + 1, 1))::bigint) else v end) >> 1 end
  from crc where step < 8 * length(s)),
heads as (select conv_id, xor(v, 4294967295::bigint) % 6 as h, conv_id - conv_id % 100 as base from crc where step = 8 * length(s)),
parts as (
  select h.conv_id, 0 as part, t.pos, t.id, t.chars from heads h join told t on t.conv_id = h.base and t.pos <= h.h
  union all
  select h.conv_id, 1, t.pos, t.id, t.chars from heads h join told t on t.conv_id = h.conv_id and t.pos > h.h),
rebuilt as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, id, chars from parts),
steps as (
  select conv_id, 0::bigint as depth, '' as k, 0::bigint as chars from ids
  union all
  select conv_id, depth, md5(string_agg(id, '' order by depth) over (partition by conv_id order by depth)), chars from rebuilt),
deepest as (select conv_id, max(depth) as depth from steps group by conv_id),
plain as (
  select s.k, s.depth, min(s.conv_id) as conv_id, count(*) as n_convs, max(s.chars) as chars,
         string_agg(s.conv_id::varchar, ',' order by s.conv_id) filter (where d.depth = s.depth) as ends
  from steps s join deepest d on d.conv_id = s.conv_id group by s.k, s.depth),
above as (
  select p.*, u.k as up from plain p left join steps u on u.conv_id = p.conv_id and u.depth = p.depth - 1),
children as (select up as k, count(*) as n from above where up is not null group by up),
own as (select a.*, coalesce(c.n, 0) as n_children, case when c.n is null then 1 else 0 end as leaf, (a.n_convs - 1) * a.chars as saved from above a left join children c on c.k = a.k),
sums as (select s.k, sum(o.leaf) as n_leaves, sum(o.saved) as saved from own o join steps s on s.conv_id = o.conv_id and s.depth <= o.depth group by s.k)
select o.conv_id::bigint as conv_id, o.depth::bigint as depth, p.conv_id::bigint as parent_conv_id, o.n_convs::bigint as n_convs, o.n_children::bigint as n_children,
       s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(o.ends, '')) as ends_sha256
from own o join sums s on s.k = o.k left join own p on p.k = o.up
"""

FILL_IN_MIDDLE = r"""
with given as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as x,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units from documents),
seeded as (
  select *, len(units)::bigint as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from given),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from seeded),
pieces as (
  select *, array_to_string(list_slice(units, 1, a), '') as p, array_to_string(list_slice(units, a + 1, b), '') as m, array_to_string(list_slice(units, b + 1, n), '') as s from cuts)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from pieces
"""

LINE_DEDUP = """
with given as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
listed as (select doc_id, r, string_split(t, chr(10)) as lines from given),
lines as (select doc_id, r, unnest(lines) as line, generate_subscripts(lines, 1) as i from listed),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
common as (select k, max(doc_id) as keep from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select l.*, (c.k is not null and l.doc_id <> c.keep) as lost from keyed l left join common c on c.k = l.k)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256
from marked group by r
"""
