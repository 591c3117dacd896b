"""SQL of the queries over words and turns: periodic runs and the conversation trie."""

#: Unsigned CRC-32 of the decimal id, bit by bit (0xEDB88320 is the fixed polynomial).
CRC = """list_reduce(list_transform(string_split(cast({id} as varchar), ''), lambda x: cast(ascii(x) as ubigint)),
    lambda r, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda b, y: xor(b >> 1, 3988292384 * (b & 1)), xor(r, x)), 4294967295::ubigint)"""


def crc(column: str) -> str:
    return f"cast(xor({CRC.format(id=column)}, 4294967295::ubigint) as bigint)"


PERIODIC_RUNS = rf"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, {crc("doc_id")} as h from documents
), placed as (
  select doc_id, w, len(w) as n, h, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a,
    case when h % 10 = 0 and len(w) > 0 then 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) end as p from split
), edited as (
  select doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: w[(case when i < a then i else a + (i - a) % p end) + 1]) end as w from placed
), single as (
  select doc_id, unnest(w) as word, unnest(range(0, n)) as i from edited
), alike as (
  select x.doc_id, x.i, y.i - x.i as q from single x join single y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i
), stretches as (
  select doc_id, q, min(i) as start, count(*) + q as length
  from (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from alike) group by doc_id, q, island
), runs as (
  select doc_id, start, length, min(q) as period from stretches where length >= 24 and length >= 3 * q group by doc_id, start, length
), best as (
  select *, row_number() over (partition by doc_id order by cast(length as double) / period desc, start, period) as place from runs
), listed as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by doc_id
), gone as (
  select distinct doc_id, unnest(range(start + period, start + length)) as i from runs
), collapsed as (
  select s.doc_id, string_agg(s.word, ' ' order by s.i) as t from single s anti join gone g on s.doc_id = g.doc_id and s.i = g.i group by s.doc_id
)
select e.doc_id, coalesce(l.n_runs, 0) as n_runs, b.start, b.length, b.period, 1000 * b.length // b.period as exponent_milli,
  sha256(coalesce(l.lines, '')) as runs_sha256, sha256(coalesce(c.t, '')) as collapsed_sha256
from edited e left join best b on b.doc_id = e.doc_id and b.place = 1 left join listed l on l.doc_id = e.doc_id left join collapsed c on c.doc_id = e.doc_id
"""

CONVERSATION_TRIE = f"""
with lines as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as pos
  from conversations where conv_id is not null
), convs as (
  select conv_id, conv_id - conv_id % 5 as source, {crc("conv_id")} % 9 as h from (select distinct conv_id from lines)
), heads as (
  select c.conv_id, l.pos as depth, l.role, l.text from convs c join lines l on l.conv_id = c.source and l.pos <= c.h
), taken as (
  select c.conv_id, c.h, count(h.depth) as n from convs c left join heads h on h.conv_id = c.conv_id group by c.conv_id, c.h
), turns as (
  select * from heads
  union all
  select l.conv_id, t.n + l.pos - t.h, l.role, l.text from lines l join taken t on t.conv_id = l.conv_id where l.pos > t.h
), listed as (
  select conv_id, list(sha256(octet_length(encode(role)) || ':' || role || text) order by depth) as said, list(octet_length(encode(text)) order by depth) as sizes, count(*) as n from turns group by conv_id
), whole as (
  select c.conv_id, coalesce(l.said, []) as said, coalesce(l.sizes, []) as sizes, coalesce(l.n, 0) as n from convs c left join listed l on l.conv_id = c.conv_id
), prefixes as (
  select conv_id, n, d as depth, said[1:d] as path, case when d > 0 then said[1:d - 1] end as before, case when d > 0 then sizes[d] else 0 end as size
  from (select *, unnest(range(0, n + 1)) as d from whole)
), nodes as (
  select path, any_value(before) as before, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(size) as saves,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = depth), '') as ends from prefixes group by path, depth
), children as (
  select before as path, count(*) as n_children from nodes where depth > 0 group by before
), below as (
  select top.path, sum(case when c.n_children is null then 1 else 0 end) as n_leaves, sum(n.saves) as saved
  from nodes n left join children c on c.path = n.path, lateral (select n.path[1:d] as path from (select unnest(range(0, n.depth + 1)) as d)) as top group by top.path
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, cast(b.n_leaves as bigint) as n_leaves,
  cast(b.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n left join nodes p on p.path = n.before left join children c on c.path = n.path join below b on b.path = n.path
"""
