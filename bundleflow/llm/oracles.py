"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, SEPARATORS, template_words
from .secrets import BASE_RULES, MORE_RULES

ORACLES: dict[str, str] = {}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Gaps between matches and the matches themselves give the places.
ORACLES["op1_secret_scan"] = f"""
with rules(kind, ord, pat, grp, least) as (values {", ".join(
    f"({_quoted(r.kind)}, {i}, {_quoted(r.pattern)}, {r.group}, {r.least})"
    for i, r in enumerate(BASE_RULES + MORE_RULES))}),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
""" + ", ".join(f"""
m{i} as (
  select r, unnest(regexp_extract_all(t, {_quoted(x.pattern)}, 0)) as whole,
         unnest(regexp_extract_all(t, {_quoted(x.pattern)}, {x.group})) as part,
         unnest(regexp_split_to_array(t, {_quoted(x.pattern)})) as gap,
         generate_subscripts(regexp_split_to_array(t, {_quoted(x.pattern)}), 1) as n
  from d where regexp_matches(t, {_quoted(x.pattern)})),
p{i} as (
  select r, n, {_quoted(x.kind)} as kind, {i} as ord, length(whole) as len, length(part) as part_len,
         sum(length(gap) + coalesce(length(whole), 0)) over (partition by r order by n) as fin
  from m{i}),
s{i} as (select r, kind, ord, fin - len as s, fin as e from p{i} where len is not null and part_len >= {x.least})
""" for i, x in enumerate(BASE_RULES + MORE_RULES)) + """,
s as (""" + " union all ".join(f"select * from s{i}" for i in range(len(BASE_RULES + MORE_RULES))) + """),
f as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
         count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, ord) filter (ord < 3) as base,
         string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, ord) as spans
  from s group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
       coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join f using (r)
"""

_TEMPLATE_ROWS = ", ".join(
    f"({i}, {_quoted(label)}, {len(words)}, [{', '.join(_quoted(w) for w in sorted(set(words)))}], "
    f"[{', '.join(map(_quoted, must))}]::varchar[])" for i, (label, words, must) in enumerate(template_words()))
_TOUCH = "".join(f"""
  select r, i - 1 as place, {_quoted(label)} as label from w
  where {" and ".join(f"words[i + {k}] = {_quoted(p)}" if k else f"words[i] = {_quoted(p)}" for k, p in enumerate(phrase))}
  {"union all" if n + 1 < len(PHRASES) else ""}""" for n, (phrase, label) in enumerate(PHRASES))

ORACLES["op7_license_scan"] = f"""
with d as (select row_number() over () as r, doc_id, lower(coalesce(text, '')) as t from documents),
a as (select r, doc_id, list_filter(regexp_split_to_array(t, {_quoted(SEPARATORS)}), lambda x: x <> '') as words from d),
w as (select r, words, unnest(range(1, len(words) + 1)) as i from a),
base as ({_TOUCH}),
b as (
  select r, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as labels
  from base group by r),
templates(k, label, length, tw, must) as (values {_TEMPLATE_ROWS}),
near as (
  select r, k, label, length, tw, must, words from (select *, list_distinct(words) as have from a) cross join templates
  where len(list_intersect(have, tw)) >= ceil(0.8 * len(tw) - 1e-9)),
starts as (
  select r, label, length, tw, must, words, unnest(list_filter(range(0, len(words)), lambda i: list_contains(tw, words[i + 1]))) as i from near),
stretch as (
  select r, label, tw, must, list_distinct(words[least(i, greatest(len(words) - length, 0)) + 1:least(i, greatest(len(words) - length, 0)) + length]) as own
  from starts),
blocks as (select r, label, len(tw) as n, len(list_intersect(own, tw)) as common from stretch where len(list_intersect(own, must)) = len(must)),
more as (
  select r, list(distinct label) as more, max(common / n) as best
  from blocks where common >= ceil(0.8 * n - 1e-9) group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(array_to_string(list_sort(labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from a left join b using (r) left join more using (r)
"""

ORACLES["op8_chat_format"] = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (
  select *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') as text_out,
         replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') as role_out from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(role_out) + length(text_out) + 24)::bigint as formatted_chars
from e group by conv_id
"""

ORACLES["op9_warc"] = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when first_id is null or page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id is null or page_id <> first_id then first_id end as refers_to
from p left join f using (payload_digest)
"""

# CRC-32 of the decimal id, bit by bit.  Runs by brute force: all pairs of equal 16-word grams of a document (any run's
# match on its diagonal has 16 words), islands on the diagonals, and no stretch inside one of a smaller period.
ORACLES["op11_periodic_runs"] = """
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
         xor(list_reduce(list_concat([4294967295], flatten(list_transform(regexp_extract_all(doc_id::varchar, '.'),
               lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
             lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295) as h
  from documents),
p as (
  select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a, h // 10 as g from d),
t as (
  select r, doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i:
           w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) end as w
  from p),
grams as (
  select r, i, array_to_string(w[i + 1:i + 16], ' ') as gram from (select r, n, w, unnest(range(0, n - 15)) as i from t where n >= 16)),
pairs as (select a.r, a.i, b.i - a.i as q from grams a join grams b on a.r = b.r and a.gram = b.gram and a.i < b.i),
islands as (
  select r, q, min(i) as s, max(i) + 16 + q as e
  from (select *, i - row_number() over (partition by r, q order by i) as island from pairs) group by r, q, island),
long as (select * from islands where e - s >= greatest(24, 3 * q)),
runs as (
  select * from long where not exists (
    select 1 from islands o where o.r = long.r and o.q < long.q and o.s <= long.s and o.e >= long.e)),
lost as (select distinct r, unnest(range(s + q, e)) as i from runs),
places as (select r, w, unnest(range(0, n)) as i from t),
kept as (
  select r, string_agg(w[i + 1], ' ' order by i) as text from places anti join lost using (r, i) group by r),
best as (
  select r, first(s order by (e - s) / q desc, s, q) as s, first(e - s order by (e - s) / q desc, s, q) as length,
         first(q order by (e - s) / q desc, s, q) as q, count(*) as n_runs,
         string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' order by s, q) as lines
  from runs group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, length::bigint as length, q::bigint as period,
       (1000 * length // q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
       sha256(coalesce(text, '')) as collapsed_sha256
from t left join best using (r) left join kept using (r)
"""

ORACLES["op12_ranked_search"] = """
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
  from documents where text is not null),
items as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark),
whole as (select count(*) as big_n, sum(len(w))::bigint as big_l from d where len(w) > 0),
tf as (select r, doc_id, len(w) as n, term, count(*) as tf from (select r, doc_id, w, unnest(w) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
part as (
  select r, doc_id, term, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)))::bigint
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l)))) as impact
  from tf join df using (term), whole),
scores as (select item_id, r, doc_id, sum(impact)::bigint as score from items join part using (term) group by all),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last, r) as rank from scores where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10
"""

# All pairs of documents that share a shingle; reachability over the links.
ORACLES["op6_ngram_join"] = """
with recursive d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select r, doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))
                                       when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
t as (select r, len(s) as n, unnest(s) as g from s),
common as (select a.r as a, b.r as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
           from t a join t b on a.g = b.g and a.r <> b.r group by a.r, b.r),
link as (select a, b from common where 100 * c >= 75 * (na + nb - c)),
reach(r, x) as (select r, r from s union select reach.r, link.b from reach join link on link.a = reach.x),
least as (select reach.r, min(o.doc_id) as component_id from reach join s o on o.r = reach.x group by reach.r)
select doc_id, len(s)::bigint as n_shingles, component_id from s join least using (r)
"""
