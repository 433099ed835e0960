"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from .decontam import op8_decontamination
from .dialogue import op13_dialogue
from .exact import op12_exact
from .langid import op3_langid
from .lm import op4_lm
from .media import op2_media
from .mixing import op1_mixing
from .pii import op9_pii
from .quality import op6_quality
from .resampling import op11_resampling
from .simhash import op10_simhash
from .toxicity import op7_toxicity
from .warc import op5_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_media": op2_media,
    "op3_langid": op3_langid,
    "op4_lm": op4_lm,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_simhash": op10_simhash,
    "op11_resampling": op11_resampling,
    "op12_exact": op12_exact,
    "op13_dialogue": op13_dialogue,
}

#: What a page's record must be can be said in SQL, whatever archives lie between.
_OP5 = """
with p as (
  select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when first_id is not null and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when first_id is not null and page_id <> first_id then first_id end as refers_to
from f
"""

#: The row that stays is the first of its group; which of wholly equal rows it is does not show.
_OP12 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents
), g as (
  select *, count(*) over (partition by text_sha256) as group_size,
         row_number() over (partition by text_sha256 order by points desc, doc_id nulls last) as place,
         first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id nulls last) as keep_id
  from d
)
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from g
"""

#: CRC-32 by its polynomial: a table by byte, and a fold over the bytes of ``{text}``.
_CRC_TABLE = """
tab as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)
)
"""
_CRC = """
xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(octet_length(encode({text}))), lambda i: cast('0x' || substr(hex(encode({text})), 2 * i + 1, 2) as bigint))),
                lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)
"""

#: Every feature in full, hashed once per distinct text.
_OP11 = f"""
with {_CRC_TABLE}, texts as (
  select true as doc, doc_id, row_number() over () as n, coalesce(text, '') as text from documents union all select false, null, -row_number() over (), coalesce(text, '') from benchmark
), words as (
  select doc, n, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts
), features as (
  select doc, n, unnest(list_transform(range(len(w)), lambda i: w[i + 1])) as f from words
  union all select doc, n, unnest(list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])) from words
  union all select doc, n, unnest(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) from words
), counted as (
  select doc, n, f, count(*) as c from features group by all
), hashed as (
  select f, {_CRC.format(text="f")} % 10000 as bucket from (select distinct f from counted), tab
), held as (
  select doc, n, bucket, sum(c) as c from counted join hashed using (f) group by all
), sums as (
  select bucket, cast(coalesce(sum(c) filter (where doc), 0) as double) as s, cast(coalesce(sum(c) filter (where not doc), 0) as double) as t from held group by bucket
), gains as (
  select bucket, cast(floor(1000 * ln((t + 1) * ((select sum(s) from sums) + 10000) / ((s + 1) * ((select sum(t) from sums) + 10000)))) as bigint) as gain from sums
), weights as (
  select n, cast(sum(c * gain) as bigint) as weight, cast(sum(c) as bigint) as n_features from held join gains using (bucket) where doc group by n
), scores as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5) / 4294967296))) as bigint) as score
  from words left join weights using (n) where doc
), places as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first) as place, count(*) over (partition by n_words >= 20) as able from scores
)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * able // 100 then place end as rank from places
"""

#: One turn at a time from the start, with the text that the edits leave.
_OP13 = f"""
with recursive {_CRC_TABLE}, raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations
), drawn as (
  select raw.*, {_CRC.format(text="k")} % 20 as fault from raw, tab
), damaged as (
  select conv_id, turn, case fault when 4 then 'user' else role end as role,
         case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case fault when 3 then 2 else 1 end)) as copy
  from drawn where fault <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as place, substr(role, 1, 1) as initial,
         right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) as last
  from damaged
), faults as (
  select *, case when last = '' then 'blank' when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(initial) over (partition by conv_id order by place) as before
  from placed
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
         count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, max(place) as n
  from faults group by conv_id
), legal(a, initial, b) as (
  values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), added(a, b, cost, audit, made) as (
  select a, a, 0, '', cast([] as varchar[]) from range(4) r(a)
  union all select a, case a when 2 then 3 else 2 end, 2, 'I', [case a when 2 then 'assistant:' else 'user:' end] from range(4) r(a)
  union all select a, case a when 2 then 2 else 3 end, 4, 'II', case a when 2 then ['assistant:', 'user:'] else ['user:', 'assistant:'] end from range(4) r(a)
), ways(conv_id, b, place, best) as (
  select conv_id, cast(0 as bigint), cast(0 as bigint), {{'cost': cast(0 as bigint), 'audit': '', 'made': cast([] as varchar[])}} from counts
  union all
  select w.conv_id, e.b, any_value(w.place) + 1, min({{'cost': w.best.cost + i.cost + e.cost, 'audit': w.best.audit || i.audit || e.edit, 'made': w.best.made || i.made || e.made}})
  from ways w join added i on i.a = w.b join faults f on f.conv_id is not distinct from w.conv_id and f.place = w.place + 1
  cross join lateral (
    select i.b as b, 3 as cost, 'D' as edit, cast([] as varchar[]) as made
    union all select case i.b when 2 then 3 else 2 end, 2 + cast(f.fault = 'truncated' as int), 'R', [case i.b when 2 then 'assistant:' else 'user:' end || f.text] where f.fault not in ('blank', 'duplicate')
    union all select legal.b, cast(f.fault = 'truncated' as int), 'K', [f.role || ':' || f.text] from legal where legal.a = i.b and legal.initial = f.initial and f.fault not in ('blank', 'duplicate')
  ) e
  group by w.conv_id, e.b
), ends as (
  select w.conv_id, min({{'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.audit, 'made': w.best.made || i.made}}) as best
  from ways w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.place join added i on i.a = w.b where i.b in (0, 3) group by w.conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.made, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join ends e on e.conv_id is not distinct from o.conv_id
"""

ORACLE_SQL = {"op5_warc": _OP5, "op11_resampling": _OP11, "op12_exact": _OP12, "op13_dialogue": _OP13}
