"""The SQL that each query must agree with, for any engine with ANSI SQL and these tables."""

from __future__ import annotations

from quillmark.plans.fixtures import D_SQL, R_SQL

#: Fixed values, stated here anew so that a wrong one in the library shows: classes by least deviation score, the
#: polynomial of the error function with its t, and month names.
CLASSES = ((130, "Sangat Superior"), (120, "Superior"), (110, "Di Atas Rata-rata"), (90, "Rata-rata"), (80, "Di Bawah Rata-rata"), (70, "Batas Ambang"), (None, "Sangat Rendah"))
ERF, ERF_T = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592), 0.3275911
MONTHS = "Januari Februari Maret April Mei Juni Juli Agustus September Oktober November Desember".split()


def _graded(penalty: bool = False) -> str:
    raw = "correct - wrong / 4.0" if penalty else "correct"
    return f"""{R_SQL}, g0 as (
  select sheet_ord, count(*) filter (where response = key) as correct, count(*) filter (where key is not null and response is not null and response <> key) as wrong,
         count(*) filter (where key is not null and response is null) as blank, count(key) as scored_items
  from r group by sheet_ord
), g as (
  select *, cast({raw} as double) as raw_score, case when scored_items > 0 then greatest(0.0, cast({raw} as double)) / scored_items * 100.0 else 0.0 end as scaled_score from g0
)"""


def _poly(t: str) -> str:
    out = "0.0"
    for c in ERF:
        out = f"({out}) * {t} + ({c})"
    return out


def cdf(z: str) -> str:
    """The polynomial of the normal distribution function."""
    x, t = f"(abs({z}) / sqrt(2.0))", f"(1.0 / (1.0 + {ERF_T} * (abs({z}) / sqrt(2.0))))"
    return f"0.5 * (1.0 + case when {z} < 0 then -1.0 else 1.0 end * (1.0 - ({_poly(t)}) * {t} * exp(-{x} * {x})))"


def classes(d: str) -> str:
    return "case " + f"when {d} is null then null " + " ".join(f"when {d} >= {least} then '{label}'" for least, label in CLASSES[:-1]) + f" else '{CLASSES[-1][1]}' end"


def _normed(basis: str = "select avg(raw_score) as m, case when count(*) = 1 then 0.0 else stddev_samp(raw_score) end as s0 from g") -> str:
    return f"""{_graded()}, b as (select m, case when s0 > 0 then s0 end as s from ({basis})), n0 as (
  select g.*, (raw_score - m) / s as z from g cross join b
), n as (
  select sheet_ord, 'PESERTA ' || sheet_ord as name, correct, wrong, blank, scored_items, raw_score, scaled_score, z as z_score, 100 + 15 * z as deviation_iq, 50 + 10 * z as t_score,
         case when z is not null then least(99.9, greatest(0.1, {cdf("z")} * 100)) end as percentile, {classes("100 + 15 * z")} as classification
  from n0
)"""


_ITEMS = (
    _graded()
    + """, one as (
  select count(*) as n, greatest(1, cast(floor(count(*) * 0.27 + 0.5) as bigint)) as gs, avg(correct) as tm, case when count(*) = 1 then 0.0 else stddev_samp(correct) end as ts from g
), ranked as (
  select g.sheet_ord, g.correct, row_number() over (order by raw_score desc, sheet_ord) as rk, one.* from g cross join one
), i0 as (
  select r.no, any_value(r.key) as key, any_value(n) as n, any_value(gs) as gs, any_value(tm) as tm, any_value(ts) as ts,
    count(*) filter (where response = key) as ok, count(*) filter (where response = key and rk <= gs) as up, count(*) filter (where response = key and rk > n - gs) as low,
    avg(correct) filter (where response = key) as mc, count(*) filter (where response = 'A') as n_a, count(*) filter (where response = 'B') as n_b, count(*) filter (where response = 'C') as n_c,
    count(*) filter (where response = 'D') as n_d, count(*) filter (where response = 'E') as n_e, count(response) as answered
  from r join ranked using (sheet_ord) group by r.no
), i as (
  select no as item_no, key, n, gs, tm, ts, n_a, n_b, n_c, n_d, n_e, answered - n_a - n_b - n_c - n_d - n_e as n_other, n - answered as n_blank,
    case when key is not null then ok * 1.0 / n end as p, case when key is not null then up * 1.0 / gs - low * 1.0 / gs end as d, mc from i0
), v as (
  select *, case when p is null then 'Tanpa kunci' when d < 0.2 then 'Revisi' when p < 0.2 or p > 0.9 then 'Tinjau' else 'Layak' end as verdict,
    case when key is not null and ts > 0 and p > 0 and p < 1 then (mc - tm) / ts * sqrt(p / nullif(1 - p, 0)) end as rpb from i
)"""
)

_PAGED = (
    R_SQL
    + """, s as (
  select cast(sheet_ord as varchar) as sheet_id, sheet_ord, case when sheet_ord % 10 <> 7 then ' peserta ' || (sheet_ord // 2) end as name from (select distinct sheet_ord from r)
), pr as (
  select cast(sheet_ord as varchar) as sheet_id, sheet_ord, no as item_no, case when (case when sheet_ord % 2 = 0 then no <= 18 else no >= 13 end) then response end as response from r
), mk as (select sheet_id, sheet_ord, coalesce(nullif(upper(trim(name)), ''), sheet_id) as mkey from s
), mem as (
  select sheet_id, sheet_ord, first_value(sheet_id) over (partition by mkey order by sheet_ord) as participant_id from mk
), merged as (
  select participant_id, item_no, arg_min(response, mem.sheet_ord) filter (where response is not null) as response, coalesce(min(response) <> max(response), false) as conflict
  from pr join mem using (sheet_id) group by 1, 2
)"""
)

_LAYOUTS = """l as (
  select cast(s_suppkey as varchar) as layout_id, s_suppkey * 13 % 160 + 1 as nq, s_nationkey % 4 + 1 as cols, s_suppkey % 25 + 8 as rpc, case when s_suppkey % 2 = 0 then 'ABCD' else 'ABCDE' end as os, s_suppkey % 6 * 0.5 + 5 as pitch, s_suppkey % 9 * 0.5 + 3 as dia,
         s_suppkey % 30 + 70 as top, s_suppkey % 5 + 6 as gutter, s_suppkey % 4 + 3 as gap from supplier
), m as (
  select layout_id, nq, cols, rpc, os, length(os) as k, cast(pitch as double) as pitch, cast(dia as double) as dia, cast(top as double) as top, cast(gutter as double) as gutter, cast(gap as double) as gap,
    186.0 as usable, (186.0 - cast(gap as double) * (cols - 1)) / cols as cw, length(os) * cast(dia as double) + (length(os) - 1) * 1.6 as block, cols * rpc as per_page from l
), pages as (
  select m.*, p.page from m join (select unnest(range(0, 20)) as page) p on p.page * per_page < nq
), cells as (
  select pages.*, least(per_page, nq - page * per_page) as cnt, cast(ceil(least(per_page, nq - page * per_page) * 1.0 / cols) as int) as used from pages
), it as (
  select cells.*, page * per_page + j + 1 as no, j // used as col, j % used as row from cells join (select unnest(range(0, 200)) as j) q on j < cnt
), b as (
  select layout_id, page, no, substr(os, cast(o as int) + 1, 1) as opt, o, col, row, 12.0 + col * (cw + gap) + gutter + o * (dia + 1.6) + dia / 2 as x, top + row * pitch + dia / 2 as y
  from it join (select unnest(range(0, 5)) as o) q on o < k
)"""

_MONTH = "case month(o_orderdate) " + " ".join(f"when {i + 1} then '{m}'" for i, m in enumerate(MONTHS)) + " end"

_H = (3.9, 0.12, 14.0, -0.08, 4.05, 9.0, 0.0001, -0.0002, 1.0)

_NORM_COLUMNS = "sheet_ord, round(raw_score, 6) as raw_score, round(z_score, 6) as z_score, round(deviation_iq, 6) as deviation_iq, round(t_score, 6) as t_score, round(percentile, 6) as percentile, classification"

#: Counts of bubbles by decision: best and second net of every item.
_DECIDED = (
    D_SQL
    + """, ranked as (
  select *, row_number() over w as i, lead(net) over w as second from net window w as (partition by sheet_ord, no order by net desc, option_index)
), dec as (
  select sheet_ord, no, case when net >= 0.16 and net - coalesce(second, 0.0) >= 0.1 then option end as response,
    case when net >= 0.16 and net - coalesce(second, 0.0) >= 0.1 then null when net >= 0.16 then 'ganda' else 'kosong' end as flag, net as best_net, net - coalesce(second, 0.0) as margin
  from ranked where i = 1
)"""
)


def _key(rows: str) -> str:
    return f"with k as (select no as item_no, case when no = 30 then null else substr('ABCDE', cast((no * 3) % 5 as int) + 1, 1) end as key from (select distinct p_partkey % 30 + 1 as no from part)) {rows}"


#: Capitals of sharp s are two letters, which not every engine's upper knows.
_PATTERN = "substr(regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[^A-Z-]', '', 'g'), 1, 30)"

_QUEUED = _PAGED + ", qd as (select *, case sheet_ord % 4 when 0 then 'pending' when 1 then 'processing' when 2 then 'done' else 'error' end as status from s)"


def _fmt(x: str, digits: int) -> str:
    return f"coalesce(format('{{:.{digits}f}}', cast({x} as double)), '—')"


def _of_merged(sql: str) -> str:
    """The same figures of merged participants, each under its first sheet."""
    merged = _PAGED + ", r1 as (select cast(participant_id as bigint) as sheet_ord, k.no, response, k.key, conflict from merged m join k on k.no = m.item_no)"
    return sql.replace(R_SQL, merged).replace("from r group by", "from r1 group by").replace("from r join ranked", "from r1 r join ranked")


#: The log of edits, of events and of orders.
_LOG = """log as (
  select event_id * 2 + 1 as seq, case event_id * 7 % 11 when 5 then 'set' when 6 then 'clear' else 'toggle' end as kind, cast(user_id % 97 + 1 as varchar) as target,
         cast(regexp_extract(props, '"k": ([0-9]+)', 1) as int) % 10 + 1 as item_no, substr('ABCDE', cast(floor(value) as int) % 3 + 1, 1) as value from events
  union all
  select o_orderkey * 2, case when o_orderkey = 96 then 'clear_all' when o_custkey % 31 = 0 then 'rename' when o_custkey % 31 = 1 then 'page' when o_custkey % 31 = 2 then 'remove' else 'append' end, cast(o_custkey % 97 + 1 as varchar), null,
         case o_custkey % 31 when 1 then cast(o_orderkey % 4 as varchar) when 0 then 'BUDI ' || o_orderkey else 'BARU ' || o_orderkey end
  from orders where o_custkey % 31 < 2 or (o_custkey % 31 = 2 and o_orderkey % 11 = 0) or (o_custkey % 31 between 3 and 6 and o_orderkey % 97 = 0) or o_orderkey = 96
)"""

#: Sheet by sheet: the last append, the last removal, and what came after.
_LIVES = """ids as (
  select distinct sheet_id from (select sheet_id from s union all select target from log where kind = 'append')
), lives as (
  select ids.sheet_id, max(seq) filter (where kind = 'append') as born, max(seq) filter (where kind in ('remove', 'clear_all')) as died
  from ids left join log on kind = 'clear_all' or (target = ids.sheet_id and kind in ('append', 'remove')) group by ids.sheet_id
), alive as (
  select lives.sheet_id, born, s.name from lives left join s using (sheet_id) where born > coalesce(died, -1) or (born is null and died is null and s.sheet_id is not null)
)"""

#: Edit by edit: each answer as the edits of its cell find it.
_ONE_BY_ONE = """ed as (
  select target, item_no, kind, value, row_number() over (partition by target, item_no order by seq) as i from log join alive on alive.sheet_id = target where kind in ('set', 'toggle', 'clear') and (born is null or seq > born)
), st(target, item_no, i, val) as (
  select t.target, t.item_no, cast(0 as bigint), b.response from (select distinct target, item_no from ed) t left join before b on b.target = t.target and b.item_no = t.item_no
  union all
  select st.target, st.item_no, ed.i, case ed.kind when 'set' then ed.value when 'clear' then null else case when st.val is not distinct from ed.value then null else ed.value end end
  from st join ed on ed.target = st.target and ed.item_no = st.item_no and ed.i = st.i + 1
), fin as (
  select target, item_no, arg_max(coalesce(val, '-'), i) as val from st group by target, item_no
)"""

#: Responses after a revision: other letters on every seventh sheet, every eleventh taken out.
_REVISED = R_SQL.replace(", r as (", ", r0 as (") + ", r as (select sheet_ord, no, q, key, case when sheet_ord % 7 = 3 then translate(response, 'ABCDE', 'BCDEA') else response end as response from r0 where sheet_ord % 11 <> 5)"


_NO_CLEAR = _LOG.replace("or o_orderkey = 96", "").replace("when o_orderkey = 96 then 'clear_all' ", "")


ORACLES: dict[str, str] = {
    "roster_by_name": f"with {_normed()} select row_number() over (order by lower(name), sheet_ord) as row_no, sheet_ord, case when sheet_ord % 2 = 0 then lower(name) else 'Peserta ' || sheet_ord end as name from n",
    "roster_by_class": f"with {_normed()} select row_number() over (order by coalesce(deviation_iq, 0) desc, sheet_ord) as row_no, sheet_ord, classification from n",
    "roster_third_page": f"with {_normed()} select row_number() over (order by lower(name), sheet_ord) as row_no, sheet_ord, case when sheet_ord % 2 = 0 then lower(name) else 'Peserta ' || sheet_ord end as name from n qualify row_no between 7 and 9",
    "name_searches": """with q as (select p_partkey as query_id, lower(trim(case when p_partkey % 3 = 0 then ' R#0' else '' end || substr(cast(p_partkey as varchar), 1, 3) || case when p_partkey % 5 = 0 then ' ' else '' end)) as q from part)
select query_id, c_custkey as sheet_ord, c_name as name from q join customer on contains(lower(c_name), q)""",
    "threshold_sweep": f"""with {_DECIDED}, f as (select round(0.05 + i * 0.55 / 11, 6) as f from range(12) t(i)), m as (select round(0.02 + i * 0.38 / 11, 6) as m from range(12) t(i)),
b as (select net, net - coalesce(second, 0.0) as margin, option = k.key as hit from ranked left join k using (no) where i = 1)
select cast(f as double) as fill_threshold, cast(m as double) as margin_threshold, count(*) filter (where net >= f and margin >= m) as answered, count(*) filter (where net >= f and margin < m) as ganda, count(*) filter (where net < f) as kosong,
  count(*) filter (where net >= f and margin >= m and hit) as "right" from b cross join f cross join m group by 1, 2""",
    "edit_log_responses": f"""with recursive {_PAGED}, {_NO_CLEAR}, {_LIVES}, before as (select pr.sheet_id as target, item_no, response from pr join alive using (sheet_id) where born is null), {_ONE_BY_ONE}
select coalesce(f.target, b.target) as sheet_id, cast(coalesce(f.item_no, b.item_no) as int) as item_no, case when f.target is not null then nullif(f.val, '-') else b.response end as response from fin f full join before b on b.target = f.target and b.item_no = f.item_no""",
    "edit_log_sheets": f"""with {_PAGED}, {_LOG}, {_LIVES}
select a.sheet_id, coalesce(arg_max(value, seq) filter (where kind in ('append', 'rename') and seq >= coalesce(born, 0)), any_value(a.name)) as name, cast(coalesce(arg_max(value, seq) filter (where kind = 'page' and seq > coalesce(born, 0)), '0') as int) as page_index
from alive a left join log on target = a.sheet_id group by a.sheet_id""",
    "edit_log_merged": f"""with recursive {_PAGED}, {_NO_CLEAR.replace("from orders where", "from orders where false and")}, alive as (select distinct participant_id as sheet_id, cast(null as bigint) as born from mem), before as (select participant_id as target, item_no, response from merged), {_ONE_BY_ONE},
hit as (select distinct f.item_no, mem.sheet_id from fin f join mem on mem.participant_id = f.target)
select target as sheet_id, cast(item_no as int) as item_no, nullif(val, '-') as response from fin
union all select pr.sheet_id, cast(pr.item_no as int), case when hit.sheet_id is null then response end from pr left join hit using (sheet_id, item_no) where not exists (select 1 from fin where fin.target = pr.sheet_id and fin.item_no = pr.item_no)""",
    "revised_items": f"with {_ITEMS.replace(R_SQL, _REVISED)} select item_no, round(p, 6) as p, round(d, 6) as discrimination, round(rpb, 6) as point_biserial, n_a, n_blank, verdict from v",
    "revised_scores": f"with {_normed().replace(R_SQL, _REVISED)} select sheet_ord, correct, wrong, blank, round(scaled_score, 6) as scaled_score, round(z_score, 6) as z_score from n",
    "joint_counts": f"""with {_graded()} select cast(no as int) as item_no, key, case when response is null then 'kosong' else response end as option, coalesce(response = key, false) as "right", raw_score, correct, count(*) as n from r join g using (sheet_ord) group by all
union all select 0, null, 'kosong', false, raw_score, correct, count(*) from g group by raw_score, correct""",
    "assessed_people": _of_merged(f"with {_normed()}, cf as (select sheet_ord, count(*) filter (where conflict) as conflict_count from r1 group by 1) select sheet_ord, correct, wrong, blank, conflict_count, raw_score, round(z_score, 6) as z_score, classification from n join cf using (sheet_ord)"),
    "assessed_items": _of_merged(f"with {_ITEMS} select item_no, round(p, 6) as p, round(d, 6) as discrimination, round(rpb, 6) as point_biserial, n_blank, verdict from v"),
    "prepared_pages": """with p as (select page_id, html, strlen(html) // 8 as h, page_id % 8 >= 4 as turned from pages), q as (
  select *, case when html is null then 'image is not available' when page_id % 7 = 0 or h < 1 then 'image could not be decoded' end as error, least(1.0::double, 1600.0::double / greatest(h, 8)) as f, least(1.0::double, 220.0::double / greatest(h, 8)) as t from p
), r as (select *, cast(greatest(1, floor(h * f + 0.5)) as int) as fh, cast(greatest(1, floor(8 * f + 0.5)) as int) as fw, cast(greatest(1, floor(h * t + 0.5)) as int) as th, cast(greatest(1, floor(8 * t + 0.5)) as int) as tw from q)
select cast(page_id as varchar) as sheet_id, case when error is null then case when turned then fw else fh end end as full_height, case when error is null then case when turned then fh else fw end end as full_width,
  case when error is null then case when turned then tw else th end end as thumb_height, case when error is null then case when turned then th else tw end end as thumb_width, error from r""",
    "content_intake": """with k as (select page_id as k from pages where page_id % 4 <> 3)
select cast(k as varchar) as path, case k % 6 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/gif' when 3 then 'image/bmp' when 4 then 'image/webp' end as kind,
  cast(case when k % 6 = 0 and k % 10 between 1 and 8 then k % 10 else 1 end as int) as orientation, k % 6 <> 5 as accepted from k""",
    "image_intake": "select sha256('file:/scans/' || page_id || '/kelas%20a+b.' || (page_id % 3) || '.png') as sheet_id, 'kelas a+b.' || (page_id % 3) || '.png' as file_name, 'KELAS A+B.' || (page_id % 3) as name, 0 as page_index, case when page_id % 7 = 0 then -1 else 8 end as height from pages",
    "intake_counts": "select count(*) filter (where page_id % 7 <> 0) as readable, count(*) filter (where page_id % 7 = 0) as rejected from pages",
    "template_files": f"with {_LAYOUTS}, n as (select layout_id, count(distinct page) as pages, count(*) as bubbles from b group by 1) select layout_id, pages, 3 + 2 * pages as objects, bubbles, 4 * pages as marks, true as linked from n",
    "report_file": f"""with {_normed()}, c as (select count(*) as n, count(distinct classification) as k from n),
line as (select case when i in (0, 99) then 24.0 else 13.0 end as h, i from (select unnest(range(0, 100)) as i) q, c where i = 0 or i = 1 or (i between 2 and 1 + k) or i between 20 and 22 or i = 99),
pos as (select sum(h) over (order by i) - h as start from line union all select (select sum(h) from line) + j * 13.0 from (select unnest(range(0, (select n from c))) as j))
select count(distinct floor(start / (841.89 - 30 * 72 / 25.4 - 24))) as pages, (select count(*) from line) + 7 * (select n from c) as lines, 3 + 2 * count(distinct floor(start / (841.89 - 30 * 72 / 25.4 - 24))) as places from pos""",
    "template_counts": f"with {_LAYOUTS} select layout_id, cast(page as int) as page_index, 4 as marks, count(*) as bubbles, count(distinct no) as numbers from b group by 1, 2",
    "template_heads": f"""with {_LAYOUTS}, p as (select layout_id, page, min(no) as lo, max(no) as hi, string_agg(distinct opt, '/' order by opt) as opts from b group by 1, 2), n as (select layout_id, max(page) + 1 as pages from p group by 1)
select layout_id, cast(page as int) as page_index, 'DINAS &lt;A &amp; B&gt;' as institution, 'TES — PILIHAN GANDA' as title, 'Halaman ' || (page + 1) || ' dari ' || pages as page, 'Butir ' || lo || '–' || hi || ' — Opsi: ' || opts as items, case when page = 0 then 5 else 0 end as instructions from p join n using (layout_id)""",
    "setting_ranges": """with w as (select s_suppkey, s_suppkey % 25 as i, s_suppkey % 23 as j from supplier), t as (select *, least(1000.0, greatest(1.0, i * 60 - 30)) as top from w)
select s_suppkey, cast(least(0.6, greatest(0.05, i / 25.0)) as double) as fill_threshold, cast(least(0.4, greatest(0.02, i / 40.0)) as double) as margin_threshold, cast(least(0.45, greatest(0.2, i / 40.0)) as double) as sample_radius_factor,
  cast(top as double) as scale_max, cast(least(top, greatest(0, j * 45 - 20)) as double) as passing_score from t""",
    "calibrated_sheets": f"""with {_DECIDED.replace('0.16', '0.42').replace('>= 0.1 ', '>= 0.02 ')}, a as (select sheet_ord, string_agg(coalesce(response, '-'), '' order by no) as pattern, count(response) * 1.0 / count(*) as rate from dec group by 1), o as (select sheet_ord, string_agg(coalesce(response, '-'), '' order by no) as pattern from r group by 1)
select o.sheet_ord, case when o.sheet_ord % 9 <> 4 then 'done' else 'error' end as status, case when o.sheet_ord % 9 = 4 then 'grid is not aligned with the sheet' end as error, case when o.sheet_ord % 9 <> 4 then a.pattern else o.pattern end as pattern, case when o.sheet_ord % 9 <> 4 then round(rate, 6) end as confidence
from o join a using (sheet_ord)""",
    "reading_tally": f"""with {_DECIDED}, pg as (select dec.sheet_ord, avg(case when dec.response is not distinct from r.response then 1.0 else 0.0 end) as acc from dec join r on r.sheet_ord = dec.sheet_ord and r.no = dec.no group by 1)
select count(*) as pages, count(*) filter (where sheet_ord % 11 <> 0 and acc >= 0.95) as passed, count(*) filter (where sheet_ord % 11 = 0) as failed_safely, count(*) filter (where sheet_ord % 11 <> 0 and acc < 0.95) as failed_silently, round(count(*) filter (where sheet_ord % 11 = 0) * 1.0 / count(*), 6) as rejection_rate from pg""",
    "score_sheets": f"with {_graded()} select sheet_ord, correct, wrong, blank, scored_items, raw_score, round(scaled_score, 6) as scaled_score from g",
    "score_sheets_penalty": f"with {_graded(True)} select sheet_ord, correct, wrong, blank, scored_items, round(raw_score, 6) as raw_score, round(scaled_score, 6) as scaled_score from g",
    "score_sheets_wide": f"with {_graded()} select sheet_ord, correct, wrong, blank, scored_items, raw_score, round(scaled_score, 6) as scaled_score from g",
    "item_status_long": f"with {R_SQL} select sheet_ord, no as item_no, response, key, case when key is null then 'nokey' when response is null then 'blank' when response = key then 'correct' else 'wrong' end as status from r",
    "key_string": _key("select string_agg(coalesce(key, '-'), '' order by item_no) as key_string from k"),
    "key_fill": _key("select count(key) as filled, count(*) as items from k"),
    "key_toggle": _key("select cast(item_no as int) as item_no, case item_no when 1 then (case when key = 'D' then null else 'D' end) when 2 then (case when key = 'A' then null else 'A' end) else key end as key from k"),
    "key_from_master": f"with {R_SQL} select no as item_no, response as key from r where sheet_ord = 1",
    "answer_pattern": f"with {R_SQL} select sheet_ord, string_agg(coalesce(response, '-'), '' order by no) as pattern from r group by sheet_ord",
    "dense_responses": f"with {R_SQL}, sp as (select * from r where response is not null and q % 3 = 0) select a.sheet_ord, cast(j as int) as item_no, sp.response from (select distinct sheet_ord from sp) a cross join (select unnest(range(1, 31)) as j) i left join sp on sp.sheet_ord = a.sheet_ord and sp.no = j",
    "descriptive_stats": f"with {_graded()} select count(scaled_score) as n, round(avg(scaled_score), 6) as mean, round(case when count(*) = 1 then 0.0 else stddev_samp(scaled_score) end, 6) as sd, round(min(scaled_score), 6) as min, round(max(scaled_score), 6) as max, round(quantile_cont(scaled_score, 0.5), 6) as median, round(max(scaled_score) - min(scaled_score), 6) as range from g",
    "norm_scores_sample": f"with {_normed()} select {_NORM_COLUMNS} from n",
    "norm_scores_manual": f"with {_normed('select 15.0 as m, 5.0 as s0')} select {_NORM_COLUMNS} from n",
    "norm_basis": f"with {_graded()} select round(avg(raw_score), 6) as norm_mean, round(case when stddev_samp(raw_score) > 0 then stddev_samp(raw_score) end, 6) as norm_sd, 'sample' as norm_mode from g",
    "item_difficulty": f"with {_ITEMS} select item_no, key, round(p, 6) as p from v",
    "item_discrimination": f"with {_ITEMS} select item_no, gs as group_size, round(d, 6) as discrimination from v",
    "item_point_biserial": f"with {_ITEMS} select item_no, round(rpb, 6) as point_biserial from v",
    "item_distribution": f"with {_ITEMS} select item_no, n_a, n_b, n_c, n_d, n_e, n_other, n_blank from v",
    "item_verdict": f"with {_ITEMS} select item_no, verdict from v",
    "flagged_items": f"with {_ITEMS} select item_no, key, verdict from v where key is not null and verdict <> 'Layak'",
    "item_statistics_wide": f"with {_ITEMS} select item_no, round(p, 6) as p, round(d, 6) as discrimination, round(rpb, 6) as point_biserial, n_blank, verdict from v",
    "kr20": f"""with {_ITEMS}, t as (select count(key) as k, sum(p * (1 - p)) filter (where key is not null) as pq, max(ts) as sd from v), u as (
  select k, pq, case when k > 1 and sd > 0 then k * 1.0 / nullif(k - 1, 0) * (1 - pq / nullif(sd * sd, 0)) end as kr from t
) select k, round(pq, 6) as sum_pq, round(kr, 6) as kr20, case when kr is null then 'belum dapat diestimasi' when kr >= 0.9 then 'sangat tinggi' when kr >= 0.8 then 'tinggi' when kr >= 0.7 then 'memadai untuk keputusan kelompok' when kr >= 0.6 then 'marginal' else 'rendah' end as interpretation from u""",
    "class_distribution": f"with {_normed()} select cast(case classification {' '.join(f'''when '{label}' then {i + 1}''' for i, (_, label) in enumerate(CLASSES))} end as int) as class_rank, classification, count(*) as count, round(count(*) * 100.0 / (select count(*) from n), 6) as percent from n where classification is not null group by classification",
    "pass_count": f"with {_graded()} select count(*) filter (where scaled_score >= 60) as passed, count(*) as n, round(count(*) filter (where scaled_score >= 60) * 1.0 / nullif(count(*), 0), 6) as share from g",
    "needs_verification": f"with {_graded()} select count(*) filter (where blank * 5 > 15) as needs_verification, count(*) as n from g",
    "score_histogram": f"""with {_graded()}, h as (select cast(least(floor(scaled_score / 12.5) + 1, 8) as int) as bin, count(*) as c from g group by 1)
select cast(j as int) as bin, cast((j - 1) * 12.5 as double) as low, cast(j * 12.5 as double) as high, coalesce(c, 0) as count, greatest(1, (select max(c) from h)) as peak from (select unnest(range(1, 9)) as j) b left join h on h.bin = j""",
    "results_search": f"with {_normed()} select sheet_ord, name, correct from n where contains(lower(name), lower(trim('  TA 1 ')))",
    "results_top_k": f"with {_normed()} select row_number() over (order by scaled_score desc nulls last, sheet_ord) as row_no, sheet_ord, name, round(scaled_score, 6) as scaled_score from n qualify row_no <= 20",
    "results_sorted": f"with {_normed()} select sheet_ord, name, classification from n order by coalesce(deviation_iq, 0) desc, sheet_ord",
    "report_numbers": f"with {_graded()} select sheet_ord, raw_score, row_number() over (order by raw_score desc, sheet_ord) as rk, row_number() over (order by sheet_ord) as row_no from g",
    "merge_by_name": f"with {_PAGED} select participant_id, item_no, response, conflict from merged",
    "merge_conflicts": f"with {_PAGED} select participant_id, count(*) filter (where conflict) as conflict_count from merged group by 1",
    "merged_participants": f"with {_PAGED} select arg_min(sheet_id, sheet_ord) as participant_id, min(sheet_ord) as sheet_ord, arg_min(name, sheet_ord) as name, count(*) as n_sheets from mk join s using (sheet_id, sheet_ord) group by mkey",
    "merged_scores": f"""with {_PAGED}, x as (select m.participant_id, m.response, k.key from merged m join k on k.no = m.item_no), y as (
  select participant_id, count(*) filter (where response = key) as correct, count(*) filter (where key is not null and response is not null and response <> key) as wrong, count(*) filter (where key is not null and response is null) as blank, count(key) as scored_items from x group by 1
) select *, cast(correct as double) as raw_score, round(correct * 100.0 / scored_items, 6) as scaled_score from y""",
    "rename_members": f"with {_PAGED} select sheet_id, sheet_ord, case when sheet_id in (select sheet_id from mem where participant_id = '2') then 'BUDI' else name end as name from s",
    "remove_members": f"with {_PAGED} select sheet_id, sheet_ord, name from s where sheet_id not in (select sheet_id from mem where participant_id = '2')",
    "edit_answer": f"with {_PAGED} select sheet_id, item_no, case when item_no = 15 and sheet_id = '2' then (case when (select response from merged where participant_id = '2' and item_no = 15) = 'B' then null else 'B' end) when item_no = 15 and sheet_id in (select sheet_id from mem where participant_id = '2') then null else response end as response from pr",
    "apply_detection": f"with {_DECIDED}, prev as (select sheet_ord, no as item_no, case when (case when sheet_ord % 2 = 0 then no <= 18 else no >= 13 end) then response end as response from r) select cast(prev.sheet_ord as varchar) as sheet_id, prev.item_no, case when dec.no is not null then dec.response else prev.response end as response from prev left join (select * from dec where no between 10 and 20) dec on dec.sheet_ord = prev.sheet_ord and dec.no = prev.item_no",
    "slugify": "select page_id, substr(regexp_replace(regexp_replace(lower(case when url is null or url = '' then 'laporan' else url end), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug from pages",
    "sanitize_filename": "select page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(list_last(regexp_split_to_array(url || '?a b.pdf', '[\\\\/]')), '[^A-Za-z0-9_.\\-]+', '-', 'g'), '^[.\\-]+', '', 'g'), 1, 120), ''), 'berkas') as file_name from pages",
    "parse_bulk_answers": f"select doc_id, rpad(regexp_replace({_PATTERN}, '[^A-E]', '-', 'g'), 30, '-') as pattern from documents",
    "long_dates": f"select o_orderkey, day(o_orderdate) || ' ' || {_MONTH} || ' ' || year(o_orderdate) as long_date from orders",
    "normal_percentile": f"with z as (select s_suppkey, (s_suppkey % 101 - 50) / 10.0 as z from supplier), y as (select s_suppkey, cast(z as double) as z from z) select s_suppkey, round(least(99.9, greatest(0.1, {cdf('z')} * 100)), 6) as percentile, {classes('(100 + 15 * z)')} as classification from y",
    "layout_normalise": """with p as (select cast(p_partkey as varchar) as layout_id, p_size, p_partkey % 260 as nq, p_size / 7.0 as cols, trim(substr(p_brand, 7, 2)) as dia from part)
select layout_id, cast(floor(least(40.0, greatest(4.0, p_size)) + 0.5) as int) as rows_per_column, cast(floor(least(200.0, greatest(1.0, nq)) + 0.5) as int) as num_questions, cast(floor(least(5.0, greatest(1.0, cols)) + 0.5) as int) as columns,
  least(8.0, greatest(3.0, case when dia = '' then 0.0 else coalesce(try_cast(dia as double), 5.0) end)) as bubble_diameter_mm, case when p_size % 2 = 0 then 'ABCD' else 'ABCDE' end as option_set, cast(12.0 as double) as margin_mm from p""",
    "layout_metrics": f"""with {_LAYOUTS} select layout_id, cast(k as int) as option_count, cast(usable as double) as usable_width_mm, round(cw, 6) as column_width_mm, round(block, 6) as bubble_block_mm, round(gutter + block, 6) as required_column_mm, cast(271.0 as double) as grid_bottom_limit_mm,
  cast(greatest(0, floor((271.0 - top) / pitch)) as int) as max_rows, per_page, cast(greatest(1, ceil(nq * 1.0 / per_page)) as int) as page_count,
  array_to_string(list_filter([case when gutter + block > cw then 'column_too_narrow' end, case when rpc > greatest(0, floor((271.0 - top) / pitch)) then 'too_many_rows' end, case when nq > per_page then 'several_pages' end], lambda x: x is not null), ',') as issues,
  not (gutter + block > cw) and not (rpc > greatest(0, floor((271.0 - top) / pitch))) as printable from m""",
    "page_items": f"with {_LAYOUTS} select layout_id, cast(page as int) as page_index, cast(no as int) as no, cast(col as int) as \"column\", cast(row as int) as row from it",
    "fiducials": "select layout_id, corner, x_mm, y_mm from (select cast(s_suppkey as varchar) as layout_id from supplier) cross join (values ('tl', 9.0::double, 9.0::double), ('tr', 201.0::double, 9.0::double), ('br', 201.0::double, 288.0::double), ('bl', 9.0::double, 288.0::double)) f(corner, x_mm, y_mm)",
    "bubble_centers": f"with {_LAYOUTS} select layout_id, cast(page as int) as page_index, cast(no as int) as no, opt as option, cast(o as int) as option_index, cast(col as int) as \"column\", cast(row as int) as row, round(x, 6) as x_mm, round(y, 6) as y_mm from b",
    "number_anchors": f"with {_LAYOUTS} select layout_id, cast(page as int) as page_index, cast(no as int) as no, round(12.0 + col * (cw + gap), 6) as x_mm, round(gutter - 1.5, 6) as width_mm, round(top + row * pitch + dia / 2, 6) as y_mm from it",
    "project_points": f"with {_LAYOUTS}, d as (select *, {_H[6]} * x + {_H[7]} * y + {_H[8]} as den from b) select layout_id, cast(no as int) as no, cast(o as int) as option_index, round(({_H[0]} * x + {_H[1]} * y + {_H[2]}) / den, 6) as x, round(({_H[3]} * x + {_H[4]} * y + {_H[5]}) / den, 6) as y from d",
    "omr_baseline": f"with {D_SQL} select distinct sheet_ord, round(baseline, 6) as baseline from net",
    "omr_decide": f"with {_DECIDED} select sheet_ord, no, response, flag, round(best_net, 6) as best_net, round(margin, 6) as margin from dec",
    "omr_flags": f"with {_DECIDED} select sheet_ord, no, flag as reason from dec where flag is not null",
    "omr_confidence": f"with {_DECIDED} select sheet_ord, count(response) as marked, count(*) as items, round(count(response) * 1.0 / count(*), 6) as fill_rate from dec group by sheet_ord",
    "omr_overlay": f"with {D_SQL} select sheet_ord, no, option, net >= 0.16 as overlay_marked from net",
    "otsu_threshold": """with lv as (select l_returnflag, cast((l_partkey * 7 + l_suppkey) % 96 + case when l_quantity > 20 then 120 else 20 end as int) as level, count(*) as n from lineitem group by 1, 2), c as (
  select l_returnflag, level, sum(n) over w as w, sum(n * level) over w as s, sum(n) over (partition by l_returnflag) as a, sum(n * level) over (partition by l_returnflag) as t from lv window w as (partition by l_returnflag order by level)
), q as (
  select l_returnflag, level, cast(w as double) * cast(a - w as double) * pow(cast(s as double) / nullif(w, 0) - cast(t - s as double) / nullif(a - w, 0), 2) as between_var from c
), ranked as (select *, row_number() over (partition by l_returnflag order by between_var desc nulls last, level) as i from q)
select l_returnflag, cast(case when between_var > 0 then level else 128 end as int) as threshold from ranked where i = 1""",
    "omr_scan_photos": f"with {R_SQL} select sheet_ord, sheet_ord % 11 <> 0 as ok, case when sheet_ord % 11 <> 0 then string_agg(coalesce(response, '-'), '' order by no) end as pattern from r group by sheet_ord",
    "omr_recalibrated": f"with {_DECIDED.replace('0.16', '0.42').replace('>= 0.1 ', '>= 0.02 ')} select sheet_ord, no, response, flag from dec",
    "bulk_key": "select r_regionkey, rpad(regexp_replace(substr(regexp_replace(upper(r_name) || '-ABCDE', '[^A-Z-]', '', 'g'), 1, 12), '[^A-E]', '-', 'g'), 12, '-') as key_string from region",
    "typed_sheets": f"""with t as (select doc_id, upper(trim(source)) as name, rpad(regexp_replace({_PATTERN}, '[^A-E]', '-', 'g'), 30, '-') as pattern from documents)
select cast(doc_id as varchar) as sheet_id, doc_id as sheet_ord, name, 'done' as status, 'manual' as source, pattern from t where name <> '' and pattern <> repeat('-', 30)""",
    "file_sheets": "select cast(page_id as varchar) as sheet_id, page_id as sheet_ord, 'scan ' || page_id || '.v2.png' as file_name, 'SCAN ' || page_id || '.V2' as name, 'pending' as status, 30 as items from pages",
    "work_queue": f"with {_QUEUED} select sheet_id, status from qd where status in ('pending', 'error') or (status = 'processing' and sheet_ord % 8 = 1)",
    "outcome_counts": f"with {_QUEUED} select status, count(*) as count from qd group by status",
    "page_index": f"with {_QUEUED} select sheet_id, case when sheet_id = '3' then 2 else 0 end as page_index from qd",
    "update_sheets": f"with {_QUEUED} select sheet_id, case when sheet_ord % 6 = 0 then upper(name) else name end as name, case when sheet_ord % 3 = 0 then 'done' else status end as status from qd",
    "append_sheets": f"with {_PAGED} select sheet_id, sheet_ord, name from s union all select 'new-' || sheet_id, sheet_ord + 1 + (select max(sheet_ord) from s), null from s where sheet_ord <= 5",
    "results_by_name": f"with {_normed()}, nn as (select sheet_ord, case when sheet_ord % 2 = 0 then lower(name) else 'Peserta ' || sheet_ord end as name from n) select row_number() over (order by lower(name), sheet_ord) as row_no, sheet_ord, name from nn qualify row_no <= 25",
    "results_rising": f"with {_normed()} select row_number() over (order by correct, sheet_ord) as row_no, sheet_ord, correct from n qualify row_no <= 25",
    "fmt_numbers": "select s_suppkey, case when s_suppkey % 9 <> 4 then format('{:.2f}', s_acctbal / 7.0::double) else '—' end as two, case when s_suppkey % 9 <> 4 then format('{:.0f}', s_acctbal / 7.0::double) else '—' end as none from supplier",
    "mm_to_px": "select p_partkey, round(p_size / 4.0 * 96 / 25.4, 6) as px from part",
    "data_urls": "select page_id, 'data:text/plain;base64,' || base64(encode(url)) as data_url, base64(encode(url)) as payload from pages",
    "csv_rows": f"""with {_normed()}, pat as (select sheet_ord, string_agg(coalesce(response, '-'), '' order by no) as pattern from r group by sheet_ord), c as (select *, row_number() over (order by sheet_ord) as row_no from n join pat using (sheet_ord))
select row_no, '"' || concat_ws('","', row_no, name, correct, wrong, blank, {_fmt('raw_score', 2)}, {_fmt('scaled_score', 1)}, {_fmt('z_score', 2)}, {_fmt('t_score', 1)}, {_fmt('deviation_iq', 0)}, {_fmt('percentile', 1)}, coalesce(classification, '—'), pattern) || '"' as line from c""",
    "csv_head": "select cast(i as int) as place, h as header from (select unnest(range(1, 14)) as i, unnest(['No', 'Nama', 'Benar', 'Salah', 'Kosong', 'Skor Mentah', 'Nilai (0-100)', 'Z', 'T', 'Skor Deviasi', 'Persentil', 'Klasifikasi', 'Pola Jawaban']) as h)",
    "report_appendix": f"with {R_SQL} select sheet_ord, 'PESERTA ' || sheet_ord as name, no as item_no, response, key, case when key is null then 'nokey' when response is null then 'blank' when response = key then 'correct' else 'wrong' end as status from r",
    "report_text": f"""with {_ITEMS}, t as (select count(key) as k, sum(p * (1 - p)) filter (where key is not null) as pq, max(ts) as sd, max(n) as n from v), u as (
  select n, case when k > 1 and sd > 0 then k * 1.0 / nullif(k - 1, 0) * (1 - pq / nullif(sd * sd, 0)) end as kr from t
), bs as (select avg(raw_score) as m, case when stddev_samp(raw_score) > 0 then stddev_samp(raw_score) end as s from g)
select case when kr is null then 'Koefisien konsistensi internal KR-20 belum dapat diestimasi karena variansi skor total pada sampel berukuran ' || n || ' peserta belum memadai'
    else 'Estimasi konsistensi internal melalui KR-20 sebesar ' || {_fmt('kr', 3)} || ' tergolong ' || case when kr >= 0.9 then 'sangat tinggi' when kr >= 0.8 then 'tinggi' when kr >= 0.7 then 'memadai untuk keputusan kelompok' when kr >= 0.6 then 'marginal' else 'rendah' end || ' pada sampel berukuran ' || n || ' peserta' end as reliability_sentence,
  'norma lokal yang diturunkan dari sampel pemeriksaan ini (M = ' || {_fmt('m', 2)} || '; SD = ' || {_fmt('s', 2)} || ')' as norm_sentence,
  'Norm-based scores describe standing relative to the chosen comparison group and are not standardised IQ scores.' as note
from u cross join bs""",
    "omr_scan": f"with {R_SQL} select sheet_ord, no as item_no, response from r",
}
#: The written file holds the same lines, without their numbers.
ORACLES["csv_file"] = f"select line from ({ORACLES['csv_rows']}) t"
