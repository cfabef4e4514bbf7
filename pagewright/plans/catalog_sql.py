"""The SQL that each query of the catalog is compared with."""

_PAGE = "cast(nullif(regexp_extract(file_name, '([0-9]+)', 1), '') as int)"
_SESS = f"""sess as (select *, {_PAGE} as page from region_sessions qualify row_number() over (partition by book_id, page order by saved_at desc, session_id desc) = 1)"""
_REG = (
    _SESS
    + """, reg as (select book_id, page, image_name, image_width, image_height, r.rectangle.rect_id as rect_id, r.rectangle.draw_order as draw_order, r.rectangle.x as x, r.rectangle.y as y,
 r.rectangle.width as width, r.rectangle.height as height, r.text as text, r.ocr_status as ocr_status, r.ocr_error as ocr_error from (select *, unnest(regions) as r from sess))"""
)
_BLK = _REG + """, blk as (select *, text as raw_text, format('{}:p{:03d}:{}', book_id, page, rect_id) as block_id from reg where ocr_status = 'done' and text is not null and text <> '' and page is not null)"""


def _lines(source: str, key: str, text: str) -> str:
    """Physical lines of a text: key, i, t, b (its break), a (its start), z (its end)."""
    return f"""raw_lines as (select {key}, i, parts[i] as t, coalesce(seps[i], '') as b from (select {key}, regexp_split_to_array({text}, '\\r\\n|\\r|\\n') as parts,
 regexp_extract_all({text}, '\\r\\n|\\r|\\n') as seps, unnest(range(1, len(regexp_split_to_array({text}, '\\r\\n|\\r|\\n')) + 1)) as i from {source} where {text} is not null)),
 ln as (select *, cast(coalesce(sum(length(t) + length(b)) over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0) as int) as a from raw_lines where not (t = '' and b = '')),
 lines as (select *, a + cast(length(t) as int) as z from ln)"""


_DECIDE = """, pairs as (select *, lead(t) over (partition by block_id order by i) as r, lead(a) over (partition by block_id order by i) as next_a from lines),
 dec as (select *, regexp_matches(t, '^[■●▼◆◇・]') or regexp_matches(r, '^[■●▼◆◇・]') as listed, regexp_matches(t, '[ \\x{3000}]{2,}') or regexp_matches(r, '[ \\x{3000}]{2,}') as tabled,
  t = '' or r = '' or regexp_matches(t, '[。！？!?：:]$') as whole, least(length(t), length(r)) <= 4 as short from pairs),
 ruled as (select *, r is not null and not (listed or tabled or whole or short) as should_join,
  case when r is null then null when listed then 'bullet_list_structure' when tabled then 'table_like_spacing' when not whole and short then 'short_independent_line' end as review_reason from dec)"""
_NORM = (
    _BLK + ", " + _lines("blk", "block_id", "raw_text") + _DECIDE
    + """, nt as (select block_id, string_agg(t || case when should_join then '' else b end, '' order by i) as normalized_text, cast(count(*) filter (should_join) as int) as joins from ruled group by 1),
 why as (select block_id, review_reason, min(i) as i from ruled where review_reason is not null group by 1, 2),
 ws as (select block_id, string_agg(review_reason, ',' order by i) as reasons, list(review_reason order by i) as reason_list from why group by 1),
 bk as (select book_id, any_value(title) as title, any_value(default_audience) as da, any_value(default_document_type) as dt, any_value(audience_overrides) as ao, any_value(document_type_overrides) as dto from books group by 1),
 norm as (select blk.*, nt.normalized_text, nt.joins, coalesce(ws.reasons, '') as reasons, coalesce(ws.reason_list, []) as reason_list,
  coalesce(list_filter(ao, lambda o: blk.page between o.start_page and o.end_page)[-1].audience, da, 'unknown') as inherited_audience,
  coalesce(list_filter(dto, lambda o: blk.page between o.start_page and o.end_page)[1].document_type, dt, 'unknown') as document_type
  from blk join nt using (block_id) left join ws using (block_id) left join bk using (book_id))"""
)
_SEG = "seg as (select * from segments qualify row_number() over (partition by segment_id order by loaded_at desc) = 1)"
_SPAN = """spans as (select segment_id, book_id, s.page as page, s.rect_id as rect_id, s."start" as a, s."end" as b from (select segment_id, book_id, unnest(source_spans) as s from seg)
 where s.page is not null and s.rect_id is not null and s."start" is not null and s."end" is not null and s."end" > s."start" and s."start" >= 0)"""
_BOOKS = _NORM[_NORM.index("bk as") : _NORM.index(",\n norm as")]
_RUNS = """, size as (select book_id, page, rect_id, cast(length(raw_text) as int) as n from blk),
 clip as (select book_id, page, rect_id, least(a, n) as a, least(b, n) as b from spans join size using (book_id, page, rect_id)),
 ev as (select book_id, page, rect_id, a as pos, 1 as d from clip where b > a union all select book_id, page, rect_id, b, -1 from clip where b > a
  union all select book_id, page, rect_id, 0, 0 from size union all select book_id, page, rect_id, n, 0 from size),
 st as (select book_id, page, rect_id, pos, sum(d) as d from ev group by all),
 runs as (select * from (select book_id, page, rect_id, pos as a, lead(pos) over w as b, sum(d) over w as depth from st window w as (partition by book_id, page, rect_id order by pos)) where b > a)"""


def _islands(where: str, name: str) -> str:
    return f""", {name}_m as (select *, case when lag(b) over (partition by book_id, page, rect_id order by a) = a then 0 else 1 end as new from runs where {where}),
 {name}_i as (select *, sum(new) over (partition by book_id, page, rect_id order by a) as i from {name}_m),
 {name} as (select book_id, page, rect_id, cast(min(a) as int) as "start", cast(max(b) as int) as "end" from {name}_i group by book_id, page, rect_id, i)"""


_GAPS, _OVER = _islands("depth = 0", "gaps"), _islands("depth >= 2", "overs")
_PROP = """, prop as (select book_id, page, segment_id, content_type, section_path, audience, cast(row_number() over (partition by book_id, page order by rect_id nulls last, first_start nulls last, segment_id) as int) as seq,
  list_transform(source_spans, lambda x: book_id || ':p' || case when x.page is null then 'null' else format('{:03d}', x.page) end || ':' || coalesce(x.rect_id, 'null')) as block_ids
  from (select *, source_spans[1].page as page, source_spans[1].rect_id as rect_id, source_spans[1]."start" as first_start from seg) where page is not null),
 known as (select book_id, page, list(block_id order by draw_order, block_id) as ids from blk group by 1, 2),
 pk as (select prop.*, coalesce(known.ids, []) as ids from prop left join known using (book_id, page)),
 claim as (select *, case when failure is null then block_ids else [] end as claimed from (select *, case when len(list_distinct(block_ids)) < len(block_ids) then 'duplicate_block_ref'
   when len(block_ids) = 0 or len(list_filter(block_ids, lambda b: b is null or not list_contains(ids, b))) > 0 then 'unknown_block_id'
   when list_max(list_transform(block_ids, lambda b: list_position(ids, b))) - list_min(list_transform(block_ids, lambda b: list_position(ids, b))) + 1 <> len(block_ids) then 'non_contiguous_block_ids' end as failure from pk where seq = 1)
  union all
  select book_id, page, segment_id, content_type, section_path, audience, seq, block_ids, ids, failure, case when failure is null then list_concat(before, block_ids) else before end as claimed from (
   select pk.*, claim.claimed as before, case when len(list_distinct(pk.block_ids)) < len(pk.block_ids) then 'duplicate_block_ref'
   when len(pk.block_ids) = 0 or len(list_filter(pk.block_ids, lambda b: b is null or not list_contains(pk.ids, b))) > 0 then 'unknown_block_id'
   when list_has_any(pk.block_ids, claim.claimed) then 'duplicate_block_ref'
   when list_max(list_transform(pk.block_ids, lambda b: list_position(pk.ids, b))) - list_min(list_transform(pk.block_ids, lambda b: list_position(pk.ids, b))) + 1 <> len(pk.block_ids) then 'non_contiguous_block_ids' end as failure
   from claim join pk on pk.book_id = claim.book_id and pk.page = claim.page and pk.seq = claim.seq + 1))"""
_ASM = """, ok as (select * from claim where failure is null),
 part as (select ok.book_id, ok.page, ok.seq, ok.block_ids, ok.content_type, ok.section_path, ok.audience, norm.block_id, norm.draw_order, norm.normalized_text, norm.inherited_audience, norm.document_type, norm.joins, norm.reason_list
  from (select *, unnest(block_ids) as bid from ok) ok join norm on norm.block_id = ok.bid and norm.book_id = ok.book_id and norm.page = ok.page),
 grp as (select book_id, page, seq, any_value(block_ids) as block_ids, any_value(content_type) as content_type, any_value(section_path) as section_path, any_value(audience) as audience,
  min(draw_order) as first_order, case when bool_or(inherited_audience = 'gm') then 'gm' when bool_or(inherited_audience = 'unknown') then 'unknown' when count(distinct inherited_audience) = 1 then min(inherited_audience) else 'shared' end as inh,
  count(distinct document_type) as types, min(document_type) as dt, string_agg(block_id, ',' order by draw_order, block_id) as blocks, string_agg(normalized_text, chr(10) || chr(10) order by draw_order, block_id) as normalized_text,
  cast(sum(joins) as int) as joins, list_distinct(flatten(list(reason_list))) as rl from part group by 1, 2, 3),
 made as (select book_id || '-' || left(sha256(book_id || '|' || array_to_string(block_ids, ',') || '|' || coalesce(content_type, '') || '|' || array_to_string(section_path, '/')), 16) as segment_id, book_id, page, first_order, content_type,
  case when inh = 'gm' and audience in ('player', 'shared') then 'gm' else audience end as audience, inh as inherited_audience, case when types > 1 then 'unknown' else dt end as document_type, blocks, normalized_text, joins,
  list_concat(rl, case when inh = 'gm' and audience in ('player', 'shared') then ['audience_downgrade_candidate'] else [] end, case when types > 1 then ['mixed_document_type_override'] else [] end) as rl from grp),
 failed as (select book_id, page, bid as block_id, arg_min(failure, seq) as why from (select *, unnest(block_ids) as bid from claim where failure is not null) where bid is not null group by 1, 2, 3),
 rest as (select norm.*, coalesce(failed.why, 'unreferenced_block') as why from norm left join failed using (book_id, page, block_id) where norm.block_id not in (select block_id from part)),
 fall as (select book_id || '-' || left(sha256(book_id || '|' || block_id || '|unknown|'), 16) as segment_id, book_id, page, draw_order as first_order, 'unknown' as content_type, inherited_audience as audience, inherited_audience, document_type,
  block_id as blocks, normalized_text, joins, list_append(reason_list, why) as rl from rest),
 asm as (select * from made union all select * from fall)"""
_TYPED = """items as (select event_type as type_name, event_id as "at", 'user-' || user_id as source, map_concat(cast(json(props) as map(varchar, varchar)),
  map {'value': case when value < 1 then 'ー' else printf('%.2f', value) end}) as item from events)"""
_LOG = """log as (select distinct segment_id as session, status as type, decided_by as value, decided_at, processing_version, concat_ws(' ', status, comment) as text, input_hash from review_decisions)"""
_BOX = _REG + """, box as (select * from (select *, greatest(0, least(x, image_width)) as "left", greatest(0, least(y, image_height)) as top, greatest(0, least(x + width, image_width)) as "right",
 greatest(0, least(y + height, image_height)) as bottom from reg) where "right" - "left" >= 1 and bottom - top >= 1)"""
_RANK = """q as (select vec_id as query_id, cast(embedding as double[]) as v, label from embeddings where vec_id % 100 = 0),
 sim as (select query_id, e.vec_id as item, e.label, q.label as ql, round(list_cosine_similarity(cast(e.embedding as double[]), q.v), 9) as s from q, embeddings e where e.vec_id <> query_id),
 ranked as (select *, row_number() over (partition by query_id order by s desc, item) as rank from sim),
 rel as (select query_id, count(*) as relevant from sim where label = ql group by 1),
 hit as (select query_id, count(*) as hits, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from ranked where rank <= 10 and label = ql group by 1),
 sc as (select query_id, round(coalesce(hits / relevant, 0.0), 6) as recall_at_k, round(coalesce(1 / first, 0.0), 6) as reciprocal_rank,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 0.0), 6) as ndcg_at_k from rel left join hit using (query_id))"""
_TIME = """t as (select event_type as step_name, user_id as file_key, value as elapsed, case when event_type = 'click' then 'wait' else 'step' end as kind, case when event_type = 'error' then 'error' else 'success' end as outcome, event_id as seq from events)"""
_CACHE = """oc as (select segment_id, book_id, case when processing is null then 'missing' when cardinality(processing) = 0 then 'corrupted' when schema_version <> 1 or schema_version is null then 'cache_version_mismatch'
 when processing['version'] is distinct from 's2' then 'extractor_mismatch' when raw_text is null then 'source_mismatch' when normalized_text is null or entities is null then 'invalid_shape' else 'hit' end as outcome from seg)"""
_DECISION = """dl as (select * from review_decisions where review_id is not null qualify row_number() over (partition by review_id order by decided_at desc nulls last, processing_version desc nulls last, status desc nulls last, input_hash desc nulls last) = 1),
 hashed as (select *, coalesce(nullif(processing['input_hash'], ''), nullif(processing['input_sha256'], ''), 'sha256:' || sha256(book_id || '|' || segment_id || '|' || coalesce(raw_text, '') || '|' || coalesce(normalized_text, '') || '|' ||
  array_to_string(list_transform(source_spans, lambda s: coalesce(cast(s.page as varchar), '') || ':' || coalesce(s.rect_id, '') || ':' || coalesce(cast(s."start" as varchar), '') || ':' || coalesce(cast(s."end" as varchar), '')), ','))) as ih,
  list_filter(list_transform(string_split(coalesce(processing['review_reasons'], ''), ','), lambda p: trim(p)), lambda p: p <> '') as rs from seg),
 dj as (select h.*, case when d1.review_id is not null then d1.segment_id else d2.segment_id end as d_of, case when d1.review_id is not null then d1.status else d2.status end as d_status,
  case when d1.review_id is not null then d1.input_hash else d2.input_hash end as d_hash, d1.review_id is not null or d2.review_id is not null as has
  from hashed h left join dl d1 on d1.review_id = h.book_id || ':' || h.segment_id left join dl d2 on d2.review_id = h.segment_id),
 oc2 as (select *, case when not has then 'none' when d_of is distinct from segment_id then 'ignored' when d_hash is distinct from ih then 'stale' else 'applied' end as outcome from dj),
 decided as (select *, case when outcome = 'applied' then d_status when outcome = 'stale' then 'required' else review_status end as new_status,
  case when outcome = 'stale' and not list_contains(rs, 'stale_review_decision') then list_append(rs, 'stale_review_decision') else rs end as new_rs from oc2)"""
_CYCLE = """e as (select segment_id as id, max(parent_segment_id) as p from segments where segment_id is not null group by 1),
 tr as (select id, case when p in (select id from e) then p end as p from e),
 up as (select id, id as root_id, 0 as depth, [id] as path from tr where p is null union all select tr.id, up.root_id, up.depth + 1, list_append(up.path, tr.id) from tr join up on tr.p = up.id),
 cy as (select id, p from tr where id not in (select id from up)),
 reach as (select id, p as a from cy union select r.id, cy.p from reach r join cy on r.a = cy.id),
 ring as (select r.id as segment_id, min(r.a) as root_id from reach r where r.id in (select id from reach where id = a) group by 1)"""
_ERR = """, first_seg as (select book_id, page, rect_id, arg_min(segment_id, (a, segment_id)) as segment_id from spans group by 1, 2, 3),
 inv as (select s.segment_id, s.page, s.rect_id, s.a, s.b from (select segment_id, book_id, s.page as page, s.rect_id as rect_id, s."start" as a, s."end" as b from (select segment_id, book_id, unnest(source_spans) as s from seg)) s
  left join size z on z.book_id = s.book_id and z.page = s.page and z.rect_id = s.rect_id where z.n is null or s.a is null or s.b is null or s.a < 0 or s.b <= s.a or s.a >= z.n or s.b > z.n),
 rev0 as (select segment_id, i, s.page as page, s.rect_id as rect_id, s."start" as a, p.page as pp, p.rect_id as pr, p."start" as pa from (select segment_id, i, source_spans[i] as s, source_spans[i - 1] as p
  from (select segment_id, source_spans, unnest(range(2, len(source_spans) + 1)) as i from seg))),
 rev as (select segment_id, arg_min(page, i) as page, arg_min(rect_id, i) as rect_id, cast(min(i) - 1 as int) as "at" from rev0 where page < pp or (page = pp and rect_id = pr and a < pa) group by 1),
 errs as (select 'source_gap' as code, f.segment_id from gaps g left join first_seg f using (book_id, page, rect_id) union all select 'source_overlap', f.segment_id from overs g left join first_seg f using (book_id, page, rect_id)
  union all select 'invalid_source_ref', segment_id from inv union all select 'source_order_reversal', segment_id from rev union all select 'parent_cycle', segment_id from ring)"""
_VIEW = """vis as (select * from seg where (review_status is null or review_status <> 'rejected') and coalesce(audience, 'unknown') not in ('gm', 'unknown'))"""
_BODY = """chr(10) || '章節: ' || coalesce(array_to_string(section_path, ' > '), '') || chr(10) || '種別: ' || coalesce(content_type, '') || chr(10) || '本文: ' || coalesce(normalized_text, '')"""
_PAIRS = f"with recursive {_BLK}, {_SEG}{_PROP}"
_ALLERR = f"with recursive {_BLK}, {_SEG}, {_SPAN}, {_CYCLE}{_RUNS}{_GAPS}{_OVER}{_ERR}"
_NEAR = """seq as (select *, row_number() over (partition by book_id order by page, rect_id, first_start, segment_id) as k from (select *, source_spans[1].page as page, source_spans[1].rect_id as rect_id, source_spans[1]."start" as first_start from seg)),
 ctx as (select *, coalesce(lag(raw_text) over w, '') as before, coalesce(lead(raw_text) over w, '') as after,
  list_filter(list_transform(string_split(coalesce(processing['review_reasons'], ''), ','), lambda p: trim(p)), lambda p: p <> '') as rs from seq window w as (partition by book_id order by k)),
 item as (select c.*, case when len(rs) = 0 then ['review_required'] else rs end as reasons, s.image_name from ctx c left join sess s on s.book_id = c.book_id and s.page = c.page where c.review_status = 'required'),
 rq as (select *, case when list_has_any(reasons, ['audience_downgrade_candidate', 'gm_audience_visible', 'unknown_audience_visible', 'unknown_block_id', 'duplicate_block_ref', 'non_contiguous_block_ids', 'parent_cycle', 'source_gap', 'source_overlap',
  'invalid_source_ref', 'source_order_reversal']) then 'high' else 'medium' end as severity from item)"""

_RECTS = (
    _REG
    + """, okr as (select book_id, page, x, y, width, height, image_width as pw, image_height as ph from reg where book_id is not null and page is not null and x is not null and y is not null and width is not null and height is not null
  and image_width is not null and image_height is not null),
 cl as (select *, greatest(least(x, pw), 0) as l, greatest(least(y, ph), 0) as t, greatest(least(x + width, pw), 0) as r, greatest(least(y + height, ph), 0) as b from okr),
 big as (select *, row_number() over (partition by book_id, page order by (r - l) * (b - t) desc, y, x, height, width) as rn from cl where r - l >= 1 and b - t >= 1),
 keep as (select distinct book_id, page, cast(0 as bigint) as rn, cast([] as struct(l int, t int, r int, b int, y int, x int, h int, w int)[]) as kept from big
  union all select k.book_id, k.page, n.rn, case when len(list_filter(k.kept, lambda o: greatest(least(o.r, n.r) - greatest(o.l, n.l), 0) * greatest(least(o.b, n.b) - greatest(o.t, n.t), 0) >= 0.9 * ((n.r - n.l) * (n.b - n.t)))) > 0 then k.kept
   else list_append(k.kept, {'l': n.l, 't': n.t, 'r': n.r, 'b': n.b, 'y': n.y, 'x': n.x, 'h': n.height, 'w': n.width}) end
  from keep k join big n on n.book_id = k.book_id and n.page = k.page and n.rn = k.rn + 1),
 whole as (select book_id, page, unnest(arg_max(kept, rn)) as o from keep group by book_id, page),
 size as (select book_id, page, any_value(pw) as pw, any_value(ph) as ph from okr group by 1, 2),
 rect as (select book_id, page, pw, ph, o.l as l, o.t as t, o.r as r, o.b as b, row_number() over (partition by book_id, page order by o.t, o.l, o.y, o.x, o.h, o.w) - 1 as k from whole join size using (book_id, page))"""
)


def _columns(source: str, name: str, by: str = "book_id, page") -> str:
    """The columns of the boxes of a source (by, k, l, t, r, b, pw): each box with the first column whose upper median edges it fits. Result: by, n, g (its edges, ks and hull)."""
    same = " and ".join(f"i.{c.strip()} = c.{c.strip()}" for c in by.split(","))
    left, right = "g.ls[len(g.ls) // 2 + 1]", "g.rs[len(g.rs) // 2 + 1]"
    fits = f"""{right} > {left} and (abs(i.l - {left}) <= i.e or abs(i.r - {right}) <= i.e or (least(i.r, {right}) > greatest(i.l, {left}) and ((i.l >= {left} - i.e and i.r <= {right} + i.e and i.r - i.l <= ({right} - {left}) * 1.05)
     or (least(i.r, {right}) - greatest(i.l, {left}) >= 0.35 * greatest(i.r - i.l, {right} - {left}) and abs(i.l + i.r - {left} - {right}) / 2 <= i.e * 3))))"""
    return f""", {name}_in as (select *, row_number() over (partition by {by} order by l, t, k) as n, pw * 0.015 as e from {source}),
 {name}_fold as (select distinct {", ".join("c." + c.strip() for c in by.split(","))}, cast(0 as bigint) as n, cast([] as struct(ls int[], rs int[], ks bigint[], l int, t int, r int, b int)[]) as cs from {name}_in c
  union all select {", ".join("c." + c.strip() for c in by.split(","))}, i.n, (select case when h = 0 then list_append(c.cs, {{'ls': [i.l], 'rs': [i.r], 'ks': [i.k], 'l': i.l, 't': i.t, 'r': i.r, 'b': i.b}})
   else list_transform(c.cs, lambda g, j: case when j = h then {{'ls': list_sort(list_append(g.ls, i.l)), 'rs': list_sort(list_append(g.rs, i.r)), 'ks': list_append(g.ks, i.k), 'l': least(g.l, i.l), 't': least(g.t, i.t), 'r': greatest(g.r, i.r), 'b': greatest(g.b, i.b)}} else g end) end
   from (select coalesce(list_position(list_transform(c.cs, lambda g: {fits}), true), 0) as h))
  from {name}_fold c join {name}_in i on {same} and i.n = c.n + 1),
 {name}_all as (select {by}, unnest(arg_max(cs, n)) as g from {name}_fold group by {by}),
 {name} as (select {by}, g, cast(row_number() over (partition by {by} order by g.l, g.t) - 1 as int) as n from {name}_all)"""


_COLUMNS = _columns("rect", "cols")
_PARTS = f"""{_RECTS}{_COLUMNS}, own as (select c.book_id, c.page, c.n as c, unnest(c.g.ks) as k from cols c),
 rest as (select distinct o.c, r.* from (select distinct book_id, page, c from own) o join rect r on r.book_id = o.book_id and r.page = o.page where not exists (select 1 from own w where w.book_id = o.book_id and w.page = o.page and w.c = o.c and w.k = r.k)){_columns("rest", "ocol", "book_id, page, c")},
 line as (select o.c, r.*, row_number() over w as o, max(r.b) over (w rows between unbounded preceding and 1 preceding) as low, lag(r.r - r.l) over w as bw, lag(r.l + r.r) over w as bm, max(r.r) over (partition by o.book_id, o.page, o.c) - min(r.l) over (partition by o.book_id, o.page, o.c) as cw
  from own o join rect r on r.book_id = o.book_id and r.page = o.page and r.k = o.k window w as (partition by o.book_id, o.page, o.c order by r.t, r.l, r.k)),
 hole as (select *, greatest(r - l, bw) > 0 and (abs(r - l - bw) >= 0.45 * greatest(r - l, bw) or abs(l + r - bm) / 2 >= 0.25 * greatest(r - l, bw)) as unlike from line where o > 1 and t - low >= ph * 0.02 and cw > pw * 0.25),
 met as (select h.book_id, h.page, h.c, h.o, q.n, bool_or(least(x.b, h.t) - greatest(x.t, h.low) > greatest(h.t - h.low, 1) * 0.25) as filled, bool_or(abs(x.t - h.t) <= h.ph * 0.012) as tops, bool_or(abs(x.b - h.low) <= h.ph * 0.012) as lows
  from hole h join (select book_id, page, c, n, g.r - g.l as w, unnest(g.ks) as k from ocol) q on q.book_id = h.book_id and q.page = h.page and q.c = h.c and q.w > h.pw * 0.25 join rect x on x.book_id = q.book_id and x.page = q.page and x.k = q.k group by 1, 2, 3, 4, 5),
 ends as (select distinct book_id, page, c, o from met where not filled and tops and lows),
 cutat as (select book_id, page, c, o, false as s from line where o = 1
  union all select i.book_id, i.page, i.c, i.o, h.o is not null and (e.o is not null or (h.unlike and (i.o = 2 or p.s))) from cutat p join line i on i.book_id = p.book_id and i.page = p.page and i.c = p.c and i.o = p.o + 1
   left join hole h on h.book_id = i.book_id and h.page = i.page and h.c = i.c and h.o = i.o left join ends e on e.book_id = i.book_id and e.page = i.page and e.c = i.c and e.o = i.o),
 part as (select l.*, sum(case when s then 1 else 0 end) over (partition by l.book_id, l.page, l.c order by l.o) as part from line l join cutat s using (book_id, page, c, o))"""
_BANDS = (
    """, body as (select book_id, page, max(r) - min(l) as w from rect group by 1, 2), slim as (select rect.* from rect join body using (book_id, page) where r - l < 0.6 * w)"""
    + _columns("slim", "pcol")
    + """, several as (select book_id, page, count(*) >= 2 as many from pcol group by 1, 2),
 cutm as (select *, max(b) over (partition by book_id, page order by t, l, k rows between unbounded preceding and 1 preceding) as low from rect),
 strip as (select c.*, case when coalesce(many, false) then sum(case when t - low >= ph * 0.016 then 1 else 0 end) over (partition by book_id, page order by t, l, k) else 0 end as s from cutm c left join several using (book_id, page)),
 sbody as (select book_id, page, s, max(r) - min(l) as w, count(*) as m from strip group by 1, 2, 3), sslim as (select strip.* from strip join sbody using (book_id, page, s) where r - l < 0.6 * w)"""
    + _columns("sslim", "scol", "book_id, page, s")
    + """, span as (select x.book_id, x.page, x.s, x.k, x.t, x.b from strip x join sbody y using (book_id, page, s) join scol c using (book_id, page, s)
  where y.m > 1 and x.r - x.l >= 0.6 * y.w and c.g.r > c.g.l and least(x.r, c.g.r) - greatest(x.l, c.g.l) >= 0.5 * (c.g.r - c.g.l) group by all having count(*) >= 2),
 sord as (select *, row_number() over (partition by book_id, page, s order by t, k) as o from span),
 place as (select x.book_id, x.page, x.s, x.k, coalesce(max(2 * o.o - 1) filter (o.k = x.k), 2 * count(*) filter (o.k is not null and o.t + o.b <= x.t + x.b)) as p from strip x left join sord o on o.book_id = x.book_id and o.page = x.page and o.s = x.s group by 1, 2, 3, 4)"""
)
_CARDS = """, okr as (select book_id, page, x, y, width, height, x as l, y as t, x + width as r, y + height as b, image_height as ph, row_number() over (partition by book_id, page order by y, x, height, width) as n from reg
  where book_id is not null and page is not null and x is not null and y is not null and width is not null and height is not null and image_width is not null and image_height is not null),
 card as (select distinct book_id, page, cast(0 as bigint) as n, cast([] as struct(l int, t int, r int, b int, m int)[]) as cs from okr
  union all select c.book_id, c.page, i.n, (select case when h = 0 then list_append(c.cs, {'l': i.l, 't': i.t, 'r': i.r, 'b': i.b, 'm': 1})
   else list_transform(c.cs, lambda g, j: case when j = h then {'l': least(g.l, i.l), 't': least(g.t, i.t), 'r': greatest(g.r, i.r), 'b': greatest(g.b, i.b), 'm': g.m + 1} else g end) end
   from (select coalesce(list_position(list_transform(c.cs, lambda g: i.t - g.b <= cast(trunc(i.ph * 0.02) as int) and i.r > i.l and least(g.r, i.r) - greatest(g.l, i.l) > 0.3 * (i.r - i.l)), true), 0) as h))
  from card c join okr i on i.book_id = c.book_id and i.page = c.page and i.n = c.n + 1),
 cards as (select book_id, page, arg_max(cs, n) as cs from card group by book_id, page)"""

SQL: dict[str, str] = {
    "rect_dedupe": f"with recursive {_RECTS} select book_id, page, cast(k as int) as block_no, l as x, t as y, r - l as width, b - t as height from rect",
    "page_columns": f"""with recursive {_RECTS}{_COLUMNS} select book_id, page, n as block_no, g.l as x, g.t as y, g.r - g.l as width, g.b - g.t as height, cast(len(g.ls) as int) as members from cols""",
    "column_cover": f"""with recursive {_RECTS}{_COLUMNS} select book_id, page, cast(k as int) as block_no, cast(count(*) filter (g.r > g.l and least(r, g.r) - greatest(l, g.l) >= 0.5 * (g.r - g.l)) as int) as columns from rect join cols using (book_id, page) group by book_id, page, k""",
    "undone_columns": f"""with recursive {_RECTS}{_COLUMNS}, un as (select a.book_id, a.page, a.n, a.g, len(a.g.ks) > 1 and (select count(*) from cols o where o.book_id = a.book_id and o.page = a.page and o.n <> a.n and o.g.r > o.g.l
  and least(a.g.r, o.g.r) - greatest(a.g.l, o.g.l) >= 0.5 * (o.g.r - o.g.l) and least(a.g.b, o.g.b) > greatest(a.g.t, o.g.t)) >= 2 as apart from cols a),
 parts as (select book_id, page, n, 0 as j, g.l as l, g.t as t, g.r as r, g.b as b, len(g.ks) as m from un where not apart
  union all select u.book_id, u.page, u.n, u.j, x.l, x.t, x.r, x.b, 1 from (select book_id, page, n, unnest(g.ks) as k, unnest(range(1, len(g.ks) + 1)) as j from un where apart) u join rect x on x.book_id = u.book_id and x.page = u.page and x.k = u.k)
 select book_id, page, cast(row_number() over (partition by book_id, page order by n, j) - 1 as int) as block_no, l as x, t as y, r - l as width, b - t as height, cast(m as int) as members from parts""",
    "stacked_columns": f"""with recursive {_PARTS}
 select book_id, page, cast(c as int) as column_no, cast(part as int) as part, min(l) as x, min(t) as y, max(r) - min(l) as width, max(b) - min(t) as height, cast(count(*) as int) as members from part group by book_id, page, c, part""",
    "rejoined_columns": f"""with recursive {_PARTS}, blk2 as (select book_id, page, cast(row_number() over (partition by book_id, page order by c, part) - 1 as int) as i, min(l) as l, min(t) as t, max(r) as r, max(b) as b, count(*) as m, any_value(pw) as pw, any_value(ph) as ph from part group by book_id, page, c, part),
 pair as (select a.book_id, a.page, a.i, b.i as j, case when a.b <= b.t then a.b else b.b end as low, case when a.b <= b.t then b.t else a.t end as top, case when a.b <= b.t then a.l else b.l end as ul, case when a.b <= b.t then a.r else b.r end as ur,
  case when a.b <= b.t then b.l else a.l end as ll, case when a.b <= b.t then b.r else a.r end as lr, a.pw, a.ph from blk2 a join blk2 b on a.book_id = b.book_id and a.page = b.page and a.i < b.i
  where least(a.r - a.l, b.r - b.l) >= a.pw * 0.25 and least(a.b - a.t, b.b - b.t) >= a.ph * 0.08 and abs((a.r - a.l) - (b.r - b.l)) <= 0.25 * greatest(a.r - a.l, b.r - b.l) and least(a.b, b.b) - greatest(a.t, b.t) <= 0
   and abs(a.l - b.l) <= a.pw * 0.015 * 2 and least(a.r, b.r) - greatest(a.l, b.l) >= 0.6 * least(a.r - a.l, b.r - b.l)),
 mid as (select p.book_id, p.page, p.i, p.j, p.top - p.low <= p.ph * 0.05 as near, h.r - h.l >= p.pw * 0.35 and h.b - h.t <= p.ph * 0.05 as heading, least(h.r, p.ur) - greatest(h.l, p.ul) > 0.2 * (p.ur - p.ul) as wall,
  p.ur > p.ul and least(h.r, p.ur) - greatest(h.l, p.ul) >= 0.5 * (p.ur - p.ul) and p.lr > p.ll and least(h.r, p.lr) - greatest(h.l, p.ll) >= 0.5 * (p.lr - p.ll) as spans
  from pair p join blk2 h on h.book_id = p.book_id and h.page = p.page and h.i <> p.i and h.i <> p.j and ((h.t < p.top and h.b > p.low) or (h.t >= p.low - 2 and h.b <= p.top + 2))),
 ok as (select book_id, page, i, j from mid group by 1, 2, 3, 4 having case when bool_or(wall) then bool_or(heading and spans) and not bool_or(wall and not (heading and spans)) else bool_or(near and heading) end),
 way as (select book_id, page, i as a, j as b from ok union select book_id, page, j, i from ok), lead_ as (select book_id, page, i as a, i as x from blk2 union select l.book_id, l.page, l.a, w.b from lead_ l join way w on w.book_id = l.book_id and w.page = l.page and w.a = l.x),
 home as (select book_id, page, a as i, min(x) as h from lead_ group by 1, 2, 3)
 select book_id, page, h as block_no, min(l) as x, min(t) as y, max(r) - min(l) as width, max(b) - min(t) as height, cast(sum(m) as int) as members from blk2 join home using (book_id, page, i) group by book_id, page, h""",
    "first_joins": f"""with recursive {_RECTS.replace("okr as (select book_id, page, x, y, width, height, image_width as pw, image_height as ph", "okr as (select book_id, page, y as x, x as y, height as width, width as height, image_height as pw, image_width as ph")}{_COLUMNS}, pr as (select a.book_id, a.page, a.n as i, b.n as j, a.g as p, b.g as q, s.pw as pw, s.ph as ph, greatest(a.g.l - b.g.r, b.g.l - a.g.r, 0) as far from cols a join cols b on a.book_id = b.book_id and a.page = b.page and a.n <> b.n join size s on s.book_id = a.book_id and s.page = a.page),
 fr as (select *, q.b - q.t as tall from pr where p.r - p.l <= pw * 0.1 and far <= pw * 0.08 and abs(p.t - q.t) <= ph * 0.03 and p.b - p.t <= (q.b - q.t) * 0.5)
 select book_id, page, 'fragment' as kind, j as into, i as gone from fr qualify row_number() over (partition by book_id, page order by i, far, tall desc, j) = 1
 union all select book_id, page, 'profile', i, j from pr where i < j and abs(p.t - q.t) <= ph * 0.03 and ((abs(p.b - q.b) <= ph * 0.03 and far <= pw * 0.25) or (far <= pw * 0.08 and greatest(p.b - p.t, q.b - q.t) > 0
  and least(p.b - p.t, q.b - q.t) >= 0.88 * greatest(p.b - p.t, q.b - q.t))) qualify row_number() over (partition by book_id, page order by i, j) = 1""",
    "page_bands": f"""with recursive {_RECTS}{_BANDS} select book_id, page, cast(k as int) as block_no, cast(dense_rank() over (partition by book_id, page order by s, p) - 1 as int) as band from place""",
    "block_outlines": f"""with recursive {_RECTS}, e as (select *, case when r - l <= pw * 0.2 and b - t <= ph * 0.05 then least(r - l, b - t) * 0.03 else 0.0 end as extra from rect),
 lim as (select a.book_id, a.page, a.k, max(case when o.r <= a.l and least(a.b, o.b) > greatest(a.t, o.t) then (o.r + a.l) / 2 end) as lo_x, min(case when o.l >= a.r and least(a.b, o.b) > greatest(a.t, o.t) then (o.l + a.r) / 2 end) as hi_x,
  max(case when o.b <= a.t and least(a.r, o.r) > greatest(a.l, o.l) then (o.b + a.t) / 2 end) as lo_y, min(case when o.t >= a.b and least(a.r, o.r) > greatest(a.l, o.l) then (o.t + a.b) / 2 end) as hi_y
  from e a left join e o on o.book_id = a.book_id and o.page = a.page and o.k <> a.k group by 1, 2, 3),
 q as (select e.*, greatest(round_even(greatest(l - pw * 0.006 - extra, coalesce(lo_x, -1e18)), 0), 0) as x0, greatest(round_even(greatest(t - ph * 0.006 - extra, coalesce(lo_y, -1e18)), 0), 0) as y0,
  least(round_even(least(r + pw * 0.006 + extra, coalesce(hi_x, 1e18)), 0), pw) as x1, least(round_even(least(b + ph * 0.006 + extra, coalesce(hi_y, 1e18)), 0), ph) as y1 from e join lim using (book_id, page, k))
 select book_id, page, cast(k as int) as block_no, cast(x0 as int) as x, cast(y0 as int) as y, cast(greatest(x1 - x0, 1) as int) as width, cast(greatest(y1 - y0, 1) as int) as height from q""",
    "card_clusters": f"""with recursive {_REG}{_CARDS} select book_id, page, cast(j - 1 as int) as block_no, cs[j].l as x, cs[j].t as y, cs[j].r - cs[j].l as width, cs[j].b - cs[j].t as height, cs[j].m as members from (select *, unnest(range(1, len(cs) + 1)) as j from cards)""",
    "doc_physical_lines": f"with {_lines('documents', 'doc_id', 'text')} select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as line_no, t as text, a as line_start, z as line_end from lines",
    "line_join_decisions": f"with {_BLK}, {_lines('blk', 'block_id', 'raw_text')}{_DECIDE} select block_id, cast(row_number() over (partition by block_id order by i) - 1 as int) as line_no, should_join, case when should_join then 'ja-word-wrap-v1' end as rule_id, review_reason from ruled where r is not null",
    "normalized_blocks": f"with {_NORM} select block_id, book_id, page, draw_order, normalized_text, joins, reasons as review_reasons from norm",
    "normalization_ops": f"with {_BLK}, {_lines('blk', 'block_id', 'raw_text')}{_DECIDE} select block_id, cast(row_number() over (partition by block_id order by i) - 1 as int) as op_no, z as left_end, next_a as right_start from ruled where should_join",
    "audience_by_page": f"with {_SESS}, {_BOOKS} select s.book_id, s.page, coalesce(list_filter(ao, lambda o: s.page between o.start_page and o.end_page)[-1].audience, da, 'unknown') as audience from sess s left join bk using (book_id)",
    "document_type_by_page": f"with {_SESS}, {_BOOKS} select s.book_id, s.page, coalesce(list_filter(dto, lambda o: s.page between o.start_page and o.end_page)[1].document_type, dt, 'unknown') as document_type from sess s left join bk using (book_id)",
    "inherited_audience": f"""with {_SEG} select book_id, section_path[1] as chapter, case when bool_or(audience = 'gm') then 'gm' when bool_or(audience = 'unknown' or audience is null) then 'unknown'
 when min(audience) = max(audience) then min(audience) else 'shared' end as audience, count(*) as segments from seg group by 1, 2""",
    "structure_windows": f"""with {_BLK}, k as (select book_id, page, string_agg(block_id, ',' order by draw_order, block_id) as allowed, arg_min(block_id, (draw_order, block_id)) as f, arg_max(block_id, (draw_order, block_id)) as l from blk group by 1, 2)
 select k.book_id, k.page, k.allowed, concat_ws(',', p.l, k.allowed, n.f) as context from k left join k p on p.book_id = k.book_id and p.page = k.page - 1 left join k n on n.book_id = k.book_id and n.page = k.page + 1""",
    "window_cache_keys": f"""with {_NORM}, k as (select book_id, page, list(block_id order by draw_order, block_id) as ids from norm group by 1, 2),
 c as (select k.book_id, k.page, list_concat(case when p.ids is null then [] else [p.ids[-1]] end, k.ids, case when n.ids is null then [] else [n.ids[1]] end) as ids
  from k left join k p on p.book_id = k.book_id and p.page = k.page - 1 left join k n on n.book_id = k.book_id and n.page = k.page + 1),
 u as (select book_id, page, ids[i] as block_id, i from (select *, unnest(range(1, len(ids) + 1)) as i from c)),
 ol as (select book_id, 'outline|unknown|' || min(page) || '|' || max(page) || '|unknown' as section from norm group by 1),
 mf as (select book_id, sha256(concat_ws('|', book_id, coalesce(any_value(title), ''), coalesce(any_value(input_glob), ''), coalesce(any_value(page_pattern), ''), coalesce(any_value(default_document_type), ''), coalesce(any_value(default_audience), ''),
  coalesce(array_to_string(list_transform(any_value(audience_overrides), lambda o: o.start_page || ':' || o.end_page || ':' || o.audience), ','), ''),
  coalesce(array_to_string(list_transform(any_value(document_type_overrides), lambda o: o.start_page || ':' || o.end_page || ':' || o.document_type), ','), ''))) as m from books group by 1),
 dg as (select u.book_id, u.page, sha256(any_value(ol.section) || chr(10) || string_agg(concat_ws('|', n.block_id, n.page, n.draw_order, n.raw_text, n.normalized_text, n.inherited_audience), chr(10) order by u.i)) as context_digest
  from u join norm n on n.block_id = u.block_id and n.book_id = u.book_id join ol on ol.book_id = u.book_id group by 1, 2)
 select book_id, page, context_digest, sha256(concat_ws('|', context_digest, 'sha256:' || coalesce(mf.m, sha256(book_id)), 'ja-word-wrap-v1', 'proposal-v1', 'default-v1', '1')) as cache_key from dg left join mf using (book_id)""",
    "page_chunks": f"with {_SESS} select book_id, cast(floor((page - 1) / 15) as int) as chunk, count(*) as pages, min(page) as first_page, max(page) as last_page from sess group by 1, 2",
    "proposal_validity": f"{_PAIRS} select book_id, page, segment_id, coalesce(failure, 'valid') as verdict from claim",
    "assembled_segments": f"with recursive {_NORM}, {_SEG}{_PROP}{_ASM} select segment_id, book_id, page, first_order, content_type, audience, inherited_audience, document_type, blocks, normalized_text, joins, case when len(rl) > 0 then 'required' else 'not_required' end as review_status from asm",
    "assembly_reasons": f"with recursive {_NORM}, {_SEG}{_PROP}{_ASM} select book_id, reason, count(*) as segments from (select book_id, unnest(rl) as reason from asm) group by 1, 2",
    "classified_pages": f"with {_NORM} select book_id, page, document_type = 'scenario' as reused, cast(1 as int) as proposals, cast(null as varchar) as error from norm group by 1, 2, 3",
    "default_segments": f"""with {_NORM}, g as (select book_id, page, list(block_id order by draw_order, block_id) as ids, any_value(inherited_audience) as audience, string_agg(normalized_text, chr(10) || chr(10)) as t, bool_or(len(reason_list) > 0) as why from norm group by 1, 2)
 select book_id || '-' || left(sha256(book_id || '|' || array_to_string(ids, ',') || '|rule.explanation|'), 16) as segment_id, book_id, page, 'rule.explanation' as content_type, audience, cast(len(ids) as int) as blocks, cast(length(t) as int) as chars, case when why then 'required' else 'not_required' end as review_status from g""",
    "fallback_outline": f"with {_BLK} select book_id, min(page) as start_page, max(page) as end_page, 'unknown' as title, 'unknown' as default_content_type, 'low' as confidence from blk group by 1",
    "outline_samples": f"with {_BLK} select block_id, page, left(string_split(raw_text, chr(10))[1], 60) as first_line, left(raw_text, 120) as sample from blk",
    "source_coverage": f"with {_BLK}, {_SEG}, {_SPAN}{_RUNS} select book_id, cast(coalesce(sum(case when depth > 0 then b - a end), 0) as bigint) as covered, cast(sum(b - a) as bigint) as total, round(coalesce(sum(case when depth > 0 then b - a end), 0) / sum(b - a), 6) as ratio from runs group by 1",
    "source_gaps": f"with {_BLK}, {_SEG}, {_SPAN}{_RUNS}{_GAPS} select * from gaps",
    "source_overlaps": f"with {_BLK}, {_SEG}, {_SPAN}{_RUNS}{_OVER} select * from overs",
    "source_order_reversals": f"""with recursive seg as (select * from (select segment_id, source_spans from (select * from segments qualify row_number() over (partition by segment_id order by loaded_at desc) = 1)) union all
 select segment_id || '~', list_reverse(source_spans) from (select * from segments qualify row_number() over (partition by segment_id order by loaded_at desc) = 1)), {_ERR[_ERR.index("rev0 as") : _ERR.index(",\n errs as")]} select segment_id, page, rect_id, "at" from rev""",
    "invalid_references": f'{_ALLERR} select segment_id, page, rect_id, a as "start", b as "end" from inv',
    "parent_cycles": f"with recursive {_CYCLE} select segment_id, root_id from ring",
    "player_visibility": f"with {_SEG} select segment_id, audience || '_audience_visible' as code from seg where review_status <> 'rejected' and audience in ('gm', 'unknown')",
    "validation_errors": f"{_ALLERR} select code, count(*) as errors, count(segment_id) as with_segment from errs group by 1",
    "exit_codes": f"""with recursive {_BLK}, {_SEG}, {_SPAN}{_PROP}{_RUNS}{_GAPS}{_OVER}, bp as (select book_id, page, count(*) filter (failure is null) as ok from claim group by 1, 2),
 per as (select book_id, count(*) as classified, count(*) filter (ok = 0) as failed from bp group by 1), er as (select book_id, count(*) as errors from (select book_id from gaps union all select book_id from overs) group by 1)
 select book_id, classified, failed, coalesce(errors, 0) as errors, cast(case when failed > 0 and failed >= classified then 3 when coalesce(errors, 0) > 0 then 4 else 0 end as int) as exit_code from per left join er using (book_id)""",
    "review_queue": f"with {_SESS}, {_SEG}, {_NEAR} select book_id || ':' || segment_id as review_id, segment_id, array_to_string(reasons, ',') as reasons, severity, page, image_name, sha256(before || '|' || after) as context from rq",
    "review_markdown": f"""with {_SESS}, {_SEG}, {_NEAR}, md as (select *, book_id || ':' || segment_id as review_id, row_number() over (partition by book_id order by page nulls first, rect_id nulls first, first_start nulls first, segment_id) as item from rq),
 ex as (select *, '",' || chr(10) || '  "input_hash": "<source-sha256-or-input-hash>",' || chr(10) || '  "processing_version": "<pipeline-or-prompt-version>",' || chr(10) || '  "decided_by": "<reviewer-id>",' || chr(10) || '  "comment": ""' || chr(10) || '}}' as rest,
  '{{' || chr(10) || '  "review_id": ' || cast(to_json(review_id) as varchar) || ',' || chr(10) || '  "segment_id": ' || cast(to_json(segment_id) as varchar) || ',' || chr(10) || '  "status": "' as open from md)
 select book_id, cast(0 as int) as item, '# レビューキュー' || chr(10) || chr(10) || '件数: ' || count(*) || chr(10) as markdown from md group by book_id
 union all select book_id, cast(item as int), concat_ws(chr(10), '## ' || item || '. ' || review_id, '', '- **review_id**: `' || review_id || '`', '- **segment_id**: `' || segment_id || '`', '- **危険度 (severity)**: ' || severity, '- **理由 (reasons)**: ' || array_to_string(reasons, ', '),
  '- **書籍 (book_id)**: ' || book_id, '- **ページ (page)**: ' || coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(source_spans, lambda x: x.page), lambda v: v is not null))), ', '), ''),
  '- **rect_id**: ' || coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(source_spans, lambda x: x.rect_id), lambda v: v is not null))), ', '), ''), '- **元画像名 (image_name)**: ' || coalesce(nullif(image_name, ''), '(なし)'), '- **status**: `' || review_status || '`', '',
  '### 原文 (raw_text)', '', '```text', coalesce(raw_text, ''), '```', '', '### 正規化案 (normalized_text)', '', '```text', coalesce(normalized_text, ''), '```', '',
  '### 前文脈 (context_before)', '', '```text', coalesce(nullif(before, ''), '(なし)'), '```', '', '### 後文脈 (context_after)', '', '```text', coalesce(nullif(after, ''), '(なし)'), '```', '',
  '### 承認時に記録する JSON 例', '', '```json', open || 'approved' || rest, '```', '', '### 却下時に記録する JSON 例', '', '```json', open || 'rejected' || rest, '```', '') from ex""",
    "apply_review_decisions": f"with {_SEG}, {_DECISION} select segment_id, outcome, new_status as review_status, array_to_string(new_rs, ',') as reasons from decided",
    "flagged_segments": f"""{_ALLERR}, {_DECISION}, codes as (select segment_id, list(distinct code order by code) as codes from errs where segment_id is not null group by 1)
 select segment_id, case when codes is not null then 'required' else new_status end as review_status, array_to_string(list_concat(new_rs, list_filter(coalesce(codes, []), lambda c: not list_contains(new_rs, c))), ',') as reasons from decided left join codes using (segment_id)""",
    "source_hashes": f"with {_SEG}, {_DECISION} select segment_id, ih as input_hash from hashed",
    "retrieval_view": f"with {_SEG}, {_BOOKS}, {_VIEW} select segment_id, 'document' as input_type, '検索文書: 書籍: ' || coalesce(title, book_id) || {_BODY} as text, book_id, audience, content_type, cast(len(source_spans) as int) as spans from vis left join bk using (book_id)",
    "topic_view": f"with {_SEG}, {_VIEW} select segment_id, 'topic' as input_type, 'トピック: ' || coalesce(array_to_string(entities, '、'), '') || {_BODY} as text, book_id, audience, content_type, cast(len(source_spans) as int) as spans from vis",
    "structure_metrics": f"""with {_SEG}, {_BOOKS}, fs as (select *, source_spans[1].page as page from seg),
 act as (select segment_id, book_id, source_spans[1:1] as spans, case when coalesce(list_filter(dto, lambda o: page between o.start_page and o.end_page)[1].document_type, dt, 'unknown') = 'scenario' then 'scenario.scene' else content_type end as ct,
  coalesce(list_filter(ao, lambda o: page between o.start_page and o.end_page)[-1].audience, da, 'unknown') as au from fs left join bk using (book_id)),
 gold as (select * from seg where review_status = 'approved'),
 chars as (select distinct book_id, s.page as page, s.rect_id as rect_id, unnest(range(s."start", s."end")) as c from (select book_id, unnest(source_spans) as s from gold) where s.page is not null and s.rect_id is not null),
 achars as (select distinct book_id, s.page as page, s.rect_id as rect_id, unnest(range(s."start", s."end")) as c from (select book_id, unnest(spans) as s from act) where s.page is not null and s.rect_id is not null),
 cov as (select round(count(a.c) / count(*), 6) as source_coverage from chars g left join achars a using (book_id, page, rect_id, c)),
 j as (select g.*, act.ct, act.au, list_sort(list_distinct(list_transform(g.source_spans, lambda s: cast(s as varchar)))) = list_sort(list_distinct(list_transform(act.spans, lambda s: cast(s as varchar)))) as same from gold g left join act using (segment_id))
 select (select source_coverage from cov) as source_coverage, round(count(*) filter (same) / count(*), 6) as boundary_match, round(count(*) filter (content_type = ct) / count(*), 6) as content_type_match,
  round(count(*) filter (audience = au) / count(*), 6) as audience_match, count(*) filter (audience = 'gm' and au in ('player', 'shared')) as critical_audience_errors from j""",
    "ranking_scores": f"with {_RANK} select * from sc",
    "ranking_metrics": f"with {_RANK} select round(avg(recall_at_k), 5) as recall_at_k, round(avg(reciprocal_rank), 5) as mrr, round(avg(ndcg_at_k), 5) as ndcg_at_k from sc",
    "schema_union": f"""with {_TYPED}, f as (select type_name, "at", unnest(map_keys(item)) as field, unnest(range(0, len(map_keys(item)))) as pos from items), m as (select type_name, field, min(("at", pos)) as p from f group by 1, 2)
 select type_name, string_agg(field, chr(9) order by p) as fields from m group by 1""",
    "gamedata_pivot": f"""with {_TYPED}, f as (select type_name, "at", unnest(map_keys(item)) as field, unnest(range(0, len(map_keys(item)))) as pos from items), m as (select type_name, field, min(("at", pos)) as p from f group by 1, 2)
 select i.type_name, i."at", string_agg(case when coalesce(item[m.field], '') in ('一', '－', 'ー', '−', '-', '–', '—', '―') then '-' else coalesce(item[m.field], '') end, chr(9) order by m.p) as line from items i join m using (type_name) group by i.type_name, i."at" """,
    "typed_rows_routed": f"""with {_TYPED}, declared as (select * from (values ('view', ['k', 'value']), ('purchase', ['value', 'k', 'note'])) v(type_name, fields)),
 f as (select type_name, "at", unnest(map_keys(item)) as field, unnest(range(0, len(map_keys(item)))) as pos from items), m as (select type_name, field, min(("at", pos)) as p from f group by 1, 2),
 found as (select type_name, list(field order by p) as found from m group by 1),
 j as (select i.*, d.fields is not null as matched, coalesce(d.fields, found.found) as fs from items i left join declared d using (type_name) left join found using (type_name))
 select case when matched then '' else 'none_' end || type_name || '.tsv' as file, type_name, "at", array_to_string(list_append(list_transform(fs, lambda x: case when coalesce(item[x], '') in ('一', '－', 'ー', '−', '-', '–', '—', '―') then '-' else coalesce(item[x], '') end), source), chr(9)) as line, matched from j""",
    "json_lines": """select '{"review_id":' || to_json(review_id) || ',"segment_id":' || to_json(segment_id) || ',"status":' || to_json(status) || ',"decided_by":' || coalesce(cast(to_json(decided_by) as varchar), 'null') || ',"comment":' || coalesce(cast(to_json(comment) as varchar), 'null') || '}' as value
 from (select distinct review_id, segment_id, status, decided_by, comment from review_decisions)""",
    "cache_outcomes": f"with {_SEG}, {_CACHE} select * from oc",
    "cache_summary": f"""with {_SEG}, {_CACHE} select outcome, count(*) as n, cast(list_position(['hit', 'missing', 'corrupted', 'cache_version_mismatch', 'schema_mismatch', 'prompt_mismatch', 'model_mismatch', 'extractor_mismatch', 'result_schema_mismatch', 'validator_mismatch',
 'source_mismatch', 'invalid_shape'], outcome) as int) as place from oc group by 1""",
    "resume_worklist": f"with {_BLK}, {_SEG}, {_SPAN} select block_id from blk where (book_id, page, rect_id) not in (select (book_id, page, rect_id) from spans)",
    "stale_outputs": f"with {_SESS}, {_SEG}, {_SPAN} select distinct book_id, page from spans where (book_id, page) not in (select (book_id, page) from sess where page is not null and len(list_filter(regions, lambda r: r.ocr_status is distinct from 'done')) = 0)",
    "stem_collisions": r"""select stem, cast(count(*) as int) as n, string_agg(book_id, ',' order by book_id) as members from (select distinct regexp_replace(file_name, '\..*$', '') as stem, book_id from region_sessions) group by 1 having count(*) > 1""",
    "session_merge": f"""with x as (select *, {_PAGE} as page, dense_rank() over (partition by book_id, {_PAGE} order by saved_at, session_id) as no from region_sessions),
 r as (select book_id, page, no, u.rectangle.rect_id as rect_id, u.rectangle.draw_order as draw_order, u.rectangle.x as x, u.rectangle.y as y, u.text as text, u.ocr_status as st, max(no) over (partition by book_id, page) as last
  from (select book_id, page, no, unnest(regions) as u from x where page is not null)),
 b as (select *, row_number() over (partition by book_id, page, rect_id order by no desc) as back from r where rect_id is not null),
 k as (select * from b where no + back = last + 1),
 d as (select book_id, page, rect_id, min(no) as first from k where st = 'done' group by all)
 select n.book_id, n.page, n.rect_id, n.draw_order, n.x, n.y, case when d.first < n.no then o.text else n.text end as text, case when d.first < n.no then o.st else n.st end as ocr_status, coalesce(d.first < n.no, false) as kept
  from k n left join d using (book_id, page, rect_id) left join k o on o.book_id = n.book_id and o.page = n.page and o.rect_id = n.rect_id and o.no = d.first where n.no = n.last""",
    "undone_regions": f"""with {_REG}, c as (select image_name from (select distinct image_name, book_id || '/' || file_name as m from region_sessions where image_name is not null) group by 1 having count(*) > 1)
 select image_name, rect_id, draw_order, ocr_status from reg where ocr_status in ('pending', 'error') and image_name is not null and image_name not in (select image_name from c)""",
    "region_markdown": f"with {_REG} select book_id, page, string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by draw_order, rect_id) as markdown from reg where ocr_status = 'done' group by 1, 2",
    "next_draw_order": f"with {_REG} select book_id, page, coalesce(max(draw_order), -1) + 1 as next_order from reg group by 1, 2",
    "perf_by_step": f"""with {_TIME} select step_name, round(sum(elapsed), 4) as real_total, round(avg(elapsed), 4) as real_avg, round(coalesce(sum(elapsed) filter (outcome = 'success'), 0.0), 4) as success_total, round(coalesce(avg(elapsed) filter (outcome = 'success'), 0.0), 4) as success_avg,
 count(*) as attempts, count(*) filter (outcome = 'error') as failures, min(seq) as first_seq from t where kind = 'step' group by 1""",
    "perf_by_file": f"""with {_TIME} select file_key, round(sum(elapsed), 4) as real_total, round(coalesce(sum(elapsed) filter (kind = 'step' and outcome = 'success'), 0.0), 4) as success_total, round(coalesce(sum(elapsed) filter (kind = 'wait'), 0.0), 4) as waited,
 count(*) filter (kind = 'step') as attempts, count(*) filter (outcome = 'error') as failures, arg_max(step_name, seq) filter (outcome = 'error') as last_failure from t group by 1""",
    "perf_waits": f"with {_TIME} select round(coalesce(sum(elapsed), 0.0), 4) as total, round(coalesce(avg(elapsed), 0.0), 4) as mean, count(*) as n from t where kind = 'wait'",
    "redact_secrets": """select doc_id, regexp_replace(text, '(?is)(\\b\\w*(?:SECRET|TOKEN|CREDENTIAL|PASSWORD|API_KEY)\\w*\\s*=)\\s*(?:"(?:\\\\.|[^"\\\\])*"|''(?:\\\\.|[^''\\\\])*''|[^\\s"''`]+)', '\\1[REDACTED]', 'g') as text from documents""",
    "handoff_summary": f"""with {_LOG}, o as (select session, value, min((decided_at, processing_version, input_hash)) as p from log where coalesce(value, '') <> '' group by 1, 2), d as (select session, string_agg(value, ',' order by p, value) as deciders from o group by 1)
 select session, arg_max(value, (decided_at, processing_version, input_hash)) filter (type = 'approved' and value is not null) as last_approver, arg_max(value, (decided_at, processing_version, input_hash)) filter (type = 'rejected' and value is not null) as last_rejecter, any_value(deciders) as deciders
 from log left join d using (session) group by 1""",
    "handoff_reports": f"""with {_LOG}, r as (select *, row_number() over (partition by session order by decided_at desc, processing_version desc, input_hash desc, type desc, value desc nulls last) as k from log
 where regexp_matches(text, 'Gate|Phase|フェイズ|完了報告|検証結果|次は|approved')) select session, cast(count(*) as int) as n, string_agg(text, chr(10) order by k desc) as reports from r where k <= 5 group by 1""",
    "handoff_tasks": f"""with {_SEG}, u as (select string_split(review_id, ':')[1] as session, segment_id as task_id from review_decisions group by 1, 2)
 select book_id as session, s.segment_id as task_id, 'review ' || s.segment_id as subject, case when u.task_id is not null then 'completed' else review_status end as status from seg s left join u on u.session = s.book_id and u.task_id = s.segment_id where review_status in ('required', 'approved')""",
    "rect_clamp": f'with {_BOX} select book_id, page, rect_id, "left", top, "right", bottom from box',
    "card_area_filter": f'with {_BOX}, a as (select book_id, page, rect_id, ("right" - "left") * (bottom - top) / (image_width * image_height) as r from box where image_width * image_height > 0) select book_id, page, rect_id, round(r, 6) as ratio from a where r between 0.05 and 0.80',
    "card_boxes": f'with {_BOX} select book_id, page, rect_id, greatest("left" - 15, 0) as "left", greatest(top - 15, 0) as top, least("right" + 15, image_width) as "right", least(bottom + 15, image_height) as bottom from box',
    "perimeter_filter": f"""with {_BOX}, i as (select *, bottom <= image_height * 0.07 or top >= image_height - image_height * 0.07 as inside from box)
 select book_id, page, rect_id from i where not inside or bottom - top > image_height * 0.04 or exists (select 1 from i o where o.book_id = i.book_id and o.page = i.page and not o.inside and least(o."right", i."right") > greatest(o."left", i."left")
  and greatest(o.top - i.bottom, i.top - o.bottom, 0) <= i.image_height * 0.02)""",
    "noise_filter": f"""with {_BOX}, i as (select *, bottom - top as h, "right" - "left" as w from box)
 select book_id, page, rect_id from i where h >= image_height * 0.04 * 0.35 and (h >= image_height * 0.04 or w / greatest(h, 1) < 8.0 or w / image_width >= 0.35
  or (w / image_width >= 0.25 and exists (select 1 from i o where o.book_id = i.book_id and o.page = i.page and o.rect_id <> i.rect_id and abs(o.top + o.bottom - i.top - i.bottom) / 2 <= i.image_height * 0.03
   and least(o."right", i."right") - greatest(o."left", i."left") <= 0 and o.w >= i.image_width * 0.12))
  or exists (select 1 from i o where o.book_id = i.book_id and o.page = i.page and o.rect_id <> i.rect_id and o.h >= i.image_height * 0.04 and abs(o."left" - i."left") <= i.image_width * 0.015 * 3 and greatest(o.top - i.bottom, i.top - o.bottom, 0) < i.image_height * 0.08))""",
    "y_gap_bands": f"""with {_BOX}, a as (select *, max(bottom) over (partition by book_id, page order by top, "left", rect_id rows between unbounded preceding and 1 preceding) as above from box),
 n as (select *, case when top - above >= image_height * 0.016 then 1 else 0 end as new from a) select book_id, page, rect_id, cast(sum(new) over (partition by book_id, page order by top, "left", rect_id) as bigint) as band from n""",
    "hit_test": f"""with {_BOX} select book_id, page, arg_min(rect_id, (("right" - "left") * (bottom - top), draw_order, rect_id)) as rect_id from box where image_width // 2 >= "left" and image_width // 2 < "right" and image_height // 2 >= top and image_height // 2 < bottom group by 1, 2""",
    "iou_pairs": f"""with {_BOX.replace("box as (select * from (", "tight as (select * from (")}, box as (select book_id, page, rect_id, greatest("left" - 40, 0) as "left", greatest(top - 40, 0) as top, least("right" + 40, image_width) as "right", least(bottom + 40, image_height) as bottom from tight), p as (select a.book_id, a.page, a.rect_id as rect_1, b.rect_id as rect_2, greatest(least(a."right", b."right") - greatest(a."left", b."left"), 0) * greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0) as i,
  (a."right" - a."left") * (a.bottom - a.top) as x, (b."right" - b."left") * (b.bottom - b.top) as y from box a join box b on a.book_id = b.book_id and a.page = b.page and a.rect_id < b.rect_id)
 select book_id, page, rect_1, rect_2, round(i / (x + y - i), 6) as iou from p where i > 0""",
    "box_matches": f"""with recursive {_BOX}, w as (select *, greatest("left" - 40, 0) as wl, greatest(top - 40, 0) as wt, least("right" + 40, image_width) as wr, least(bottom + 40, image_height) as wb from box),
 pi as (select a.book_id, a.page, a.rect_id as one, b.rect_id as two, greatest(least(a.wr, b."right") - greatest(a.wl, b."left"), 0) * greatest(least(a.wb, b.bottom) - greatest(a.wt, b.top), 0) as i,
  (a.wr - a.wl) * (a.wb - a.wt) as x, (b."right" - b."left") * (b.bottom - b.top) as y from w a join w b on a.book_id = b.book_id and a.page = b.page),
 ps as (select book_id, page, one, two, round(i / (x + y - i), 9) as share from pi where i > 0), pr as (select *, row_number() over (partition by book_id, page order by share desc, one, two) as n from ps where share > 0),
 gm as (select distinct book_id, page, cast(0 as bigint) as n, cast([] as varchar[]) as ones, cast([] as varchar[]) as twos, cast(null as varchar) as one, cast(null as varchar) as two, cast(null as double) as share from pr
  union all select g.book_id, g.page, p.n, case when ok then list_append(g.ones, p.one) else g.ones end, case when ok then list_append(g.twos, p.two) else g.twos end, case when ok then p.one end, case when ok then p.two end, p.share
  from gm g join pr p on p.book_id = g.book_id and p.page = g.page and p.n = g.n + 1, lateral (select not list_contains(g.ones, p.one) and not list_contains(g.twos, p.two) as ok))
 select book_id, page, one as detected, two as expected, round(share, 6) as iou from gm where one is not null""",
    "flatten_rules": f"with recursive {_CYCLE} select id, root_id as root, depth, cast(row_number() over (partition by root_id order by path) as int) as place from up",
    "batch_event_stream": """select cast(date_trunc('day', ts) as timestamp) as day, user_id, count(*) as events, count(*) filter (event_type = 'error') as failures, round(sum(value), 4) as elapsed from events group by 1, 2
 having date_trunc('day', any_value(ts)) + interval 1 day <= (select max(ts) - interval 1 hour from events)""",
}
