"""Queries of the general problems 1, 3 and 5, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.hierarchy import descendants, resolve_hierarchy
from pagewright.operators.intervals import covered_and_gaps
from pagewright.operators.nested import flatten_records, flatten_tables
from pagewright.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_records").select("record_id", "payload")
    return flatten_records(raw, fields=False).select("record_id", "child", "parent_key", "child_key").distinct()


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Every child of every raw record with its scalar members, linked by child_no and parent_no."""
    raw = table(spark, d, "raw_records").select("record_id", "record_kind", "payload").distinct()
    return flatten_records(raw).withColumn("fields", F.to_json("fields"))


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every raw record of any shape as related tables, with how many scalar members each row has."""
    raw = table(spark, d, "raw_records").select("record_id", "payload").distinct()
    return flatten_tables(raw).select("record_id", "path", "row_no", "parent_no", "place", F.size("fields").alias("members")).distinct()


def p1_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of the saved page sessions, one row each, with the session as parent."""
    s = table(spark, d, "region_sessions").selectExpr("session_id", "book_id", "file_name", "posexplode(regions) as (region_no, r)")
    return s.select("session_id", "book_id", "file_name", "region_no", "r.rectangle.*", "r.text", "r.ocr_status", "r.ocr_error").distinct()


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments").selectExpr("segment_id", "book_id", "posexplode(source_spans) as (span_no, s)")
    return s.select("segment_id", "book_id", "span_no", "s.*").distinct()


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments").selectExpr("segment_id", "book_id", "posexplode(entities) as (entity_no, entity)")
    return s.where("entity is not null").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "segments").selectExpr("book_id", "inline(source_spans)")
    out = covered_and_gaps(spans, ["book_id", "page", "rect_id"])
    return out.withColumns({c: F.col(c).cast("int") for c in ("page", "span_start", "span_end")})


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per book: characters covered and left in gaps."""
    return p3_found(spark, d).groupBy("book_id", "kind").agg(F.count("*").alias("stretches"), F.sum(F.expr("span_end - span_start")).alias("chars"))


def _resolved(spark: SparkSession, d: str, paths: bool) -> DataFrame:
    links = table(spark, d, "segments").select("segment_id", "parent_segment_id", "loaded_at")
    return resolve_hierarchy(links, "segment_id", "parent_segment_id", "loaded_at", paths)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, False).select("segment_id", "root_id", "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, True).select("segment_id", "root_id", "depth", "cycle", F.array_join("path", " > ").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_resolved(spark, d, True), "segment_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_tables, p1_regions, p1_spans, p1_entities, p3_found, p3_coverage, p5_found, p5_paths, p5_descendants)}

_P3 = """
with s as (select distinct book_id, x.page as page, x.rect_id as rect_id, cast(x."start" as bigint) as a, cast(x."end" as bigint) as b
  from (select book_id, unnest(source_spans) as x from segments)
  where book_id is not null and x.page is not null and x.rect_id is not null and x."start" is not null and x."end" is not null and x."end" > x."start"),
m as (select *, max(b) over (partition by book_id, page, rect_id order by a, b rows between unbounded preceding and 1 preceding) as far from s),
i as (select *, sum(case when far is null or far < a then 1 else 0 end) over (partition by book_id, page, rect_id order by a, b) as run from m),
c as (select book_id, page, rect_id, run, min(a) as a, max(b) as b from i group by all),
g as (select book_id, page, rect_id, b as a, lead(a) over (partition by book_id, page, rect_id order by a) as b from c),
p3 as (select book_id, page, rect_id, 'covered' as kind, cast(a as int) as span_start, cast(b as int) as span_end from c
  union all select book_id, page, rect_id, 'gap', cast(a as int), cast(b as int) from g where b is not null)
"""
_P5 = """
with recursive e as (select segment_id as id, max(parent_segment_id) as p from segments where segment_id is not null group by 1),
t as (select id, case when p in (select id from e) then p end as p from e),
up as (select id, id as root_id, 0 as depth, [id] as path from t where p is null
  union all select t.id, up.root_id, up.depth + 1, list_append(up.path, t.id) from t join up on t.p = up.id),
c as (select id, p from t where id not in (select id from up)),
reach as (select id, p as a from c union select r.id, c.p from reach r join c on r.a = c.id),
ring as (select r.id, min(r2.a) as root_id from reach r join reach r2 on r2.id = r.a where r.a in (select id from reach where id = a) group by 1)
"""
_P1 = r"""
with recursive bare as (select distinct record_id, trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) as t from raw_records where payload is not null),
opened as (select record_id, case when json_valid(t) and json_type(t) = 'VARCHAR' then trim(json_extract_string(t, '$'), chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) else t end as t from bare),
docs as (select record_id, cast(t as json) as j from opened where json_valid(t)),
tree as (select record_id, n.id, n.parent, n.key, n.type, n.atom from docs, json_tree(docs.j) n),
held as (select record_id, id, type, key as under, cast(null as varchar) as name from tree where key in ('regions', 'source_spans', 'entities')
  union all
  select c.record_id, c.id, c.type, h.under, case when h.type = 'OBJECT' then c.key end from held h join tree c on c.record_id = h.record_id and c.parent = h.id
  where h.type = 'ARRAY' or (h.type = 'OBJECT' and not exists (select 1 from tree m where m.record_id = h.record_id and m.parent = h.id
   and list_contains(case h.under when 'regions' then ['rectangle', 'rect_id', 'draw_order', 'ocr_status'] when 'source_spans' then ['page', 'rect_id', 'start', 'end'] else ['name'] end, m.key)))),
kids as (select * from held h where (type = 'VARCHAR' and under = 'entities') or (type = 'OBJECT' and exists (select 1 from tree m where m.record_id = h.record_id and m.parent = h.id
   and list_contains(case h.under when 'regions' then ['rectangle', 'rect_id', 'draw_order', 'ocr_status'] when 'source_spans' then ['page', 'rect_id', 'start', 'end'] else ['name'] end, m.key)))),
member as (select record_id, parent, key, type, id, json_extract_string(atom, '$') as v from tree),
boxes as (select r.record_id, r.id, m.id as box from kids r join member m on m.record_id = r.record_id and m.parent = r.id and m.key = 'rectangle' and m.type = 'OBJECT' where r.under = 'regions'
  union all select r.record_id, r.id, e.id from kids r join member m on m.record_id = r.record_id and m.parent = r.id and m.key = 'rectangle' and m.type = 'ARRAY' join member e on e.record_id = r.record_id and e.parent = m.id and e.type = 'OBJECT' where r.under = 'regions'),
region as (select r.record_id, r.id, coalesce(b.v, d.v, r.name, '') as k from kids r left join boxes x on x.record_id = r.record_id and x.id = r.id left join member b on b.record_id = r.record_id and b.parent = x.box and b.key = 'rect_id'
  left join member d on d.record_id = r.record_id and d.parent = r.id and d.key = 'rect_id' where r.under = 'regions'),
climb as (select k.record_id, k.id, t.parent as at from kids k join tree t on t.record_id = k.record_id and t.id = k.id
  union all select c.record_id, c.id, t.parent from climb c join tree t on t.record_id = c.record_id and t.id = c.at where c.at not in (select r.id from region r where r.record_id = c.record_id)),
above as (select c.record_id, c.id, r.k from climb c join region r on r.record_id = c.record_id and r.id = c.at),
named as (select record_id, id, 'region' as child, k from region
  union all select s.record_id, s.id, 'span', coalesce(p.v, '') || ':' || coalesce(r.v, '') || ':' || coalesce(a.v, '') from kids s left join member p on p.record_id = s.record_id and p.parent = s.id and p.key = 'page'
   left join member r on r.record_id = s.record_id and r.parent = s.id and r.key = 'rect_id' left join member a on a.record_id = s.record_id and a.parent = s.id and a.key = 'start' where s.under = 'source_spans'
  union all select e.record_id, e.id, 'entity', coalesce(n.v, m.v) from kids e left join member n on n.record_id = e.record_id and n.parent = e.id and n.key = 'name' left join member m on m.record_id = e.record_id and m.id = e.id and m.type = 'VARCHAR' where e.under = 'entities')
select distinct n.record_id, n.child, coalesce(a.k, '') as parent_key, n.k as child_key from named n left join above a on a.record_id = n.record_id and a.id = n.id where n.k is not null
"""
_P1_TABLES = _P1[: _P1.index("tree as")].replace("select record_id, cast(t as json) as j from opened", "select record_id, row_number() over () as k, cast(t as json) as j from opened") + r"""
tree as (select record_id, k, n.id, n.parent, n.key, n.type, n.atom from docs, json_tree(docs.j) n),
node as (select t.*, coalesce(p.type, '') as under, (t.parent is null and t.type = 'OBJECT') or (coalesce(p.type, '') = 'ARRAY' and t.type not in ('ARRAY', 'NULL')) as is_row,
 case when coalesce(p.type, '') = 'ARRAY' then cast(row_number() over (partition by t.k, t.parent order by t.id) - 1 as int) end as place from tree t left join tree p on p.k = t.k and p.id = t.parent),
walk as (select k, id, '' as path, cast(null as bigint) as own, is_row from node where parent is null
  union all select c.k, c.id, case when c.under = 'ARRAY' then w.path when w.path = '' then c.key else w.path || '.' || c.key end, case when w.is_row then cast(w.id as bigint) else w.own end, c.is_row from walk w join node c on c.k = w.k and c.parent = w.id),
numbered as (select n.record_id, n.k, n.id, n.type, w.path, w.own, n.place, cast(row_number() over (partition by n.k order by n.id) - 1 as int) as row_no from node n join walk w on w.k = n.k and w.id = n.id where n.is_row),
held as (select w.k, w.own, count(distinct w.path) as members from node n join walk w on w.k = n.k and w.id = n.id where not n.is_row and n.type not in ('OBJECT', 'ARRAY') and n.under = 'OBJECT' and w.own is not null group by 1, 2)
select distinct a.record_id, a.path, a.row_no, p.row_no as parent_no, a.place, cast(case when a.type <> 'OBJECT' then 1 else coalesce(h.members, 0) end as int) as members
 from numbered a left join numbered p on p.k = a.k and p.id = a.own left join held h on h.k = a.k and h.own = a.id
"""
SQL = {
    "p1_found": _P1,
    "p1_tables": _P1_TABLES,
    "p1_regions": """select distinct session_id, book_id, file_name, region_no, r.rectangle.rect_id as rect_id, r.rectangle.draw_order as draw_order,
 r.rectangle.x as x, r.rectangle.y as y, r.rectangle.width as width, r.rectangle.height as height, r.text as text, r.ocr_status as ocr_status, r.ocr_error as ocr_error
 from (select session_id, book_id, file_name, unnest(regions) as r, cast(generate_subscripts(regions, 1) - 1 as int) as region_no from region_sessions)""",
    "p1_spans": """select distinct segment_id, book_id, span_no, s.page as page, s.rect_id as rect_id, s."start" as "start", s."end" as "end"
 from (select segment_id, book_id, unnest(source_spans) as s, cast(generate_subscripts(source_spans, 1) - 1 as int) as span_no from segments)""",
    "p1_entities": """select distinct segment_id, book_id, entity_no, entity from (select segment_id, book_id, unnest(entities) as entity,
 cast(generate_subscripts(entities, 1) - 1 as int) as entity_no from segments) where entity is not null""",
    "p3_found": _P3 + "select * from p3",
    "p3_coverage": _P3 + "select book_id, kind, count(*) as stretches, cast(sum(span_end - span_start) as bigint) as chars from p3 group by all",
    "p5_found": _P5 + "select id as segment_id, root_id, depth from up union all select id, root_id, -1 from ring",
    "p5_paths": _P5
    + "select id as segment_id, root_id, depth, false as cycle, array_to_string(path, ' > ') as path from up union all select id, root_id, -1, true, null from ring",
    "p5_descendants": _P5
    + "select path[k] as ancestor, id as segment_id, cast(depth + 1 - k as int) as distance from (select id, depth, path, unnest(range(1, depth + 1)) as k from up)",
}
