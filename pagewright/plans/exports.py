"""Queries over readers, sinks and the small operators between them, each over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.operators import classify, handoff, pages, perf, sessions, typed
from pagewright.plans import catalog
from pagewright.plans.catalog_sql import _BLK, _LOG, _PAGE, _REG, _SEG, _SESS, _TYPED
from pagewright.runtime import cut, own_folder, table
from pagewright.sources import readers, sinks


def _work(s: SparkSession) -> str:
    """A fresh folder all executors share."""
    return f"{own_folder(s)}/{uuid.uuid4().hex}"


def _sessions(s: SparkSession, d: str) -> DataFrame:
    return pages.current_sessions(table(s, d, "region_sessions")).where("page is not null")


def _count(column: str) -> Column:
    return F.when(F.col(column).isNull(), 0).otherwise(F.size(column))


# --- readers


def session_pages(s, d):
    """Page sessions as files of JSON, read back: regions in draw order, with what keeps a region from being taken."""
    whole = F.to_json(F.struct("image_name", "image_width", "image_height", "regions", "schema_version"))
    files = _sessions(s, d).select("book_id", F.col("file_name").alias("path"), whole.cast("binary").alias("content"))
    out = readers.parsed_sessions(files, r"(?P<page>[0-9]+)").select("book_id", "page", "image_width", "image_height", F.explode("regions").alias("r"))
    flat = out.select("book_id", "page", "image_width", "image_height", "r.rectangle.*", "r.text", "r.ocr_status")
    return flat.select("book_id", "page", "rect_id", "draw_order", F.coalesce(pages.region_problem(), F.lit("none")).alias("problem"))


def manifest_rows(s, d):
    """Manifests written as JSON lines and read back strictly."""
    work = _work(s)
    sinks.write_json_lines(pages.books(table(s, d, "books")).select("book_id", "title", "page_pattern", "default_audience", "audience_overrides", "document_type_overrides"), work)
    m = readers.json_records(s, work, readers.MANIFEST)
    return m.select("book_id", "title", "page_pattern", "default_audience", _count("audience_overrides").alias("audiences"), _count("document_type_overrides").alias("types"))


def segment_lines(s, d):
    """Segments written as gold lines and read back from their folder."""
    work = _work(s)
    columns = [c.strip().split()[0] for c in ("segment_id, book_id, content_type, audience, section_path, source_spans, entities, review_status").split(",")]
    sinks.write_json_lines(catalog._segments(s, d).select(*columns), f"{work}/{readers.GOLD_SEGMENTS}")
    g = readers.gold_segments(s, work)
    return g.select("segment_id", "book_id", "content_type", "audience", F.array_join("section_path", "/").alias("path"), _count("source_spans").alias("spans"), _count("entities").alias("entities"), "review_status")


def gold_queries(s, d):
    """Terms as gold queries of the segments they are an entity of."""
    work = _work(s)
    g = table(s, d, "glossary").select(F.concat(F.lit("q"), F.col("term_id").cast("string")).alias("query_id"), F.col("term").alias("text"), F.array(F.col("term_id").cast("string")).alias("relevant_ids"), F.col("kind").alias("query_type"))
    sinks.write_json_lines(g, work)
    return readers.json_records(s, work, readers.GOLD_QUERY).select("query_id", "text", F.size("relevant_ids").alias("relevant"), "query_type")


def tolerant_records(s, d):
    """Payloads as lines of a log: those that are objects, with what they say of themselves."""
    work = _work(s)
    table(s, d, "raw_records").where("payload is not null").select(F.regexp_replace("payload", r"[\r\n]+", " ").alias("value")).distinct().write.text(work)
    return readers.tolerant_lines(s, work, "book_id string, segment_id string, image_name string").groupBy("record.book_id", "record.image_name").agg(F.count("*").alias("lines"))


def block_text(s, d):
    """Typed items written as blocks of tab-separated text, one text per user, and read back."""
    i = catalog._items(s, d)
    rows = typed.tsv_rows(i, typed.field_order(i)).join(i.select("type_name", "at", "source"), ["type_name", "at"])
    lines = rows.groupBy("source", "type_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"))
    fields = typed.field_order(i).select("type_name", F.array_join("fields", "\t").alias("head"))
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.col("type_name")), "head", "body")
    texts = lines.join(fields, "type_name").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n\n").alias("text"))
    return readers.parse_tsv_blocks(texts, "source", "text")


def parsed_blocks(s, d):
    b = block_text(s, d)
    return b.select("source", "block_no", "type_name", F.array_join("fields", ",").alias("fields"), F.size("rows").alias("rows"), F.array_join(F.get("rows", F.lit(0)), "|").alias("first_row"))


def proposed_schema(s, d):
    return readers.proposed_schema(block_text(s, d)).select("type_name", F.array_join("fields", ",").alias("fields"), "source")


def _log_lines(s: SparkSession, d: str) -> DataFrame:
    """Decisions as log lines: one log per book, in order of review and time."""
    from pyspark.sql import Window

    r = table(s, d, "review_decisions").where("review_id is not null").distinct()
    path = F.concat(F.lit("/logs/"), F.substring_index("review_id", ":", 1), F.lit(".jsonl"))
    rows = r.select(path.alias("path"), "review_id", F.col("segment_id").alias("session"), F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("ts"), "status", "input_hash", "processing_version", "decided_by", "comment")
    names = ["review_id", "ts", "status", "input_hash", "processing_version", "decided_by", "comment"]
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy(*names)))


def log_sessions(s, d):
    """Each log with the last time its lines tell, in the order of the lines."""
    return readers.session_times(_log_lines(s, d), "path", "line_no", "ts").select("path", "timestamp")


def selected_session(s, d):
    """For each segment of the log the newest log that names it."""
    lines = _log_lines(s, d)
    newest = readers.newest_logs(lines, "path", "ts", "session")
    return newest.select("session", "path", "timestamp")


def joined_texts(s, d):
    """The recognised texts of each page, one below the other in draw order, with the name set right."""
    r = catalog._regions(s, d).where("page is not null and text is not null").select("book_id", "page", F.struct("draw_order", "rect_id").alias("chunk"), "text")
    return readers.joined_recognition(r, ["book_id", "page"], readers.CORRECTIONS)


def detected_regions(s, d):
    """Regions as recognised blocks of shares of the page, taken back to pixels, with the start of their text."""
    r = catalog._regions(s, d).where("image_width > 0 and image_height > 0 and x is not null and y is not null and width is not null and height is not null and page is not null")
    at = lambda x, y: F.struct((x / F.col("image_width")).alias("x"), (y / F.col("image_height")).alias("y"))
    right, low = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    corners = F.array(at(F.col("x"), F.col("y")), at(right, F.col("y")), at(right, low), at(F.col("x"), low))
    block = F.struct(corners.alias("vertices"), F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))).alias("segments"), (F.col("draw_order") / 7).alias("confidence"))
    df = r.select("book_id", "page", "rect_id", F.col("image_width").alias("page_width"), F.col("image_height").alias("page_height"), F.coalesce("text", F.lit("")).alias("text"), F.array(block).alias("blocks"))
    return readers.block_regions(df, "book_id", "page", "rect_id").select("book_id", "page", "rect_id", "left", "top", "right", "bottom", "snippet")


def images_listed(s, d):
    """Image files by name, among all names the sessions know, and the stems they stand for."""
    names = table(s, d, "region_sessions").select(F.explode(F.array("image_name", "file_name")).alias("path")).where("path is not null").distinct()
    return readers.image_names(names).select("name", "stem")


def sessions_of_images(s, d):
    """Every image with how many regions it has; none where no session was saved as finished."""
    x = table(s, d, "region_sessions").where("image_name is not null")
    done = _sessions(s, d).where("image_name is not null and exists(regions, r -> r.ocr_status = 'done')")
    one = pages.latest(done, ["image_name"], [F.desc("saved_at"), F.desc("session_id")])
    return readers.sessions_or_empty(x.select("image_name").distinct(), one).select("image_name", F.size("regions").alias("regions"))


def cached_detections(s, d):
    """Stored detections that still fit: some files are cut off, some are of another image."""
    p = _sessions(s, d).where("image_name is not null").select("book_id", "page", "image_name", "image_width", "image_height", "session_id")
    name = F.when(F.col("session_id") % 5 == 0, F.concat("image_name", F.lit("?"))).otherwise(F.col("image_name"))
    whole = F.to_json(F.struct(name.alias("image_name"), "image_width", "image_height", F.array(F.struct(*[F.lit(k).alias(c) for k, c in enumerate(("x", "y", "width", "height"))])).alias("blocks")))
    files = p.select(F.col("session_id").cast("string").alias("stem"), F.when(F.col("session_id") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    wanted = p.select(F.col("session_id").cast("string").alias("stem"), "image_name")
    return readers.fitting_blocks(files, wanted).select("stem", "image_name", "image_width", F.size("blocks").alias("blocks"))


# --- sinks


def structured_pages(s, d):
    """Terms and first segments as sections of tab-separated text, one text per language and book."""
    g = table(s, d, "glossary")
    one = F.struct(F.col("term").alias("name"), F.col("kind").alias("classification"), F.array("kind", "lang").alias("sub_organizations"), F.col("note").alias("headquarters"), F.lit(None).cast("string").alias("description"))
    skill = F.struct(F.col("term").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("ruby", "prerequisite", "max_level")], F.lit("ー").alias("timing"), *[F.lit(None).cast("string").alias(c) for c in ("target", "range", "target_value", "opposed")], F.col("note").alias("description"))
    collected = g.groupBy("lang").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "faction", one))).alias("organizations"), F.array_sort(F.collect_list(F.when(F.col("kind") == "item", skill))).alias("skills"))
    return sinks.structured_tsv(collected, ["lang"])


def schema_file(s, d):
    return sinks.schema_lines(typed.field_order(catalog._items(s, d)))


def schema_sections(s, d):
    """Types and their fields as the sections of a request."""
    return typed.schema_sections(typed.field_order(catalog._items(s, d)))


def card_files(s, d):
    """Boxes of each page as cards: file names in order, confidence to four places, halves to even."""
    b = catalog._boxes(s, d).where("page is not null")
    ratio = geometry.area(F.col("box")) / (F.col("image_width") * F.col("image_height"))
    cards = b.select(F.concat_ws("_", "book_id", F.col("page").cast("string")).alias("name"), "draw_order", "rect_id", ratio.alias("confidence"))
    return sinks.card_meta(cards, "name", ["draw_order", "rect_id"]).select("name", "rect_id", "card", "file", "confidence")


def metric_text(s, d):
    return sinks.metric_lines(catalog.structure_metrics(s, d))


def published_files(s, d):
    """Outputs published twice: what the second run wrote stands, what it no longer names is gone."""
    work = _work(s)
    rows = table(s, d, "glossary").select("term_id", "term", "kind")
    write = lambda df: lambda path: sinks.write_json_lines(df, path)
    sinks.publish(s, work, {"items": write(rows.where("kind = 'item'")), "creatures": write(rows.where("kind = 'creature'"))})
    stale = sinks.publish(s, work, {"items": write(rows.where("kind = 'item'").withColumn("term", F.upper("term"))), "factions": write(rows.where("kind = 'faction'"))})
    got = readers.json_records(s, f"{work}/items", rows.schema).unionByName(readers.json_records(s, f"{work}/factions", rows.schema))
    return got.unionByName(s.createDataFrame([(-1, n, "stale") for n in stale], rows.schema))


def legacy_files(s, d):
    """Which outputs no manifest names are taken for those of an older version."""
    names = table(s, d, "region_sessions").select("session_id", F.element_at(F.array(F.lit("a.tsv"), F.lit("b.docai.tsv"), F.lit(".stage/c.tsv"), F.lit("d/e.tsv"), F.lit("f.txt"), F.lit("g.gamedata.tsv")), (F.col("session_id") % 6 + 1).cast("int")).alias("name"))
    return names.select("session_id", "name", sinks.is_legacy_output(F.col("name")).alias("legacy"))


def upserted_decisions(s, d):
    """One decision per review, a later one in place of an earlier."""
    r = table(s, d, "review_decisions").where("review_id is not null and decided_at is not null").select("review_id", "status", "decided_by", "decided_at", "input_hash").distinct()
    order = ["decided_at", "status", "input_hash", "decided_by"]
    old = pages.latest(r, ["review_id"], [F.asc_nulls_first(c) for c in order])
    new = pages.latest(r.where("status = 'approved'"), ["review_id"], [F.desc_nulls_last(c) for c in order])
    return sinks.upsert_by_key(new, old, ["review_id"])


# --- sessions


def _first_and_last(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(s, d, "region_sessions").withColumn("page", pages.page_number(F.col("file_name"))).where("page is not null")
    flat = lambda df: df.select("book_id", "page", F.explode("regions").alias("r")).select("book_id", "page", "r.rectangle.*", "r.text", "r.ocr_status").where("rect_id is not null")
    ends = [pages.latest(x, ["book_id", "page"], [way("saved_at"), way("session_id")]) for way in (F.asc, F.desc)]
    return flat(ends[0]), flat(ends[1])


def upserted_regions(s, d):
    """Regions of the first save with the finished ones of the last in their place."""
    first, last = _first_and_last(s, d)
    return sessions.upsert(first, last.where("ocr_status = 'done'"), ["book_id", "page", "rect_id"]).select("book_id", "page", "rect_id", "draw_order", "text", "ocr_status")


def valid_results(s, d):
    """Results of the first save whose region the last still has with the geometry it had."""
    first, last = _first_and_last(s, d)
    return sessions.still_valid(first, last, ["book_id", "page", "rect_id"], ["x", "y", "width", "height"]).select("book_id", "page", "rect_id", "text")


# --- logs


def handoff_names(s, d):
    """File names, times and cells of a log's page."""
    r = table(s, d, "review_decisions").select("review_id", "comment", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("ts")).distinct()
    return r.select("review_id", handoff.slug(F.col("comment")).alias("slug"), handoff.stamp(F.col("ts")).alias("stamp"), handoff.escape_cell(F.coalesce("comment", F.lit(""))).alias("cell"), handoff.log_folder(F.concat(F.lit("/home/"), F.col("review_id"))).alias("folder"))


def assistant_texts(s, d):
    """What assistant messages say: their text items, one below the other; nothing for other roles."""
    r = catalog._regions(s, d).where("page is not null").groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("draw_order", "rect_id", F.when(F.col("ocr_status") == "done", "text").otherwise("tool_use").alias("type"), "text"))).alias("c"))
    content = F.transform("c", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text")))
    return r.select("book_id", "page", handoff.assistant_text(F.when(F.col("page") % 4 == 0, "user").otherwise("assistant"), content).alias("text"))


def handoff_pages(s, d):
    """One page per reviewed segment: its verdicts as tasks, what is left, its last reports."""
    log = catalog._log(s, d).where("session is not null")
    order = ["decided_at", "processing_version", "input_hash", "type", "value"]
    tasks = log.groupBy("session").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("processing_version", F.lit("")).alias("id"), F.coalesce("value", F.lit("")).alias("subject"), F.coalesce("type", F.lit("")).alias("status")))).alias("tasks"))
    left = log.where("type <> 'approved'").groupBy("session").agg(F.array_sort(F.collect_set("value")).alias("next_work"))
    reports = handoff.last_reports(log, "session", order)
    whole = tasks.join(left, "session", "left").join(reports, "session", "left").withColumns({"title": F.lit(None).cast("string"), "next_work": F.coalesce("next_work", F.array().cast("array<string>")), "reports": F.coalesce("reports", F.array().cast("array<string>"))})
    return sinks.handoff_markdown(whole)


# --- typed results


class _Refusing:
    """A stand-in for a service: refuses every seventh page for good and answers every third only on a second attempt."""

    classifier_id = "refusing"

    def __init__(self):
        self.asked: set[int] = set()

    def classify(self, window):
        page = window["page"]
        if page % 7 == 0:
            raise ValueError("no answer")
        if page % 5 == 0:
            return [{"block_ids": ["unknown"]}]
        if page % 3 == 0 and page not in self.asked:
            self.asked.add(page)
            return classify.decoded_answer(iter(["{", "[]"]).__next__, wait=0.0)
        return [{"block_ids": list(window["allowed_block_ids"]), "audience": window["inherited_audience"]}]


def failed_pages(s, d):
    """Pages whose answer was refused, for a folder of failures; the others are not touched by them."""
    from pagewright.operators import segments

    b = cut(catalog._normal(s, d))
    w = segments.windows(b)
    keyed = classify.with_texts(w.join(segments.window_keys(w, b, "refusing", catalog.RULE, catalog.CONTRACT, catalog.VERSION), ["book_id", "page"]), b)
    return classify.failures(classify.classify(keyed, _Refusing)).select("book_id", "page", "error")


def rate_limits(s, d):
    """Which failures are worth another attempt, and how long to wait before it."""
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("attempt"), F.when(F.col("event_type") == "error", 429).otherwise(500).alias("code"))
    return e.select("event_id", classify.is_rate_limit(F.col("code")).alias("limited"), F.when(classify.is_rate_limit(F.col("code")), perf.backoff_seconds(F.col("attempt"))).alias("wait"))


def typed_results(s, d):
    """Typed results of the events, some of them malformed, with the first thing wrong with each."""
    e = table(s, d, "events").select("event_id", "event_type")
    cases = [
        '{"matched_types":[{"type_name":"view","items":[{"k":"1","value":"2"}]}],"unmatched_types":[]}', '{"matched_types":{},"unmatched_types":[]}', '{"matched_types":[{"type_name":"other","items":[]}],"unmatched_types":[]}',
        '{"matched_types":[{"type_name":"view","items":[{"k":"1"}]}],"unmatched_types":[]}', '{"matched_types":[],"unmatched_types":[{"type_name":"x","items":[{"k":1}]}]}', '{"matched_types":[],"unmatched_types":[{"items":[]}]}', '[]', '{"matched_types":[',
    ]
    text = F.element_at(F.array(*map(F.lit, cases)), (F.col("event_id") % len(cases) + 1).cast("int"))
    return typed.checked_results(e.withColumn("result", text), "result", [{"type_name": "view", "fields": ["k", "value"]}]).select("event_id", "problem")


def type_names(s, d):
    """Why a term can't name an output file."""
    edge = ["", "..", "a\\b", "/a", ".a", "a.", "none_a", "a.docai", "a" * 201]
    names = table(s, d, "glossary").select(F.col("term").alias("name")).unionByName(s.createDataFrame([(x,) for x in edge], "name string")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([typed.schema_problem(n, set()) or "none" for n in b.column(0).to_pylist()], pa.string())], names=["name", "problem"])

    return names.mapInArrow(run, "name string, problem string")


def fingerprints(s, d):
    """Digests of each type's fields and of the request that asks for them."""
    f = typed.field_order(catalog._items(s, d))
    return f.select("type_name", typed.schema_fingerprint().alias("schema"), typed.prompt_fingerprint(F.lit("list the items of this type")).alias("prompt"))


def content_hashes(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash")).where("hash is not null")


def entity_mentions(s, d):
    """Entities of each segment that stand nowhere in its text."""
    return catalog._segments(s, d).select("segment_id", classify.missing_entities(F.col("entities"), F.col("raw_text")).alias("m")).where("size(m) > 0").select("segment_id", F.array_join("m", ",").alias("missing"))


def pixel_math(s, d):
    """Display coordinates in image pixels, halves to even and clamping, and the blocks a view shows."""
    r = catalog._regions(s, d).where("page is not null and x is not null and image_width is not null")
    blocks = lambda n: F.sequence(F.lit(1), F.lit(n))
    kind = F.element_at(F.array(F.lit("vertical"), F.lit("horizontal"), F.lit("paragraph")), (F.pmod("page", F.lit(3)) + 1).cast("int"))
    shown = geometry.active_blocks(kind, blocks(3), F.when(F.col("page") % 2 == 0, blocks(2)), blocks(1))
    return r.select("book_id", "page", "rect_id", geometry.round_half_even(F.col("x") / 2).alias("half"), geometry.display_to_natural(F.col("x").cast("double"), F.lit(1.5), F.col("image_width")).cast("int").alias("natural"), geometry.clamp(F.col("y"), 10, F.lit(500)).alias("clamped"), F.size(shown).alias("shown"))


_ALL = [
    session_pages, manifest_rows, segment_lines, gold_queries, tolerant_records, parsed_blocks, proposed_schema, log_sessions, selected_session, joined_texts, detected_regions, images_listed,
    sessions_of_images, cached_detections, structured_pages, schema_file, schema_sections, card_files, metric_text, published_files, legacy_files, upserted_decisions, upserted_regions, valid_results,
    handoff_names, assistant_texts, handoff_pages, failed_pages, rate_limits, typed_results, type_names, fingerprints, content_hashes, entity_mentions, pixel_math,
]
QUERIES = {f.__name__: f for f in _ALL}

_LINES = """lg as (select distinct '/logs/' || string_split(review_id, ':')[1] || '.jsonl' as path, review_id, segment_id as session, strftime(decided_at, '%Y-%m-%d %H:%M:%S') as ts, status, input_hash, processing_version, decided_by, comment from review_decisions where review_id is not null),
 ll as (select *, row_number() over (partition by path order by review_id, ts nulls first, status nulls first, input_hash nulls first, processing_version nulls first, decided_by nulls first, comment nulls first) as line_no from lg)"""
_ENDS = f"""x as (select *, {_PAGE} as page from region_sessions), f as (select book_id, page, unnest(regions) as r from x where page is not null qualify dense_rank() over (partition by book_id, page order by saved_at, session_id) = 1),
 l as (select book_id, page, unnest(regions) as r from x where page is not null qualify dense_rank() over (partition by book_id, page order by saved_at desc, session_id desc) = 1),
 fr as (select book_id, page, r.rectangle.rect_id as rect_id, r.rectangle.draw_order as draw_order, r.rectangle.x as x, r.rectangle.y as y, r.rectangle.width as w, r.rectangle.height as h, r.text as text, r.ocr_status as ocr_status from f where r.rectangle.rect_id is not null),
 lr as (select book_id, page, r.rectangle.rect_id as rect_id, r.rectangle.draw_order as draw_order, r.rectangle.x as x, r.rectangle.y as y, r.rectangle.width as w, r.rectangle.height as h, r.text as text, r.ocr_status as ocr_status from l where r.rectangle.rect_id is not null)"""
_FIELDS = """, f as (select type_name, "at", unnest(map_keys(item)) as field, unnest(range(0, len(map_keys(item)))) as pos from items), m as (select type_name, field, min(("at", pos)) as p from f group by 1, 2),
 fo as (select type_name, list(field order by p) as fields from m group by 1)"""
_DASHED = "case when coalesce(item[x], '') in ('一', '－', 'ー', '−', '-', '–', '—', '―') then '-' else coalesce(item[x], '') end"
_BLOCKS = f"""with {_TYPED}{_FIELDS}, b as (select source, type_name, any_value(fields) as fields, count(*) as n, arg_min(array_to_string(list_transform(fields, lambda x: {_DASHED}), '|'), "at") as first_row from items join fo using (type_name) group by 1, 2),
 bn as (select *, cast(row_number() over (partition by source order by '## ' || type_name) - 1 as int) as block_no from b)"""
SQL = {
    "session_pages": f"""with {_REG} select book_id, page, rect_id, draw_order, coalesce(case when ocr_status is null or ocr_status <> 'done' then 'region is not done' when text is null then 'region has no text'
 when x + width > image_width or y + height > image_height then 'rectangle leaves the page' end, 'none') as problem from reg where page is not null""",
    "manifest_rows": """select book_id, any_value(title) as title, any_value(page_pattern) as page_pattern, any_value(default_audience) as default_audience, cast(coalesce(any_value(len(audience_overrides)), 0) as int) as audiences,
 cast(coalesce(any_value(len(document_type_overrides)), 0) as int) as types from books group by 1""",
    "segment_lines": f"""with {_SEG} select segment_id, book_id, content_type, audience, array_to_string(section_path, '/') as path, cast(coalesce(len(source_spans), 0) as int) as spans, cast(coalesce(len(entities), 0) as int) as entities, review_status from seg""",
    "gold_queries": "select 'q' || term_id as query_id, term as text, cast(1 as int) as relevant, kind as query_type from glossary",
    "tolerant_records": r"""with v as (select distinct regexp_replace(payload, '[\r\n]+', ' ', 'g') as v from raw_records where payload is not null), o as (select cast(v as json) as j from v where json_valid(v) and json_type(v) = 'OBJECT')
 select json_extract_string(j, '$.book_id') as book_id, json_extract_string(j, '$.image_name') as image_name, count(*) as lines from o group by 1, 2""",
    "parsed_blocks": f"{_BLOCKS} select source, block_no, type_name, array_to_string(fields, ',') as fields, cast(n as int) as rows, first_row from bn",
    "proposed_schema": f"{_BLOCKS} select type_name, any_value(array_to_string(fields, ',')) as fields, arg_min(source, (source, block_no)) as source from bn group by 1",
    "log_sessions": f"with {_LINES} select path, arg_max(ts, line_no) filter (ts is not null) as timestamp from ll group by 1",
    "selected_session": f"with {_LINES}, p as (select path, max(ts) as t from ll group by 1) select session, arg_max(path, (coalesce(t, ''), path)) as path, arg_max(t, (coalesce(t, ''), path)) as timestamp from (select distinct session, path from ll where session is not null) join p using (path) group by 1",
    "joined_texts": f"with {_REG} select book_id, page, replace(string_agg(text, chr(10) order by draw_order, rect_id), 'NOVA', 'N◎VA') as text from reg where page is not null and text is not null group by 1, 2",
    "detected_regions": f"""with {_REG} select book_id, page, rect_id, cast(trunc(x / image_width * image_width) as int) as "left", cast(trunc(y / image_height * image_height) as int) as top, cast(trunc((x + width) / image_width * image_width) as int) as "right",
 cast(trunc((y + height) / image_height * image_height) as int) as bottom, left(coalesce(text, ''), 100) as snippet from reg where image_width > 0 and image_height > 0 and x is not null and y is not null and width is not null and height is not null and page is not null""",
    "images_listed": r"""select name, regexp_replace(name, '\.[^.]*$', '') as stem from (select distinct string_split(p, '/')[-1] as name, p from (select image_name as p from region_sessions union select file_name from region_sessions) where p is not null)
 where regexp_matches(lower(name), '(\.png|\.jpg|\.jpeg|\.webp|\.gif|\.tif|\.tiff|\.pdf)$')""",
    "sessions_of_images": f"""with {_SESS}, o as (select image_name, len(regions) as n from sess where page is not null and image_name is not null and len(list_filter(regions, lambda r: r.ocr_status = 'done')) > 0 qualify row_number() over (partition by image_name order by saved_at desc, session_id desc) = 1)
 select image_name, cast(coalesce(n, 0) as int) as regions from (select distinct image_name from region_sessions where image_name is not null) left join o using (image_name)""",
    "cached_detections": f"with {_SESS} select cast(session_id as varchar) as stem, image_name, image_width, cast(1 as int) as blocks from sess where page is not null and image_name is not null and session_id % 5 <> 0 and session_id % 7 <> 0",
    "structured_pages": """with o as (select lang, string_agg(concat_ws(chr(9), coalesce(term, ''), coalesce(kind, ''), concat_ws(', ', kind, lang), coalesce(note, ''), ''), chr(10) order by term nulls first, kind nulls first, note nulls first) as t from glossary where kind = 'faction' group by 1),
 k as (select lang, string_agg(concat_ws(chr(9), coalesce(term, ''), '', '', '', '-', '', '', '', '', case when note in ('一', '－', 'ー', '−', '-', '–', '—', '―') then '-' else coalesce(note, '') end), chr(10) order by term nulls first, note nulls first) as t from glossary where kind = 'item' group by 1)
 select lang, coalesce(nullif(concat_ws(chr(10) || chr(10), '## 組織' || chr(10) || array_to_string(['name', 'classification', 'sub_organizations', 'headquarters', 'description'], chr(9)) || chr(10) || o.t,
  '## 技能' || chr(10) || array_to_string(['name', 'ruby', 'prerequisite', 'max_level', 'timing', 'target', 'range', 'target_value', 'opposed', 'description'], chr(9)) || chr(10) || k.t), '') || chr(10), '') as tsv
 from (select distinct lang from glossary) left join o using (lang) left join k using (lang)""",
    "schema_file": f"with {_TYPED}{_FIELDS} select type_name || chr(9) || array_to_string(fields, chr(9)) as value from fo",
    "schema_sections": f"with {_TYPED}{_FIELDS} select type_name, '### ' || type_name || chr(10) || array_to_string(list_transform(fields, lambda x: '- ' || x), chr(10)) as section from fo",
    "card_files": f"""with {_REG}, b as (select *, greatest(0, least(x, image_width)) as l, greatest(0, least(y, image_height)) as t, greatest(0, least(x + width, image_width)) as r, greatest(0, least(y + height, image_height)) as w from reg where page is not null),
 c as (select book_id || '_' || page as name, draw_order, rect_id, (r - l) * (w - t) / (image_width * image_height) as q from b where r - l >= 1 and w - t >= 1)
 select name, rect_id, cast(row_number() over (partition by name order by draw_order nulls first, rect_id nulls first) as int) as card, name || '_' || lpad(cast(row_number() over (partition by name order by draw_order nulls first, rect_id nulls first) as varchar), 3, '0') || '.png' as file, round_even(q, 4) as confidence from c""",
    "metric_text": "select concat_ws(chr(10), 'source_coverage=' || printf('%.4f', source_coverage), 'boundary_match=' || printf('%.4f', boundary_match), 'content_type_match=' || printf('%.4f', content_type_match), 'audience_match=' || printf('%.4f', audience_match), 'critical_audience_errors=' || critical_audience_errors) as value from (__METRICS__)",
    "published_files": "select term_id, case when kind = 'item' then upper(term) else term end as term, kind from glossary where kind in ('item', 'faction') union all select -1, 'creatures', 'stale'",
    "legacy_files": "select session_id, name, name in ('a.tsv', 'd/e.tsv') as legacy from (select session_id, ['a.tsv', 'b.docai.tsv', '.stage/c.tsv', 'd/e.tsv', 'f.txt', 'g.gamedata.tsv'][session_id % 6 + 1] as name from region_sessions)",
    "upserted_decisions": """with r as (select distinct review_id, status, decided_by, decided_at, input_hash from review_decisions where review_id is not null and decided_at is not null),
 o as (select * from r qualify row_number() over (partition by review_id order by decided_at nulls first, status nulls first, input_hash nulls first, decided_by nulls first) = 1),
 n as (select * from r where status = 'approved' qualify row_number() over (partition by review_id order by decided_at desc nulls last, status desc nulls last, input_hash desc nulls last, decided_by desc nulls last) = 1)
 select * from n union all select * from o where review_id not in (select review_id from n)""",
    "upserted_regions": f"""with {_ENDS}, c as (select * from lr where ocr_status = 'done') select c.book_id, c.page, c.rect_id, coalesce(fr.draw_order, c.draw_order) as draw_order, c.text, c.ocr_status from c left join fr using (book_id, page, rect_id)
 union all select book_id, page, rect_id, draw_order, text, ocr_status from fr where not exists (select 1 from c where c.book_id = fr.book_id and c.page = fr.page and c.rect_id = fr.rect_id)""",
    "valid_results": f"""with {_ENDS} select book_id, page, rect_id, text from fr where exists (select 1 from lr where lr.book_id = fr.book_id and lr.page = fr.page and lr.rect_id = fr.rect_id and lr.x is not distinct from fr.x and lr.y is not distinct from fr.y
 and lr.w is not distinct from fr.w and lr.h is not distinct from fr.h)""",
    "handoff_names": r"""select review_id, coalesce(nullif(regexp_replace(regexp_replace(comment, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'session') as slug, left(regexp_replace(ts, '[^0-9]', '', 'g'), 14) as stamp, replace(coalesce(comment, ''), '|', '\|') as cell,
 replace('/home/' || review_id, '/', '-') as folder from (select distinct review_id, comment, strftime(decided_at, '%Y-%m-%d %H:%M:%S') as ts from review_decisions)""",
    "assistant_texts": f"with {_REG} select book_id, page, case when page % 4 = 0 then null else coalesce(string_agg(text, chr(10) order by draw_order, rect_id) filter (ocr_status = 'done' and text is not null), '') end as text from reg where page is not null group by 1, 2",
    "handoff_pages": f"""with {_LOG}, t as (select distinct session, coalesce(processing_version, '') as id, coalesce(value, '') as subject, coalesce(type, '') as status from log where session is not null),
 tt as (select session, string_agg('| ' || id || ' | ' || replace(subject, '|', '\\|') || ' | ' || status || ' |', chr(10) order by id, subject, status) as rows from t group by 1),
 nw as (select session, string_agg('- ' || value, chr(10) order by value) as work from (select distinct session, value from log where session is not null and type <> 'approved' and value is not null and value <> '') group by 1),
 rp as (select session, string_agg(text, chr(10) || chr(10) order by k desc) as reports from (select *, row_number() over (partition by session order by decided_at desc, processing_version desc, input_hash desc, type desc, value desc nulls last) as k from log
  where session is not null and regexp_matches(text, 'Gate|Phase|フェイズ|完了報告|検証結果|次は|approved')) where k <= 5 group by 1)
 select tt.session, concat_ws(chr(10) || chr(10), '# ' || tt.session, '## Tasks', '| id | subject | status |' || chr(10) || '| --- | --- | --- |' || chr(10) || tt.rows, '## Next', coalesce(nw.work, ''), '## Reports', coalesce(rp.reports, '')) as markdown
 from tt left join nw using (session) left join rp using (session)""",
    "failed_pages": f"with {_BLK} select distinct book_id, page, case when page % 7 = 0 then 'ValueError: no answer' else 'unknown block' end as error from blk where page % 7 = 0 or page % 5 = 0",
    "rate_limits": "select event_id, event_type = 'error' as limited, cast(case when event_type = 'error' and event_id % 5 < 4 then 30 * power(2, event_id % 5) end as double) as wait from events",
    "typed_results": """select event_id, ['none', 'matched_types: not a list', 'matched_types[0].type_name: not declared', 'matched_types[0].items[0]: other fields than declared', 'unmatched_types[0].items[0]: not an object of strings', 'unmatched_types[0].type_name: not a string',
 'result: not an object', 'not JSON'][event_id % 8 + 1] as problem from events""",
    "type_names": r"""with n as (select term as name from glossary union select unnest(['', '..', 'a\b', '/a', '.a', 'a.', 'none_a', 'a.docai', repeat('a', 201)]))
 select name, case when trim(name) = '' then 'empty' when contains(name, '..') then 'two dots' when contains(name, '\') then 'backslash' when regexp_matches(name, '[\x00-\x1f]') then 'control character' when starts_with(name, '/') then 'leading slash'
 when starts_with(name, '.') then 'leading dot' when ends_with(name, '.') or ends_with(name, ' ') then 'trailing dot or blank' when strlen(name) > 200 then 'longer than 200 bytes'
 when regexp_matches(name || '.tsv', '(\.docai|\.gamedata|\.structured|\.schema)\.tsv$') then 'reserved ending' when starts_with(name, 'none_') then 'reserved prefix' else 'none' end as problem from n""",
    "fingerprints": f"""with {_TYPED}{_FIELDS}, j as (select type_name, '{{"fields":[' || array_to_string(list_transform(fields, lambda x: '"' || x || '"'), ',') || '],"type_name":"' || type_name || '"}}' as t from fo)
 select type_name, sha256(t) as schema, sha256('list the items of this type' || chr(10) || t) as prompt from j""",
    "content_hashes": "select doc_id, sha256(text) as hash from documents where text is not null",
    "entity_mentions": f"with {_SEG}, e as (select segment_id, list_filter(entities, lambda e: e is not null and not contains(coalesce(raw_text, ''), e)) as m from seg) select segment_id, array_to_string(m, ',') as missing from e where len(m) > 0",
    "pixel_math": f"""with {_REG} select book_id, page, rect_id, cast(round_even(x / 2, 0) as int) as half, cast(greatest(0, least(floor(x * 1.5 + 0.5), image_width)) as int) as natural, greatest(10, least(y, 500)) as clamped,
 cast(case when page % 3 = 0 then case when page % 2 = 0 then 2 else 3 end when page % 3 = 1 then 1 else 3 end as int) as shown from reg where page is not null and x is not null and image_width is not null""",
}
SQL["metric_text"] = SQL["metric_text"].replace("__METRICS__", catalog.SQL["structure_metrics"])
