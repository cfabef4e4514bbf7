"""Queries over the operators of the document pipeline, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.operators import classify, evaluate, handoff, hierarchy, layout, normalize, pages, perf, review, segments, sessions, typed, validate, views
from pagewright.runtime import cut, own_folder, table
from pagewright.sources import readers, sinks

MODEL, RULE, CONTRACT, VERSION = "default-v1", normalize.JOIN_RULE, "proposal-v1", 1


# --- tables as the operators take them


def _regions(s: SparkSession, d: str) -> DataFrame:
    return pages.current_regions(table(s, d, "region_sessions"))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return pages.blocks(_regions(s, d))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return pages.block_sizes(table(s, d, "region_sessions"))


def _normal(s: SparkSession, d: str) -> DataFrame:
    b = normalize.normalized(_blocks(s, d).select("book_id", "page", "rect_id", "block_id", "draw_order", "raw_text"))
    return pages.page_attributes(b, table(s, d, "books"))


def _segments(s: SparkSession, d: str) -> DataFrame:
    return pages.current_segments(table(s, d, "segments"))


def _first_span(df: DataFrame) -> DataFrame:
    span = F.get("source_spans", F.lit(0))
    return df.withColumns({"page": span["page"], "rect_id": span["rect_id"], "first_start": span["start"]})


def _all_spans(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).select("segment_id", "book_id", F.inline("source_spans"))


def _spans(s: SparkSession, d: str) -> DataFrame:
    """The sound ones."""
    return _all_spans(s, d).where("page is not null and rect_id is not null and start is not null and end is not null and end > start and start >= 0")


def _proposals(s: SparkSession, d: str) -> DataFrame:
    """The default classifier: each stored segment proposes the blocks its spans name, page by page in the order of its first span."""
    named = F.transform("source_spans", lambda x: F.format_string("%s:p%03d:%s", F.col("book_id"), x["page"], x["rect_id"]))
    p = _first_span(_segments(s, d)).where("page is not null").withColumn("block_ids", named)
    from pyspark.sql import Window

    order = Window.partitionBy("book_id", "page").orderBy(F.asc_nulls_last("rect_id"), F.asc_nulls_last("first_start"), "segment_id")
    return p.select("book_id", "page", F.row_number().over(order).alias("seq"), "segment_id", "block_ids", "content_type", "section_path", "audience")


# --- lines, blocks, pages


def doc_physical_lines(s, d):
    docs = table(s, d, "documents").select("doc_id", normalize.physical_lines(F.col("text")).alias("l"))
    return docs.select("doc_id", F.posexplode("l").alias("line_no", "x")).select("doc_id", "line_no", "x.text", F.col("x.start").alias("line_start"), F.col("x.end").alias("line_end"))


def line_join_decisions(s, d):
    b = normalize.with_lines(_blocks(s, d).select("block_id", "raw_text"), "raw_text")
    return b.select("block_id", F.posexplode("decisions").alias("line_no", "x")).select("block_id", "line_no", "x.*")


def normalized_blocks(s, d):
    return _normal(s, d).select("block_id", "book_id", "page", "draw_order", "normalized_text", F.size("operations").alias("joins"), F.array_join("review_reasons", ",").alias("review_reasons"))


def normalization_ops(s, d):
    return _normal(s, d).select("block_id", F.posexplode("operations").alias("op_no", "x")).select("block_id", "op_no", "x.*")


def audience_by_page(s, d):
    p = pages.current_sessions(table(s, d, "region_sessions")).select("book_id", "page")
    return pages.page_attributes(p, table(s, d, "books")).select("book_id", "page", F.col("inherited_audience").alias("audience"))


def document_type_by_page(s, d):
    p = pages.current_sessions(table(s, d, "region_sessions")).select("book_id", "page")
    return pages.page_attributes(p, table(s, d, "books")).select("book_id", "page", "document_type")


def inherited_audience(s, d):
    c = _segments(s, d).withColumn("chapter", F.get("section_path", F.lit(0)))
    return c.groupBy("book_id", "chapter").agg(segments.inherited_audience(F.col("audience")).alias("audience"), F.count("*").alias("segments"))


def structure_windows(s, d):
    w = segments.windows(_blocks(s, d))
    return w.select("book_id", "page", F.array_join("allowed_block_ids", ",").alias("allowed"), F.array_join("context_block_ids", ",").alias("context"))


def window_cache_keys(s, d):
    b = cut(_normal(s, d))
    return segments.window_keys(segments.windows(b), b, MODEL, RULE, CONTRACT, VERSION, classify.fallback_outline(b), _manifests(s, d))


def _manifests(s: SparkSession, d: str) -> DataFrame:
    """book_id and the digest of the whole manifest, so that an edited one is no hit."""
    b = pages.books(table(s, d, "books"))
    parts = ["title", "input_glob", "page_pattern", "default_document_type", "default_audience"]
    listed = lambda overrides, value: F.array_join(F.transform(overrides, lambda r: F.concat_ws(":", r["start_page"].cast("string"), r["end_page"].cast("string"), r[value])), ",")
    ranges = [listed("audience_overrides", "audience"), listed("document_type_overrides", "document_type")]
    return b.select("book_id", F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ["book_id", *parts]], *[F.coalesce(r, F.lit("")) for r in ranges]), 256).alias("manifest"))


def page_chunks(s, d):
    p = pages.current_sessions(table(s, d, "region_sessions")).select("book_id", "page")
    return readers.request_chunks(p, "page").groupBy("book_id", "chunk").agg(F.count("*").alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


# --- proposals and segments


def proposal_validity(s, d):
    return segments.checked_proposals(_proposals(s, d), _blocks(s, d)).select("book_id", "page", "segment_id", F.coalesce("failure", F.lit("valid")).alias("verdict"))


def _assembled(s: SparkSession, d: str) -> DataFrame:
    p, b = cut(_proposals(s, d)), cut(_normal(s, d))
    return segments.assemble(segments.checked_proposals(p, b), p, b)


def assembled_segments(s, d):
    return _assembled(s, d).select("segment_id", "book_id", "page", "first_order", "content_type", "audience", "inherited_audience", "document_type", F.array_join("block_ids", ",").alias("blocks"), "normalized_text", "joins", "review_status")


def assembly_reasons(s, d):
    return _assembled(s, d).select("book_id", F.explode("review_reasons").alias("reason")).groupBy("book_id", "reason").agg(F.count("*").alias("segments"))


def _answers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = cut(_normal(s, d))
    w = segments.windows(b)
    keyed = classify.with_texts(w.join(segments.window_keys(w, b, MODEL, RULE, CONTRACT, VERSION, classify.fallback_outline(b), _manifests(s, d)), ["book_id", "page"]), b)
    first = cut(classify.classify(keyed.join(b.where("document_type = 'scenario'").select("book_id", "page").distinct(), ["book_id", "page"], "left_semi")))
    return classify.classify_or_reuse(keyed, first), b


def classified_pages(s, d):
    """All pages through the default classifier, those of scenarios answered from what an earlier run kept."""
    a, _ = _answers(s, d)
    return a.select("book_id", "page", "reused", F.size("proposals").alias("proposals"), "error")


def default_segments(s, d):
    """Segments of the default classifier: one per page."""
    a, b = _answers(s, d)
    p = cut(classify.proposals_of(a))
    out = segments.assemble(segments.checked_proposals(p, b), p, b)
    return out.select("segment_id", "book_id", "page", "content_type", "audience", F.size("block_ids").alias("blocks"), F.length("normalized_text").alias("chars"), "review_status")


def fallback_outline(s, d):
    return classify.fallback_outline(_blocks(s, d))


def outline_samples(s, d):
    return classify.outline_samples(_blocks(s, d))


# --- validation


def _runs(s: SparkSession, d: str) -> DataFrame:
    return validate.depth_runs(_spans(s, d), _sizes(s, d))


def source_coverage(s, d):
    return validate.coverage(_runs(s, d), ["book_id"])


def source_gaps(s, d):
    return validate.gaps(_runs(s, d))


def source_overlaps(s, d):
    return validate.overlaps(_runs(s, d))


def source_order_reversals(s, d):
    """Of the segments as they are, and of the same with their spans the other way round (under a marked id)."""
    seg = _segments(s, d).select("segment_id", "source_spans")
    return validate.reversals(seg.unionByName(seg.select(F.concat("segment_id", F.lit("~")).alias("segment_id"), F.reverse("source_spans").alias("source_spans"))))


def invalid_references(s, d):
    return validate.invalid_references(_all_spans(s, d), _sizes(s, d)).select("segment_id", "page", "rect_id", "start", "end")


def parent_cycles(s, d):
    return validate.parent_cycles(table(s, d, "segments").select("segment_id", "parent_segment_id", "loaded_at"))


def player_visibility(s, d):
    return validate.visibility_errors(_segments(s, d).where("review_status <> 'rejected'"))


def _errors(s: SparkSession, d: str) -> DataFrame:
    return validate.errors(_segments(s, d), cut(_spans(s, d)), cut(_sizes(s, d)), _all_spans(s, d))


def validation_errors(s, d):
    return _errors(s, d).groupBy("code").agg(F.count("*").alias("errors"), F.count("segment_id").alias("with_segment"))


def exit_codes(s, d):
    """Per book: what a run over it would return; a page counts as failed when no proposal of it is valid."""
    checked = cut(segments.checked_proposals(_proposals(s, d), _blocks(s, d)))
    by_page = checked.groupBy("book_id", "page").agg(F.count_if(F.col("failure").isNull()).alias("ok"))
    per = by_page.groupBy("book_id").agg(F.count("*").alias("classified"), F.count_if(F.col("ok") == 0).alias("failed"))
    runs = _runs(s, d)
    wrong = validate.flaws(runs).groupBy("book_id").agg(F.count("*").alias("errors"))
    j = per.join(wrong, "book_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return j.select("book_id", "classified", "failed", "errors", validate.exit_code(F.lit(0), F.col("classified"), F.col("failed"), F.col("errors")).alias("exit_code"))


# --- review and views


def review_queue(s, d):
    images = pages.current_sessions(table(s, d, "region_sessions")).select("book_id", "page", "image_name")
    q = review.queue(_first_span(_segments(s, d)), images)
    return q.withColumn("reasons", F.array_join("reasons", ",")).select("review_id", "segment_id", "reasons", "severity", "page", "image_name", F.sha2(F.concat_ws("|", "context_before", "context_after"), 256).alias("context"))


def review_markdown(s, d):
    images = pages.current_sessions(table(s, d, "region_sessions")).select("book_id", "page", "image_name")
    return review.as_markdown(review.queue(_first_span(_segments(s, d)), images))


def apply_review_decisions(s, d):
    out = review.apply_decisions(_segments(s, d), table(s, d, "review_decisions"))
    return out.select("segment_id", "outcome", "review_status", F.array_join("reasons", ",").alias("reasons"))


def flagged_segments(s, d):
    """Decisions applied first, validation codes after: they send approved segments back to review too."""
    decided = review.apply_decisions(_segments(s, d), table(s, d, "review_decisions"))
    return review.flag_errors(decided, _errors(s, d)).select("segment_id", "review_status", F.array_join("reasons", ",").alias("reasons"))


def source_hashes(s, d):
    return _segments(s, d).select("segment_id", review.input_hash().alias("input_hash"))


def retrieval_view(s, d):
    return views.retrieval(_segments(s, d), pages.books(table(s, d, "books")).select("book_id", "title"))


def topic_view(s, d):
    return views.topic(_segments(s, d))


# --- evaluation


def structure_metrics(s, d):
    """Approved segments as gold against all segments with the audience of their page and only their first span."""
    seg = _segments(s, d)
    gold = seg.where("review_status = 'approved'").select("segment_id", "book_id", "source_spans", "content_type", "audience")
    at = pages.page_attributes(_first_span(seg).select("segment_id", "book_id", "page", "source_spans", "content_type"), table(s, d, "books"))
    actual = at.select("segment_id", "book_id", F.slice("source_spans", 1, 1).alias("source_spans"), F.when(F.col("document_type") == "scenario", "scenario.scene").otherwise(F.col("content_type")).alias("content_type"), F.col("inherited_audience").alias("audience"))
    return evaluate.structure(gold, actual)


def _ranked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0")
    near = evaluate.nearest(q, e.select("vec_id", "embedding"), "vec_id", "embedding", 10).withColumnRenamed("vec_id", "item")
    return near, q.select(F.col("vec_id").alias("query_id"), "label"), e.select(F.col("vec_id").alias("item"), "label")


def ranking_scores(s, d):
    return evaluate.label_scores(*_ranked(s, d), 10)


def ranking_metrics(s, d):
    return evaluate.ranking_metrics(evaluate.label_scores(*_ranked(s, d), 10))


# --- typed records


def _items(s: SparkSession, d: str) -> DataFrame:
    """Events as typed items: type, place, source and the fields of props with the value."""
    e = table(s, d, "events")
    item = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("value"), F.when(F.col("value") < 1, "ー").otherwise(F.format_string("%.2f", "value"))))
    return e.select(F.col("event_type").alias("type_name"), F.col("event_id").alias("at"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"), item.alias("item"))


def schema_union(s, d):
    return typed.field_order(_items(s, d)).select("type_name", F.array_join("fields", "\t").alias("fields"))


def gamedata_pivot(s, d):
    i = _items(s, d)
    return typed.tsv_rows(i, typed.field_order(i))


def typed_rows_routed(s, d):
    declared = s.createDataFrame([("view", ["k", "value"]), ("purchase", ["value", "k", "note"])], "type_name string, fields array<string>")
    return typed.route(_items(s, d), declared)


def json_lines(s, d):
    return sinks.as_json_lines(table(s, d, "review_decisions").select("review_id", "segment_id", "status", "decided_by", "comment").distinct())


# --- reuse of results


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    """What reusing the stored processing of each segment would meet, the present rule version being s2."""
    c = F.col("processing")
    tests = [
        ("missing", c.isNull()), ("corrupted", F.size(F.map_keys(c)) == 0), ("cache_version_mismatch", F.col("schema_version") != VERSION),
        ("extractor_mismatch", c["version"] != "s2"), ("source_mismatch", F.col("raw_text").isNull()), ("invalid_shape", F.col("normalized_text").isNull() | F.col("entities").isNull()),
    ]
    return _segments(s, d).select("segment_id", "book_id", typed.outcome(tests).alias("outcome"))


def cache_outcomes(s, d):
    return _outcomes(s, d)


def cache_summary(s, d):
    return typed.outcome_counts(_outcomes(s, d))


def resume_worklist(s, d):
    """Blocks no segment refers to yet."""
    return _sizes(s, d).join(_spans(s, d).select(*pages.BLOCK_KEYS).distinct(), pages.BLOCK_KEYS, "left_anti").select(pages.block_id().alias("block_id"))


def stale_outputs(s, d):
    """Pages that segments were made from and that have no finished session now."""
    undone = F.exists("regions", lambda r: F.coalesce(r["ocr_status"] != "done", F.lit(True)))
    now = pages.current_sessions(table(s, d, "region_sessions")).where(~F.coalesce(undone, F.lit(True))).select("book_id", "page")
    return _spans(s, d).select("book_id", "page").distinct().join(now, ["book_id", "page"], "left_anti")


def stem_collisions(s, d):
    n = table(s, d, "region_sessions").select(F.regexp_replace("file_name", r"\..*$", "").alias("stem"), F.col("book_id").alias("member"))
    return typed.collisions(n, "stem", "member").select("stem", F.size("members").alias("n"), F.array_join("members", ",").alias("members"))


# --- sessions


def _saves(s: SparkSession, d: str) -> DataFrame:
    """Regions of every save of each page."""
    x = table(s, d, "region_sessions").withColumn("page", pages.page_number(F.col("file_name")))
    flat = x.select("book_id", "page", "saved_at", "session_id", F.explode("regions").alias("r"))
    return flat.select("book_id", "page", "saved_at", "session_id", "r.rectangle.*", "r.text", "r.ocr_status", "r.ocr_error", "r.ocr_completed_at").where("page is not null and rect_id is not null")


def session_merge(s, d):
    out = sessions.fold_saves(_saves(s, d), ["book_id", "page"], "rect_id", ["saved_at", "session_id"])
    return out.select("book_id", "page", "rect_id", "draw_order", "x", "y", "text", "ocr_status", "kept")


def undone_regions(s, d):
    shared = typed.collisions(table(s, d, "region_sessions").select("image_name", F.concat_ws("/", "book_id", "file_name").alias("m")), "image_name", "m").select("image_name")
    r = sessions.work_list(_regions(s, d)).where("image_name is not null").join(shared, "image_name", "left_anti")
    return r.select("image_name", "rect_id", "draw_order", "ocr_status")


def region_markdown(s, d):
    return sessions.markdown(_regions(s, d), ["book_id", "page"])


def next_draw_order(s, d):
    return sessions.next_order(_regions(s, d), ["book_id", "page"])


# --- performance and logs


def _timings(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("event_type").alias("step_name"), F.col("user_id").alias("file_key"), F.col("value").alias("elapsed"), F.when(F.col("event_type") == "click", "wait").otherwise("step").alias("kind"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("outcome"), F.col("event_id").alias("seq"))


def perf_by_step(s, d):
    return perf.by_step(_timings(s, d))


def perf_by_file(s, d):
    return perf.by_file(_timings(s, d))


def perf_waits(s, d):
    return perf.waits(_timings(s, d))


def redact_secrets(s, d):
    return table(s, d, "documents").select("doc_id", handoff.redact(F.col("text")).alias("text"))


def _log(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "review_decisions")
    return r.select(F.col("segment_id").alias("session"), F.col("status").alias("type"), F.col("decided_by").alias("value"), "decided_at", "processing_version", F.concat_ws(" ", "status", "comment").alias("text"), "input_hash").distinct()


def handoff_summary(s, d):
    """Per segment the last decider of each verdict and the deciders in the order they came, from the log of decisions."""
    r = _log(s, d)
    order = ["decided_at", "processing_version", "input_hash"]
    last = handoff.last_values(r, "session", order, {"approved": "last_approver", "rejected": "last_rejecter"})
    seen = handoff.first_seen(r, "session", "value", order).select("session", F.array_join("values", ",").alias("deciders"))
    return last.join(seen, "session", "left")


def handoff_reports(s, d):
    r = handoff.last_reports(_log(s, d), "session", ["decided_at", "processing_version", "input_hash", "type", "value"])
    return r.select("session", F.size("reports").alias("n"), F.array_join("reports", "\n").alias("reports"))


def handoff_tasks(s, d):
    """Segments as tasks, decisions as updates: what is left to do in each book."""
    tasks = _segments(s, d).select(F.col("book_id").alias("session"), F.col("segment_id").alias("task_id"), F.concat(F.lit("review "), F.col("segment_id")).alias("subject"), F.col("review_status").alias("status")).where("status in ('required', 'approved')")
    updates = table(s, d, "review_decisions").select(F.substring_index("review_id", ":", 1).alias("session"), F.col("segment_id").alias("task_id"), F.lit("completed").alias("status"), "decided_at", "processing_version")
    return handoff.task_states(tasks, updates, "session", ["decided_at", "processing_version"])


# --- geometry and layout


def _boxes(s: SparkSession, d: str) -> DataFrame:
    r = _regions(s, d)
    return r.withColumn("box", geometry.edges(*[F.col(c) for c in ("x", "y", "width", "height", "image_width", "image_height")])).where("box is not null")


def rect_clamp(s, d):
    return _boxes(s, d).select("book_id", "page", "rect_id", "box.*")


def card_area_filter(s, d):
    ratio = geometry.area(F.col("box")) / (F.col("image_width") * F.col("image_height"))
    return _boxes(s, d).where((F.col("image_width") * F.col("image_height") > 0) & ratio.between(0.05, 0.80)).select("book_id", "page", "rect_id", F.round(ratio, 6).alias("ratio"))


def card_boxes(s, d):
    box = geometry.padded(F.col("box"), 15, F.col("image_width"), F.col("image_height"))
    return _boxes(s, d).select("book_id", "page", "rect_id", box.alias("b")).select("book_id", "page", "rect_id", "b.*")


def _page_boxes(s: SparkSession, d: str) -> DataFrame:
    """Each box with the array of all boxes of its page: a page is bounded, so pairs are tested inside the row."""
    one = F.struct("rect_id", "box.left", "box.top", "box.right", "box.bottom")
    page = _boxes(s, d).groupBy("book_id", "page", "image_width", "image_height").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return page.select("*", F.explode("all").alias("box"))


def perimeter_filter(s, d):
    p, h = _page_boxes(s, d), F.col("image_height")
    inside = lambda b: (b["bottom"] <= h * layout.PERIMETER_BAND) | (b["top"] >= h - h * layout.PERIMETER_BAND)
    b = F.col("box")
    joined = F.exists("all", lambda o: ~inside(o) & (geometry.overlap(b["left"], b["right"], o["left"], o["right"]) > 0) & (geometry.gap(b["top"], b["bottom"], o["top"], o["bottom"]) <= h * layout.PERIMETER_GAP))
    return p.where(~inside(b) | (b["bottom"] - b["top"] > h * layout.PERIMETER_MAX_HEIGHT) | joined).select("book_id", "page", "box.rect_id")


def noise_filter(s, d):
    p, h, w, b = _page_boxes(s, d), F.col("image_height"), F.col("image_width"), F.col("box")
    high, wide = b["bottom"] - b["top"], b["right"] - b["left"]
    low = h * layout.PERIMETER_MAX_HEIGHT
    other = lambda o: o["rect_id"] != b["rect_id"]
    peer = F.exists("all", lambda o: other(o) & (F.abs(o["top"] + o["bottom"] - b["top"] - b["bottom"]) / 2 <= h * layout.PEER_Y) & (geometry.overlap(b["left"], b["right"], o["left"], o["right"]) <= 0) & (o["right"] - o["left"] >= w * layout.PEER_WIDTH))
    near = F.exists("all", lambda o: other(o) & (o["bottom"] - o["top"] >= low) & (F.abs(o["left"] - b["left"]) <= w * layout.EDGE * layout.CENTER_FACTOR) & (geometry.gap(b["top"], b["bottom"], o["top"], o["bottom"]) < h * layout.NEAR_COLUMN))
    plain = (high >= low) | (wide / F.greatest(high, F.lit(1)) < layout.DECORATION_ASPECT) | (wide / w >= layout.HEADING_WIDTH)
    return p.where((high >= low * layout.MICRO_FACTOR) & (plain | (peer & (wide / w >= layout.CARD_HEADING)) | near)).select("book_id", "page", "box.rect_id")


def y_gap_bands(s, d):
    """The band of each box: a new one starts where the page is empty from side to side."""
    from pyspark.sql import Window

    w = Window.partitionBy("book_id", "page").orderBy("box.top", "box.left", "rect_id")
    above = F.max("box.bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = _boxes(s, d).withColumn("new", F.when(F.col("box.top") - above >= F.col("image_height") * layout.BAND_GAP, 1).otherwise(0))
    return b.select("book_id", "page", "rect_id", F.sum("new").over(w).alias("band"))


def hit_test(s, d):
    """The smallest box of each page that holds the middle of the page."""
    b = _boxes(s, d).withColumns({"px": F.floor(F.col("image_width") / 2), "py": F.floor(F.col("image_height") / 2)})
    inside = b.where("px >= box.left and px < box.right and py >= box.top and py < box.bottom")
    return inside.groupBy("book_id", "page").agg(F.min_by("rect_id", F.struct(geometry.area(F.col("box")), F.col("draw_order"), F.col("rect_id"))).alias("rect_id"))


def iou_pairs(s, d):
    """Boxes of a page that overlap once they have room around them, and how much."""
    p = _page_boxes(s, d).select("book_id", "page", "image_width", "image_height", "box", F.explode("all").alias("o")).where("box.rect_id < o.rect_id")
    p = p.withColumns({c: F.struct(F.col(f"{c}.rect_id"), geometry.padded(F.col(c), 40, F.col("image_width"), F.col("image_height")).alias("p")) for c in ("box", "o")})
    p = p.withColumns({c: F.struct(F.col(f"{c}.rect_id"), *[F.col(f"{c}.p")[e].alias(e) for e in ("left", "top", "right", "bottom")]) for c in ("box", "o")})
    return p.where(geometry.intersection(F.col("box"), F.col("o")) > 0).select("book_id", "page", F.col("box.rect_id").alias("rect_1"), F.col("o.rect_id").alias("rect_2"), F.round(geometry.iou(F.col("box"), F.col("o")), 6).alias("iou"))


def box_matches(s, d):
    """Boxes with room around them as detections of the boxes themselves: the best pairs of each page, each box used once."""
    p = _page_boxes(s, d).select("book_id", "page", "image_width", "image_height", "box", F.explode("all").alias("o"))
    wide = geometry.padded(F.col("box"), 40, F.col("image_width"), F.col("image_height"))
    share = F.round(geometry.iou(wide, F.col("o")), 9)
    pairs = p.select("book_id", "page", F.struct(share.alias("share"), F.col("box.rect_id").alias("one"), F.col("o.rect_id").alias("two")).alias("x")).where("x.share > 0")
    best = pairs.groupBy("book_id", "page").agg(F.collect_list("x").alias("x")).select("book_id", "page", F.inline(geometry.greedy_matches(F.col("x"))))
    return best.select("book_id", "page", F.col("one").alias("detected"), F.col("two").alias("expected"), F.round("share", 6).alias("iou"))


def rect_dedupe(s, d):
    return layout.page_rects(_regions(s, d), ["book_id", "page"])


def page_columns(s, d):
    return layout.page_columns(_regions(s, d), ["book_id", "page"])


def column_cover(s, d):
    return layout.column_cover(_regions(s, d), ["book_id", "page"])


def undone_columns(s, d):
    return layout.undone_columns(_regions(s, d), ["book_id", "page"])


def stacked_columns(s, d):
    return layout.stacked_columns(_regions(s, d), ["book_id", "page"])


def rejoined_columns(s, d):
    return layout.rejoined_columns(_regions(s, d), ["book_id", "page"])


def first_joins(s, d):
    """Over pages laid on their side, where boxes stand beside each other as in vertical writing."""
    turned = {"x": F.col("y"), "y": F.col("x"), "width": F.col("height"), "height": F.col("width"), "image_width": F.col("image_height"), "image_height": F.col("image_width")}
    return layout.first_joins(_regions(s, d).withColumns(turned), ["book_id", "page"])


def page_bands(s, d):
    return layout.page_bands(_regions(s, d), ["book_id", "page"])


def block_outlines(s, d):
    return layout.page_outlines(_regions(s, d), ["book_id", "page"])


def card_clusters(s, d):
    return layout.page_clusters(_regions(s, d), ["book_id", "page"])


def vertical_blocks(s, d):
    return layout.page_blocks(_regions(s, d), ["book_id", "page"], "vertical")


def horizontal_blocks(s, d):
    return layout.page_blocks(_regions(s, d), ["book_id", "page"], "horizontal")


# --- trees and streams


def flatten_rules(s, d):
    """Segments in reading order of their trees, parents before children."""
    tree = hierarchy.resolve_hierarchy(table(s, d, "segments").select("segment_id", "parent_segment_id", "loaded_at"), "segment_id", "parent_segment_id", "loaded_at", paths=True)
    return typed.flatten_tree(tree.where("path is not null").select(F.col("segment_id").alias("id"), "path"))


def batch_event_stream(s, d):
    """The events as a stream: per user and day events, failures and elapsed time, closed windows only."""
    import uuid

    from pagewright.streaming import batches

    schema = table(s, d, "events").schema
    work = f"{own_folder(s)}/stream-{uuid.uuid4().hex}"
    stream = batches.table_stream(s, f"{d}/events.parquet*", schema, 4)
    batches.run_available(batches.user_activity(stream), f"{work}/out", f"{work}/state")
    out = s.read.schema("window struct<start: timestamp, end: timestamp>, user_id bigint, events bigint, failures bigint, elapsed double").parquet(f"{work}/out")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "user_id", "events", "failures", "elapsed")


_ALL = [
    doc_physical_lines, line_join_decisions, normalized_blocks, normalization_ops, audience_by_page, document_type_by_page, inherited_audience, structure_windows, window_cache_keys,
    page_chunks, proposal_validity, assembled_segments, assembly_reasons, classified_pages, default_segments, fallback_outline, outline_samples, source_coverage, source_gaps, source_overlaps, source_order_reversals, invalid_references, parent_cycles,
    player_visibility, validation_errors, exit_codes, review_queue, review_markdown, apply_review_decisions, flagged_segments, source_hashes, retrieval_view, topic_view, structure_metrics,
    ranking_scores, ranking_metrics, schema_union, gamedata_pivot, typed_rows_routed, json_lines, cache_outcomes, cache_summary, resume_worklist, stale_outputs, stem_collisions, session_merge,
    undone_regions, region_markdown, next_draw_order, perf_by_step, perf_by_file, perf_waits, redact_secrets, handoff_summary, handoff_reports, handoff_tasks, rect_clamp, card_area_filter,
    card_boxes, perimeter_filter, noise_filter, y_gap_bands, hit_test, iou_pairs, box_matches, rect_dedupe, page_columns, column_cover, undone_columns, stacked_columns, rejoined_columns, first_joins, page_bands, block_outlines, card_clusters, vertical_blocks, horizontal_blocks, flatten_rules, batch_event_stream,
]
QUERIES = {f.__name__: f for f in _ALL}

from pagewright.plans.catalog_sql import SQL  # noqa: E402, F401
