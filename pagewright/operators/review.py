"""The review queue, decisions on it and their staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.pages import latest
from pagewright.operators.segments import neighbours

# Reasons that make an item severe, the reason given when there is none, the mark of an outdated decision.
SEVERE = [
    "audience_downgrade_candidate", "gm_audience_visible", "unknown_audience_visible", "unknown_block_id", "duplicate_block_ref", "non_contiguous_block_ids",
    "parent_cycle", "source_gap", "source_overlap", "invalid_source_ref", "source_order_reversal",
]
NO_REASON = "review_required"
STALE = "stale_review_decision"


def reasons(processing: Column) -> Column:
    """The comma-joined review_reasons as a list without blanks."""
    parts = F.transform(F.split(F.coalesce(processing["review_reasons"], F.lit("")), ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def severity(reasons_: Column) -> Column:
    return F.when(F.arrays_overlap(reasons_, F.array(*map(F.lit, SEVERE))), "high").otherwise("medium")


def review_id() -> Column:
    return F.concat_ws(":", "book_id", "segment_id")


def book_of(review: Column) -> Column:
    """What stands before the first colon, else nothing."""
    return F.when(F.instr(review, ":") > 0, F.substring_index(review, ":", 1)).otherwise("")


def queue(segments: DataFrame, images: DataFrame) -> DataFrame:
    """Segments that need review, with reasons, severity, image and the text around them.

    segments carry page and first_start of their first span; images (book_id, page, image_name). The
    text around is that of the neighbouring segments of the book, whether they need review or not.
    """
    around = neighbours(segments, "book_id", "page", ["rect_id", "first_start", "segment_id"], "raw_text")
    items = around.where("review_status = 'required'").join(images, ["book_id", "page"], "left")
    given = reasons(F.col("processing"))
    given = F.when(F.size(given) == 0, F.array(F.lit(NO_REASON))).otherwise(given)
    of = lambda field: F.array_sort(F.array_distinct(F.filter(F.transform("source_spans", lambda x: x[field]), lambda v: v.isNotNull())))
    return items.select(
        review_id().alias("review_id"), "book_id", "segment_id", given.alias("reasons"), severity(given).alias("severity"), "page", "rect_id", "first_start", "image_name",
        of("page").alias("pages"), of("rect_id").alias("rect_ids"), "review_status", "raw_text", "normalized_text", F.col("before").alias("context_before"), F.col("after").alias("context_after"),
    )


# The texts of a review list.
QUEUE_TITLE, QUEUE_COUNT, QUEUE_EMPTY, NONE, UNKNOWN = "# レビューキュー", "件数", "対象項目はありません。", "(なし)", "(不明)"
FIELD_NAMES = ["review_id", "segment_id", "危険度 (severity)", "理由 (reasons)", "書籍 (book_id)", "ページ (page)", "rect_id", "元画像名 (image_name)", "status"]
TEXT_NAMES = ["原文 (raw_text)", "正規化案 (normalized_text)", "前文脈 (context_before)", "後文脈 (context_after)"]
EXAMPLE_NAMES = {"approved": "承認時に記録する JSON 例", "rejected": "却下時に記録する JSON 例"}
EXAMPLE = {"input_hash": "<source-sha256-or-input-hash>", "processing_version": "<pipeline-or-prompt-version>", "decided_by": "<reviewer-id>", "comment": ""}


def decision_example(status: str) -> Column:
    """What to record for a verdict on an item, as indented JSON."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
    members = {"review_id": F.col("review_id"), "segment_id": F.col("segment_id"), "status": F.lit(status)} | {k: F.lit(v) for k, v in EXAMPLE.items()}
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *[F.concat(F.lit(f'  "{k}": '), quoted(v)) for k, v in members.items()]), F.lit("\n}"))


def numbered(items: DataFrame, group: str, page: str, order: list[str], to: str) -> DataFrame:
    """Adds the place of each row in its group, from 1, by page and order: numbers inside a page, and a running sum over pages."""
    own = Window.partitionBy(group, page).orderBy(*order)
    sizes = items.groupBy(group, page).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = items.withColumn("__in", F.row_number().over(own)).alias("i").join(before.select(F.col(group).alias("__g"), F.col(page).alias("__p"), "__before"), F.col(group).eqNullSafe(F.col("__g")) & F.col(page).eqNullSafe(F.col("__p")))
    return rows.withColumn(to, (F.col("__in") + F.col("__before")).cast("int")).drop("__in", "__before", "__g", "__p")


def as_markdown(items: DataFrame) -> DataFrame:
    """(book_id, item, markdown): per book a heading (item 0) and one numbered section per item of its queue, each ending in an empty line."""
    fence = lambda kind, c: [F.lit(f"```{kind}"), c, F.lit("```"), F.lit("")]
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    book = book_of(F.col("review_id"))
    values = [
        code(F.col("review_id")), code(F.col("segment_id")), F.col("severity"), F.array_join("reasons", ", "), F.when(book == "", UNKNOWN).otherwise(book), F.array_join(F.col("pages").cast("array<string>"), ", "),
        F.array_join("rect_ids", ", "), F.coalesce(F.nullif("image_name", F.lit("")), F.lit(NONE)), code(F.col("review_status")),
    ]
    given = [F.coalesce("raw_text", F.lit("")), F.coalesce("normalized_text", F.lit("")), *[F.coalesce(F.nullif(c, F.lit("")), F.lit(NONE)) for c in ("context_before", "context_after")]]
    lines = [F.concat(F.lit("## "), F.col("item").cast("string"), F.lit(". "), F.col("review_id")), F.lit("")]
    lines += [F.concat(F.lit(f"- **{name}**: "), v) for name, v in zip(FIELD_NAMES, values)] + [F.lit("")]
    for name, v in zip(TEXT_NAMES, given):
        lines += [F.lit(f"### {name}"), F.lit(""), *fence("text", v)]
    for status, name in EXAMPLE_NAMES.items():
        lines += [F.lit(f"### {name}"), F.lit(""), *fence("json", decision_example(status))]
    sections = numbered(items, "book_id", "page", ["rect_id", "first_start", "segment_id"], "item").select("book_id", "item", F.concat_ws("\n", *lines).alias("markdown"))
    head = F.concat(F.lit(f"{QUEUE_TITLE}\n\n{QUEUE_COUNT}: "), F.count("*").cast("string"), F.lit("\n"))
    return items.groupBy("book_id").agg(F.lit(0).alias("item"), head.alias("markdown")).unionByName(sections)


def source_hash() -> Column:
    """Hash of a segment over its ids, texts and spans, for segments that carry none."""
    spans = F.transform("source_spans", lambda s: F.concat_ws(":", *[F.coalesce(s[c].cast("string"), F.lit("")) for c in ("page", "rect_id", "start", "end")]))
    parts = ["book_id", "segment_id", F.coalesce("raw_text", F.lit("")), F.coalesce("normalized_text", F.lit("")), F.array_join(spans, ",")]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *parts), 256))


def input_hash() -> Column:
    """processing.input_hash, else input_sha256, else the hash of the source."""
    given = lambda k: F.nullif(F.col("processing")[k], F.lit(""))
    return F.coalesce(given("input_hash"), given("input_sha256"), source_hash())


def last_decisions(decisions: DataFrame) -> DataFrame:
    """One decision per review_id: the last one by time; of equal times the larger version, status and hash."""
    order = [F.desc_nulls_last(c) for c in ("decided_at", "processing_version", "status", "input_hash")]
    return latest(decisions.where("review_id is not null"), ["review_id"], order)


def apply_decisions(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """segments with the status of their last decision, or back to required where its input has changed.

    A decision is looked up by review_id, else by segment_id as key; one whose segment_id differs is
    ignored. Only the status changes, never the audience. Adds outcome: none, ignored, stale, applied.
    """
    d = last_decisions(decisions).select(F.col("review_id").alias("key"), F.col("segment_id").alias("of"), F.col("status").alias("decided"), F.col("input_hash").alias("hash"))
    first = d.select(F.struct("of", "decided", "hash").alias("first"), F.col("key").alias("key_1"))
    second = d.select(F.struct("of", "decided", "hash").alias("second"), F.col("key").alias("key_2"))
    joined = segments.join(first, review_id() == F.col("key_1"), "left").join(second, F.col("segment_id") == F.col("key_2"), "left")
    joined = joined.withColumn("d", F.coalesce("first", "second"))
    outcome = F.when(F.col("d").isNull(), "none").when(~F.col("d.of").eqNullSafe(F.col("segment_id")), "ignored").when(~F.col("d.hash").eqNullSafe(input_hash()), "stale").otherwise("applied")
    joined = joined.withColumn("outcome", outcome)
    given = reasons(F.col("processing"))
    stale = F.when(F.array_contains(given, STALE), given).otherwise(F.concat(given, F.array(F.lit(STALE))))
    return joined.withColumns({
        "reasons": F.when(F.col("outcome") == "stale", stale).otherwise(given),
        "review_status": F.when(F.col("outcome") == "applied", F.col("d.decided")).when(F.col("outcome") == "stale", "required").otherwise(F.col("review_status")),
    }).drop("key_1", "key_2", "first", "second", "d")


def flag_errors(segments: DataFrame, errors: DataFrame) -> DataFrame:
    """segments (with reasons) whose errors are added to their reasons; they need review, approved ones too."""
    codes = errors.where("segment_id is not null").groupBy("segment_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    joined = segments.join(codes, "segment_id", "left")
    return joined.withColumns({
        "reasons": F.array_distinct(F.concat("reasons", F.coalesce("codes", F.array().cast("array<string>")))),
        "review_status": F.when(F.col("codes").isNotNull(), "required").otherwise(F.col("review_status")),
    }).drop("codes")
