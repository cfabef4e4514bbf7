"""Windows around pages, proposals checked against blocks, and segments put together from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT_JOIN = "\n\n"


def inherited_audience(audiences: Column) -> Column:
    """Aggregate that never widens access: any gm makes gm, else any unknown unknown, else the one value, else shared."""
    return (
        F.when(F.bool_or(audiences == "gm"), "gm")
        .when(F.bool_or((audiences == "unknown") | audiences.isNull()), "unknown")
        .when(F.min(audiences) == F.max(audiences), F.min(audiences))
        .otherwise("shared")
    )


def fold_audience(audiences: Column) -> Column:
    """The same over an array."""
    return (
        F.when(F.exists(audiences, lambda a: a == "gm"), "gm")
        .when(F.exists(audiences, lambda a: a == "unknown"), "unknown")
        .when(F.size(F.array_distinct(audiences)) == 1, F.get(audiences, F.lit(0)))
        .otherwise("shared")
    )


def windows(blocks: DataFrame) -> DataFrame:
    """For each page its blocks in order, with the last block of the page before and the first of the page after.

    book_id, page, allowed_block_ids, context_block_ids. Pages are bounded by what fits on paper;
    neighbours are found by two equi-joins on the page number, a gap gives no context.
    """
    own = blocks.groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("draw_order", "block_id"))).alias("b"))
    own = own.withColumn("ids", F.transform("b", lambda x: x["block_id"])).drop("b")
    before = own.select("book_id", (F.col("page") + 1).alias("page"), F.element_at("ids", -1).alias("before"))
    after = own.select("book_id", (F.col("page") - 1).alias("page"), F.element_at("ids", 1).alias("after"))
    joined = own.join(before, ["book_id", "page"], "left").join(after, ["book_id", "page"], "left")
    context = F.concat(F.array_compact(F.array("before")), F.col("ids"), F.array_compact(F.array("after")))
    return joined.select("book_id", "page", F.col("ids").alias("allowed_block_ids"), context.alias("context_block_ids"))


def window_keys(windows_: DataFrame, blocks: DataFrame, model: str, rule: str, contract: str, version: int, outlines: DataFrame | None = None, manifests: DataFrame | None = None) -> DataFrame:
    """book_id, page, context_digest and cache_key of each window.

    The digest is over all its context blocks in order and the section of the book's outline (book_id,
    start_page, end_page, title, default_content_type) that holds the page; the key is over the digest
    and the manifest's own digest (book_id, manifest), so either may change it.
    """
    line = F.concat_ws("|", "block_id", F.col("page").cast("string"), F.col("draw_order").cast("string"), "raw_text", "normalized_text", "inherited_audience")
    lines = blocks.select("book_id", F.col("block_id").alias("id"), line.alias("line"))
    spread = windows_.select("book_id", "page", F.posexplode("context_block_ids").alias("at", "id"))
    parts = spread.join(lines, ["book_id", "id"]).groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("p"))
    if outlines is None:
        parts = parts.withColumn("section", F.lit(None).cast("string"))
    else:
        section = F.concat_ws("|", F.lit("outline"), "title", F.col("start_page").cast("string"), F.col("end_page").cast("string"), "default_content_type")
        held = parts.select("book_id", "page").join(outlines, "book_id").where("page between start_page and end_page").groupBy("book_id", "page").agg(F.min(section).alias("section"))
        parts = parts.join(held, ["book_id", "page"], "left")
    parts = parts.withColumn("manifest", F.lit(None).cast("string")) if manifests is None else parts.join(manifests, "book_id", "left")
    digest = F.sha2(F.concat_ws("\n", "section", F.array_join(F.transform("p", lambda x: x["line"]), "\n")), 256)
    key = F.sha2(F.concat_ws("|", digest, F.concat(F.lit("sha256:"), F.coalesce("manifest", F.sha2("book_id", 256))), F.lit(rule), F.lit(contract), F.lit(model), F.lit(str(version))), 256)
    return parts.select("book_id", "page", digest.alias("context_digest"), key.alias("cache_key"))


def checked_proposals(proposals: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each proposal of a page with its failure (null if valid): book_id, page, seq, segment_id, block_ids, failure, known.

    proposals: book_id, page, seq, segment_id, block_ids and what else describes them. In the order
    of seq a proposal claims its blocks unless it names one twice, one unknown on the page, one already
    claimed, or skips one in between. The fold runs inside one row per page.
    """
    known = blocks.groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("draw_order", "block_id"))).alias("b"))
    known = known.select("book_id", "page", F.transform("b", lambda x: x["block_id"]).alias("known"))
    per_page = proposals.groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "segment_id", "block_ids"))).alias("ps"))
    joined = per_page.join(known, ["book_id", "page"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    start = F.struct(F.array().cast("array<string>").alias("claimed"), F.array().cast("array<struct<seq:int,failure:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        ids = p["block_ids"]
        places = F.transform(ids, lambda b: F.array_position(F.col("known"), b))
        failure = (
            F.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_block_ref")
            .when((F.size(ids) == 0) | F.exists(ids, lambda b: b.isNull() | ~F.array_contains(F.col("known"), b)), "unknown_block_id")
            .when(F.arrays_overlap(ids, acc["claimed"]), "duplicate_block_ref")
            .when(F.array_max(places) - F.array_min(places) + 1 != F.size(ids), "non_contiguous_block_ids")
        )
        claimed = F.when(failure.isNull(), F.concat(acc["claimed"], ids)).otherwise(acc["claimed"])
        return F.struct(claimed.alias("claimed"), F.concat(acc["out"], F.array(F.struct(p["seq"].alias("seq"), failure.alias("failure")))).alias("out"))

    done = joined.withColumn("out", F.aggregate("ps", start, step)["out"])
    rows = done.select("book_id", "page", F.explode(F.arrays_zip("ps", "out")).alias("x"))
    return rows.select("book_id", "page", "x.ps.seq", "x.ps.segment_id", "x.ps.block_ids", "x.out.failure")


def segment_key(book: Column, ids: Column, content_type: Column, path: Column) -> Column:
    """book_id and the first 16 digits of the hash over book, blocks in the proposal's order, content type and path."""
    whole = F.concat_ws("|", book, F.array_join(ids, ","), content_type, F.array_join(path, "/"))
    return F.concat(book, F.lit("-"), F.substring(F.sha2(whole, 256), 1, 16))


def assemble(checked: DataFrame, proposals: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segments of valid proposals, and one fallback segment for each block no valid proposal claims.

    Result: segment_id, book_id, page, first_order, content_type, audience, inherited_audience, document_type,
    block_ids (source order), raw_text, normalized_text, joins, review_reasons, review_status.
    ``blocks`` are normalised and carry inherited_audience and document_type.
    """
    b = blocks.select("book_id", "page", "block_id", "draw_order", "raw_text", "normalized_text", "inherited_audience", "document_type", F.size("operations").alias("joins"), F.col("review_reasons").alias("block_reasons"))
    meta = proposals.select("book_id", "page", "seq", "content_type", "section_path", "audience")
    valid = checked.where("failure is null").join(meta, ["book_id", "page", "seq"])
    claims = valid.select("book_id", "page", "seq", "block_ids", "content_type", "section_path", "audience", F.explode("block_ids").alias("block_id"))
    parts = claims.join(b, ["book_id", "page", "block_id"])
    one = F.struct("draw_order", "block_id", "raw_text", "normalized_text", "inherited_audience", "document_type", "joins", "block_reasons")
    groups = parts.groupBy("book_id", "page", "seq").agg(
        F.array_sort(F.collect_list(one)).alias("p"), *[F.first(c).alias(c) for c in ("block_ids", "content_type", "section_path", "audience")]
    )
    pick = lambda c: F.transform("p", lambda x: x[c])
    groups = groups.withColumn("inherited", fold_audience(pick("inherited_audience"))).withColumn("types", F.array_distinct(pick("document_type")))
    lowered = (F.col("inherited") == "gm") & F.col("audience").isin("player", "shared")
    mixed = F.size("types") > 1
    reasons = F.array_distinct(F.concat(F.flatten(pick("block_reasons")), F.array_compact(F.array(F.when(lowered, "audience_downgrade_candidate"), F.when(mixed, "mixed_document_type_override")))))
    made = groups.select(
        segment_key(F.col("book_id"), F.col("block_ids"), F.col("content_type"), F.col("section_path")).alias("segment_id"), "book_id", "page",
        F.get("p", F.lit(0))["draw_order"].alias("first_order"), "content_type", F.when(lowered, "gm").otherwise(F.col("audience")).alias("audience"),
        F.col("inherited").alias("inherited_audience"), F.when(mixed, "unknown").otherwise(F.get("types", F.lit(0))).alias("document_type"),
        pick("block_id").alias("block_ids"), F.array_join(pick("raw_text"), TEXT_JOIN).alias("raw_text"), F.array_join(pick("normalized_text"), TEXT_JOIN).alias("normalized_text"),
        F.aggregate(pick("joins"), F.lit(0), lambda a, x: a + x).alias("joins"), reasons.alias("review_reasons"),
    )
    failed = checked.where("failure is not null").select("book_id", "page", "seq", "failure", F.explode(F.array_distinct("block_ids")).alias("block_id"))
    why = failed.groupBy("book_id", "page", "block_id").agg(F.min_by("failure", "seq").alias("why"))
    claimed = claims.select("book_id", "page", "block_id").distinct()
    rest = b.join(claimed, ["book_id", "page", "block_id"], "left_anti").join(why, ["book_id", "page", "block_id"], "left")
    fallback = rest.select(
        segment_key(F.col("book_id"), F.array("block_id"), F.lit("unknown"), F.array().cast("array<string>")).alias("segment_id"), "book_id", "page",
        F.col("draw_order").alias("first_order"), F.lit("unknown").alias("content_type"), F.col("inherited_audience").alias("audience"), "inherited_audience", "document_type",
        F.array("block_id").alias("block_ids"), "raw_text", "normalized_text", "joins", F.array_distinct(F.concat("block_reasons", F.array(F.coalesce("why", F.lit("unreferenced_block"))))).alias("review_reasons"),
    )
    out = made.unionByName(fallback)
    return out.withColumn("review_status", F.when(F.size("review_reasons") > 0, "required").otherwise("not_required"))


def neighbours(df: DataFrame, group: str, page: str, order: list[str], text: str) -> DataFrame:
    """Adds before and after: the text of the row before and after in the whole group, empty at its ends.

    Two levels, so that a group may be large: neighbours inside a page by a window over the page, at
    its edges by the last and first text of the pages around it. Pages without rows are stepped over.
    """
    own = Window.partitionBy(group, page).orderBy(*order)
    rows = df.withColumns({"__before": F.lag(text).over(own), "__after": F.lead(text).over(own), "__first": F.lag(F.lit(1)).over(own).isNull(), "__last": F.lead(F.lit(1)).over(own).isNull()})
    along = Window.partitionBy(group).orderBy(page)
    firsts = rows.where("__first").select(group, page, F.col(text).alias("__head"))
    lasts = rows.where("__last").select(group, page, F.col(text).alias("__tail"))
    ends = firsts.join(lasts, [group, page]).select(group, page, F.lag("__tail").over(along).alias("__prev"), F.lead("__head").over(along).alias("__next"))
    joined = rows.join(ends, [group, page], "left")
    return joined.withColumns({
        "before": F.coalesce(F.when(F.col("__first"), F.col("__prev")).otherwise(F.col("__before")), F.lit("")),
        "after": F.coalesce(F.when(F.col("__last"), F.col("__next")).otherwise(F.col("__after")), F.lit("")),
    }).drop("__before", "__after", "__first", "__last", "__prev", "__next")
