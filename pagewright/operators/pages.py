"""Page sessions, regions, books and segments as the other operators take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_KEYS = ["book_id", "page", "rect_id"]


def page_number(name: Column, pattern: str = r"([0-9]+)", group: int = 1) -> Column:
    """The page a file name carries; null without one. ``pattern`` is searched, ``group`` holds the number."""
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit("")).cast("int")


def java_pattern(pattern: str, group: str = "page") -> tuple[str, int]:
    """A pattern with Python's named groups as one with numbered groups, and the number of ``group``."""
    import re

    return re.sub(r"\(\?P<\w+>", "(", pattern), re.compile(pattern).groupindex[group]


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; the order must be total for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def current_sessions(sessions: DataFrame) -> DataFrame:
    """One session per page of a book: the one saved last (of equal times the larger session_id)."""
    pages = sessions.withColumn("page", page_number(F.col("file_name")))
    return latest(pages, ["book_id", "page"], [F.desc("saved_at"), F.desc("session_id")])


def current_regions(sessions: DataFrame) -> DataFrame:
    """Regions of the current sessions, one row each."""
    s = current_sessions(sessions).select("book_id", "page", "image_name", "image_width", "image_height", F.explode("regions").alias("r"))
    return s.select("book_id", "page", "image_name", "image_width", "image_height", "r.rectangle.*", "r.text", "r.ocr_status", "r.ocr_error", "r.ocr_completed_at")


def block_sizes(sessions: DataFrame) -> DataFrame:
    """book_id, page, rect_id, chars of the blocks of the current sessions: lengths are taken before anything moves, texts stay where they are."""
    done = F.filter("regions", lambda r: (r["ocr_status"] == "done") & (F.length(r["text"]) > 0))
    slim = F.transform(done, lambda r: F.struct(r["rectangle"]["rect_id"].alias("rect_id"), F.length(r["text"]).alias("chars")))
    s = current_sessions(sessions.select("book_id", "file_name", "saved_at", "session_id", slim.alias("sizes"))).where("page is not null")
    return s.select("book_id", "page", F.inline("sizes"))


def block_id() -> Column:
    return F.format_string("%s:p%03d:%s", "book_id", "page", "rect_id")


def blocks(regions: DataFrame) -> DataFrame:
    """Regions that were read and have text, with their block_id and raw_text."""
    done = regions.where("ocr_status = 'done' and text is not null and text <> '' and page is not null")
    return done.withColumn("block_id", block_id()).withColumnRenamed("text", "raw_text")


def region_problem() -> Column:
    """Why a region can't be taken: it is not done, has no text or leaves its page; null if it can."""
    undone = F.coalesce(F.col("ocr_status") != "done", F.lit(True))
    outside = (F.col("x") + F.col("width") > F.col("image_width")) | (F.col("y") + F.col("height") > F.col("image_height"))
    return F.when(undone, "region is not done").when(F.col("text").isNull(), "region has no text").when(outside, "rectangle leaves the page")


def refuse_unfinished(regions: DataFrame) -> DataFrame:
    """Fails on a region with a problem; else gives the regions unchanged."""
    problem = region_problem()
    message = F.format_string("%s: page %d, %s", problem, F.col("page"), F.col("rect_id"))
    return regions.where(F.when(problem.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def books(manifest: DataFrame) -> DataFrame:
    """One row per book; repeated rows, which differ in schema_version at most, become one."""
    columns = [c for c in manifest.columns if c not in ("book_id", "schema_version")]
    return manifest.groupBy("book_id").agg(*[F.first(c).alias(c) for c in columns])


def current_segments(segments: DataFrame) -> DataFrame:
    """One row per segment: the one loaded last."""
    return latest(segments, ["segment_id"], [F.desc("loaded_at")])


def audience_of_page(page: Column, overrides: Column, default: Column) -> Column:
    """The last override whose inclusive range holds the page wins, else the default."""
    hits = F.filter(overrides, lambda o: page.between(o["start_page"], o["end_page"]))
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["audience"], default)


def document_type_of_page(page: Column, overrides: Column, default: Column) -> Column:
    """The first override whose inclusive range holds the page wins, else the default."""
    hits = F.filter(overrides, lambda o: page.between(o["start_page"], o["end_page"]))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["document_type"], default)


def page_attributes(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """``pages`` (book_id, page, ...) with inherited_audience and document_type of each page."""
    b = books(manifest).select("book_id", "audience_overrides", "document_type_overrides", "default_audience", "default_document_type")
    joined = pages.join(b, "book_id", "left")
    return joined.withColumns({
        "inherited_audience": audience_of_page(F.col("page"), F.col("audience_overrides"), F.coalesce("default_audience", F.lit("unknown"))),
        "document_type": document_type_of_page(F.col("page"), F.col("document_type_overrides"), F.coalesce("default_document_type", F.lit("unknown"))),
    }).drop("audience_overrides", "document_type_overrides", "default_audience", "default_document_type")
