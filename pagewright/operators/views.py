"""Texts derived from segments for retrieval and for topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = {"player": ("gm", "unknown"), "gm": (), "all": ()}


def visible(segments: DataFrame, mode: str) -> DataFrame:
    """Rows a reader of ``mode`` (player, gm, all) may see, less rejected ones."""
    rows = segments.where("review_status is null or review_status <> 'rejected'")
    return rows.where(~F.coalesce("audience", F.lit("unknown")).isin(*HIDDEN[mode])) if HIDDEN[mode] else rows


def _text(head: Column) -> Column:
    path = F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(head, F.lit("\n章節: "), path, F.lit("\n種別: "), blank("content_type"), F.lit("\n本文: "), blank("normalized_text"))


def _columns(kind: str, text: Column) -> list[Column]:
    return [F.col("segment_id"), F.lit(kind).alias("input_type"), text.alias("text"), F.col("book_id"), F.col("audience"), F.col("content_type"), F.size("source_spans").alias("spans")]


def retrieval(segments: DataFrame, titles: DataFrame, mode: str = "player") -> DataFrame:
    """One search text per visible segment; a book without title goes by its id. titles: (book_id, title)."""
    joined = visible(segments, mode).join(titles, "book_id", "left")
    return joined.select(*_columns("document", _text(F.concat(F.lit("検索文書: 書籍: "), F.coalesce("title", "book_id")))))


def topic(segments: DataFrame, mode: str = "player") -> DataFrame:
    """One topic text per visible segment; its first line stays where there are no entities."""
    names = F.array_join(F.coalesce("entities", F.array().cast("array<string>")), "、")
    return visible(segments, mode).select(*_columns("topic", _text(F.concat(F.lit("トピック: "), names))))
