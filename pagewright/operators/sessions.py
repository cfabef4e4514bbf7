"""Saved page sessions: merged, searched for work, and written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKDOWN_JOIN = "\n\n---\n\n"


def merge_regions(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """incoming regions with what is known about them: a done region keeps its text and status, geometry is the incoming one's.

    Regions only existing are dropped. Both have ``keys``, text, ocr_status, ocr_error, ocr_completed_at.
    """
    fields = ["text", "ocr_status", "ocr_error", "ocr_completed_at"]
    old = existing.select(*keys, F.struct(*fields).alias("__old"))
    joined = incoming.join(old, keys, "left")
    keep = F.col("__old.ocr_status") == "done"
    return joined.select(*[F.when(keep, F.col(f"__old.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in incoming.columns], F.coalesce(keep, F.lit(False)).alias("kept"))


def fold_saves(saves: DataFrame, keys: list[str], region: str, order: list[str]) -> DataFrame:
    """The regions of each page's last save as they stand after all its saves, one after the other by merge_regions.

    saves has a row per region of each save: ``keys`` of the page, ``region``, the ``order`` of saves, text,
    ocr_status, ocr_error, ocr_completed_at. A region keeps the text of the first save that had it done,
    of those since which no save lacks it; it has the geometry of the last. Adds kept: whether an earlier
    save's text stands.
    """
    fields = ["text", "ocr_status", "ocr_error", "ocr_completed_at"]
    numbers = saves.select(*keys, *order).distinct().withColumn("__no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    last = numbers.groupBy(*keys).agg(F.max("__no").alias("__last"))
    rows = saves.join(numbers, [*keys, *order]).join(last, keys)
    since = Window.partitionBy(*keys, region).orderBy(F.desc("__no"))
    run = rows.withColumn("__back", F.row_number().over(since)).where(F.col("__no") + F.col("__back") == F.col("__last") + 1)
    done = F.col("ocr_status") == "done"
    state = F.struct("__no", *fields)
    whole = run.groupBy(*keys, region).agg(F.min(F.when(done, state)).alias("__done"), F.max(F.struct("__no", *[c for c in saves.columns if c not in (*keys, region, *order)])).alias("__now"))
    kept = F.coalesce(F.col("__done.__no") < F.col("__now.__no"), F.lit(False))
    rest = [c for c in saves.columns if c not in (*keys, region, *order)]
    return whole.select(*keys, region, *[(F.when(kept, F.col(f"__done.{c}")).otherwise(F.col(f"__now.{c}")) if c in fields else F.col(f"__now.{c}")).alias(c) for c in rest], kept.alias("kept"))


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], place: str = "draw_order") -> DataFrame:
    """existing rows with changed ones replaced in place; rows that are new are appended."""
    old = existing.join(changes.select(*keys), keys, "left_anti")
    at = existing.select(*keys, F.col(place).alias("__at"))
    new = changes.join(at, keys, "left").withColumn(place, F.coalesce("__at", place)).drop("__at")
    return old.unionByName(new)


def still_valid(results: DataFrame, current: DataFrame, keys: list[str], geometry: list[str]) -> DataFrame:
    """Results of work whose region still exists with the geometry it had; others are dropped."""
    now = current.select(*keys, *geometry)
    same = [results[c].eqNullSafe(now[c]) for c in [*keys, *geometry]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return results.join(now, cond, "left_semi")


def work_list(regions: DataFrame, retry_errors: bool = True) -> DataFrame:
    """Regions not done yet: pending ones, and failed ones if wanted."""
    wanted = ["pending", "error"] if retry_errors else ["pending"]
    return regions.where(F.col("ocr_status").isin(wanted))


def markdown(regions: DataFrame, keys: list[str]) -> DataFrame:
    """The texts of each page's done regions in draw order, null as empty, between rules."""
    done = regions.where("ocr_status = 'done'")
    texts = done.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("draw_order", "rect_id", F.coalesce("text", F.lit("")).alias("t")))).alias("r"))
    return texts.select(*keys, F.array_join(F.transform("r", lambda x: x["t"]), MARKDOWN_JOIN).alias("markdown"))


def next_order(regions: DataFrame, keys: list[str]) -> DataFrame:
    """The draw order a further region of each page gets."""
    return regions.groupBy(*keys).agg((F.coalesce(F.max("draw_order"), F.lit(-1)) + 1).alias("next_order"))
