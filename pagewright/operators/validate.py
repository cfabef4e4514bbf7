"""Coverage, references, order, parent links and visibility of segments, as rows of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.hierarchy import resolve_hierarchy

HIDDEN_FROM_PLAYERS = ("gm", "unknown")
KEYS = ["book_id", "page", "rect_id"]


def _size(regions: DataFrame) -> DataFrame:
    """Length of each region's text, from chars where that is known."""
    return regions.select(*KEYS, (F.col("chars") if "chars" in regions.columns else F.length("raw_text")).alias("n"))


def depth_runs(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """book_id, page, rect_id, a, b, depth: stretches of each region's text and how many spans cover them.

    Event sweep: +1 and -1 at clipped span ends, summed per position before the running sum, so a
    region many spans share stays small. Every region gives at least its own bounds.
    """
    size = _size(regions)
    clipped = spans.join(size, KEYS).select(*KEYS, "n", F.least("start", "n").alias("a"), F.least("end", "n").alias("b")).where("b > a and a >= 0")
    events = clipped.select(*KEYS, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*KEYS, "e.*")
    bounds = size.select(*KEYS, F.explode(F.array(F.lit(0), F.col("n"))).alias("at"), F.lit(0).alias("d"))
    steps = events.unionByName(bounds).groupBy(*KEYS, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*KEYS).orderBy("at")
    runs = steps.select(*KEYS, F.col("at").alias("a"), F.lead("at").over(w).alias("b"), F.sum("d").over(w).alias("depth"))
    return runs.where("b is not null and b > a")


def _islands(runs: DataFrame, *more: str) -> DataFrame:
    """Neighbouring stretches joined into maximal ones."""
    w = Window.partitionBy(*KEYS, *more).orderBy("a")
    marked = runs.withColumn("new", F.when(F.lag("b").over(w) == F.col("a"), 0).otherwise(1))
    return marked.withColumn("i", F.sum("new").over(w)).groupBy(*KEYS, *more, "i").agg(F.min("a").alias("start"), F.max("b").alias("end")).drop("i")


def flaws(runs: DataFrame) -> DataFrame:
    """Gaps and overlaps at once, told apart by their code."""
    code = F.when(F.col("depth") == 0, "source_gap").when(F.col("depth") >= 2, "source_overlap")
    return _islands(runs.withColumn("code", code).where("code is not null"), "code")


def gaps(runs: DataFrame) -> DataFrame:
    return _islands(runs.where("depth = 0"))


def overlaps(runs: DataFrame) -> DataFrame:
    return _islands(runs.where("depth >= 2"))


def coverage(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Covered and total characters and their ratio, 1 where there is no text."""
    long = F.col("b") - F.col("a")
    sums = runs.groupBy(*(by or [])).agg(F.coalesce(F.sum(F.when(F.col("depth") > 0, long)), F.lit(0)).alias("covered"), F.coalesce(F.sum(long), F.lit(0)).alias("total"))
    return sums.withColumn("ratio", F.round(F.when(F.col("total") == 0, 1.0).otherwise(F.col("covered") / F.col("total")), 6))


def invalid_references(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Spans of no region, beyond the text of theirs, or broken: without a place, of no length, starting below 0."""
    size = _size(regions)
    joined = spans.join(size, KEYS, "left")
    return joined.where("n is null or start is null or end is null or start < 0 or end <= start or start >= n or end > n").drop("n")


def reversals(segments: DataFrame) -> DataFrame:
    """segment_id, page, rect_id, at: the first span that goes back, to an earlier page or start of its region. Inside the row."""
    spans = F.col("source_spans")
    back = F.transform(spans, lambda s, i: F.struct(
        i.alias("at"), s["page"].alias("page"), s["rect_id"].alias("rect_id"),
        ((i > 0) & ((s["page"] < F.get(spans, i - 1)["page"]) | ((s["page"] == F.get(spans, i - 1)["page"]) & (s["rect_id"] == F.get(spans, i - 1)["rect_id"]) & (s["start"] < F.get(spans, i - 1)["start"])))).alias("back"),
    ))
    first = F.get(F.filter(back, lambda x: x["back"]), F.lit(0))
    return segments.select("segment_id", first.alias("f")).where("f is not null").select("segment_id", "f.page", "f.rect_id", "f.at")


def parent_cycles(segments: DataFrame) -> DataFrame:
    """segment_id and root_id (smallest of the cycle) of the segments on a cycle; those that only lead into one are not reported."""
    tree = resolve_hierarchy(segments, "segment_id", "parent_segment_id", "loaded_at")
    return tree.where("on_cycle").select("segment_id", "root_id")


def visibility_errors(exported: DataFrame) -> DataFrame:
    """Rows players must not see, with the code of the error."""
    code = F.when(F.col("audience") == "gm", "gm_audience_visible").when(F.col("audience") == "unknown", "unknown_audience_visible")
    return exported.withColumn("code", code).where("code is not null").select("segment_id", "code")


def errors(segments: DataFrame, spans: DataFrame, regions: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """All errors as rows: code, segment_id, page, rect_id, start, end. A gap or overlap is put to the first segment of its region.

    ``spans`` are the sound ones, ``given`` all there are, broken ones among them.
    """
    runs = depth_runs(spans, regions)
    first = spans.groupBy(*KEYS).agg(F.min_by("segment_id", F.struct("start", "segment_id")).alias("segment_id"))
    blank = lambda d, code, **k: d.select((F.lit(code) if code else F.col("code")).alias("code"), "segment_id", *[(k.get(c) if c in k else F.col(c)).cast(t).alias(c) for c, t in (("page", "int"), ("rect_id", "string"), ("start", "int"), ("end", "int"))])
    none = F.lit(None)
    parts = [
        blank(flaws(runs).join(first, KEYS, "left"), None),
        blank(invalid_references(spans if given is None else given, regions), "invalid_source_ref"),
        blank(reversals(segments), "source_order_reversal", start=none, end=none),
        blank(parent_cycles(segments), "parent_cycle", page=none, rect_id=none, start=none, end=none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exit_code(input_errors: Column, classified: Column, failed: Column, errors_: Column) -> Column:
    """2 for bad input, 3 where every classified page failed, 4 for validation errors, else 0; the first that holds."""
    all_failed = (classified > 0) & (failed > 0) & (failed >= classified)
    return F.when(input_errors > 0, 2).when(all_failed, 3).when(errors_ > 0, 4).otherwise(0)
