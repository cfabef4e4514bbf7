"""Overlapping and gapped intervals to covered stretches and the gaps between them (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a shard. It bounds what one task can hold of a key: at most this many distinct starts.
SHARD_WIDTH = 4096


def covered_and_gaps(
    df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = SHARD_WIDTH
) -> DataFrame:
    """Maximal covered stretches of half-open [start, end) per key, and the gaps between neighbouring ones.

    Result: ``keys``, kind (`covered`, `gap`), span_start, span_end; other columns are dropped. Rows with a
    null key, start or end, or with end <= start, are ignored. Touching intervals belong together,
    repeated rows change nothing, an empty table gives an empty result.

    Two levels, so that one key may hold any share of the rows: intervals are clipped into shards of
    ``width``; per (key, shard, start) only the farthest end survives, combined before the shuffle;
    each shard is merged by itself; then only the first and last run of each shard are stitched along
    the key.
    """
    keyed = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    spans = df.select(*keyed, F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"))
    spans = spans.where(F.expr(" and ".join([f"{k} is not null" for k in names] + ["e > s"])))
    w = F.lit(width)
    lo, hi = F.floor(F.col("s") / w), F.floor((F.col("e") - 1) / w)
    clipped = spans.withColumn("shard", F.explode(F.sequence(lo, hi))).select(
        *names, "shard", F.greatest("s", F.col("shard") * w).alias("s"), F.least("e", (F.col("shard") + 1) * w).alias("e")
    )
    far = clipped.groupBy(*names, "shard", "s").agg(F.max("e").alias("e"))

    own = Window.partitionBy(*names, "shard").orderBy("s")
    runs = _islands(far, own, [*names, "shard"], F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1)) < F.col("s"))
    local = runs.select(
        *names, "shard", "s", "e",
        F.lag("s").over(own).isNull().alias("head"), F.lead("s").over(own).alias("next"),
    )
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    edge = F.col("head") | F.col("next").isNull()
    # an inner run is final; what an edge run leaves open is settled along the key
    settled = local.select(
        *names,
        F.explode(F.array_compact(F.array(
            F.when(~edge, piece("covered", F.col("s"), F.col("e"))),
            F.when(F.col("next").isNotNull(), piece("gap", F.col("e"), F.col("next"))),
        ))).alias("p"),
    ).select(*names, "p.*")
    edges = local.where(edge).select(*names, "shard", "s", "e", "head", F.col("next").isNull().alias("tail"))
    along = Window.partitionBy(*names).orderBy("s")
    opens = ~F.col("head") | F.lag("e").over(along).isNull() | (F.lag("e").over(along) < F.col("s"))
    marked = edges.withColumns({"opens": opens, "before": F.when(F.col("head"), F.lag("e").over(along))})
    island = marked.withColumn("run", F.sum(F.col("opens").cast("long")).over(along))
    whole = island.groupBy(*names, "run").agg(F.min("s").alias("a"), F.max("e").alias("b"))
    stitched = whole.select(*names, F.lit("covered").alias("kind"), "a", "b")
    between = marked.where("head and before < s").select(*names, F.lit("gap").alias("kind"), F.col("before").alias("a"), F.col("s").alias("b"))
    out = settled.unionByName(stitched).unionByName(between)
    return out.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], "kind", F.col("a").alias("span_start"), F.col("b").alias("span_end")
    )


def _islands(df: DataFrame, order, names: list[str], breaks: Column) -> DataFrame:
    """Runs of rows between breaks: (names, s, e)."""
    flagged = df.withColumn("new", F.coalesce(breaks, F.lit(True)).cast("long"))
    return flagged.withColumn("run", F.sum("new").over(order)).groupBy(*names, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
