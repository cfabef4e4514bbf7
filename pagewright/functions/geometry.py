"""Rectangles as columns: clamping, overlap, area ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(value, high))


def edges(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """struct<left, top, right, bottom> inside the page; null if nothing of a pixel's size is left."""
    box = F.struct(clamp(x, 0, page_w).alias("left"), clamp(y, 0, page_h).alias("top"), clamp(x + w, 0, page_w).alias("right"), clamp(y + h, 0, page_h).alias("bottom"))
    return F.when((box["right"] - box["left"] >= 1) & (box["bottom"] - box["top"] >= 1), box)


def overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Signed overlap along one axis."""
    return F.least(a_high, b_high) - F.greatest(a_low, b_low)


def gap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Distance along one axis, 0 where they overlap."""
    return F.greatest(a_low - b_high, b_low - a_high, F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(overlap(a["left"], a["right"], b["left"], b["right"]), F.lit(0))
    return w * F.greatest(overlap(a["top"], a["bottom"], b["top"], b["bottom"]), F.lit(0))


def area(a: Column) -> Column:
    return (a["right"] - a["left"]) * (a["bottom"] - a["top"])


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return both / (area(a) + area(b) - both)


def greedy_matches(pairs: Column) -> Column:
    """Of pairs array<struct<share, one, two>> the best ones, each side used once: by share from the largest, of equal ones by names.

    A page is bounded, so the fold runs inside its row.
    """
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct((-p["share"]).alias("less"), p["one"].alias("one"), p["two"].alias("two"))))
    names, kept = F.array().cast("array<string>"), F.array().cast("array<struct<one:string,two:string,share:double>>")

    def step(done: Column, p: Column) -> Column:
        free = ~F.array_contains(done["ones"], p["one"]) & ~F.array_contains(done["twos"], p["two"])
        grown = lambda c, v: F.when(free, F.concat(done[c], F.array(v))).otherwise(done[c]).alias(c)
        return F.struct(grown("ones", p["one"]), grown("twos", p["two"]), grown("kept", F.struct(p["one"].alias("one"), p["two"].alias("two"), (-p["less"]).alias("share"))))

    return F.aggregate(ordered, F.struct(names.alias("ones"), names.alias("twos"), kept.alias("kept")), step)["kept"]


def from_polygon(points: Column, page_w: Column, page_h: Column) -> Column:
    """The upright rectangle around polygon points struct<x, y>, inside the page; null if degenerate or of under four points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    box = edges(x, y, F.array_max(xs) - x, F.array_max(ys) - y, page_w, page_h)
    return F.when(F.size(points) >= 4, box)


def padded(box: Column, padding: int, page_w: Column, page_h: Column) -> Column:
    """A box with room around it, inside the page."""
    return F.struct(
        F.greatest(box["left"] - padding, F.lit(0)).alias("left"), F.greatest(box["top"] - padding, F.lit(0)).alias("top"),
        F.least(box["right"] + padding, page_w).alias("right"), F.least(box["bottom"] + padding, page_h).alias("bottom"),
    )


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def display_to_natural(value: Column, scale: Column, high: Column) -> Column:
    """A display coordinate in image pixels, halves up, inside the image."""
    return clamp(F.floor(value * scale + 0.5), 0, high)


def active_blocks(granularity: Column, paragraphs: Column, vertical: Column, horizontal: Column) -> Column:
    """The blocks of the wanted granularity, the paragraphs where there are none."""
    wanted = F.when(granularity == "vertical", vertical).when(granularity == "horizontal", horizontal)
    return F.when(F.size(wanted) > 0, wanted).otherwise(paragraphs)
