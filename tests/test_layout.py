import numpy as np
import pytest
from layout_pages import PAGES
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.operators import layout


def iou(a, b):
    w, h = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (0, 1))
    both = max(w, 0) * max(h, 0)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def matched(expected, got):
    """Which of ``got`` is which of ``expected``: the best pairs first, each box once."""
    pairs = sorted(((iou(e, g_), i, j) for i, e in enumerate(expected) for j, g_ in enumerate(got)), reverse=True)
    own: dict[int, int] = {}
    for share, i, j in pairs:
        if share > 0 and i not in own and j not in own.values():
            own[i] = j
    return own


@pytest.mark.parametrize("kind,width,height,boxes,expected", PAGES)
def test_pages_as_a_reader_sees_them(kind, width, height, boxes, expected):
    got = (layout.vertical_blocks if kind == "vertical" else layout.horizontal_blocks)(np.array(boxes), width, height)
    own = matched(expected, got)
    assert sorted(own) == list(range(len(expected)))
    if kind == "vertical":
        assert len(got) == len(expected)
        assert all(iou(e, got[own[k]]) >= (0.6 if e[2] * e[3] <= 0.005 * width * height else 0.8) for k, e in enumerate(expected))
    else:
        assert all(iou(e, got[own[k]]) >= 0.5 for k, e in enumerate(expected)) and list(own[k] for k in sorted(own)) == sorted(own.values())
    for b in got:  # none runs over two of the blocks
        inside = [max(0, min(b[0] + b[2], e[0] + e[2]) - max(b[0], e[0])) * max(0, min(b[1] + b[3], e[1] + e[3]) - max(b[1], e[1])) / (e[2] * e[3]) for e in expected]
        assert sum(x >= 0.5 for x in inside) <= 1


def test_cleaning_keeps_the_larger_of_contained_boxes():
    boxes = np.array([(10, 10, 50, 50), (12, 12, 20, 20), (-5, 90, 30, 30), (40, 40, 50, 50), (200, 0, 9, 9)])
    assert layout._sizes(layout.clean(boxes.astype(float), 100, 100)).tolist() == [[10, 10, 50, 50], [40, 40, 50, 50], [0, 90, 25, 10]]


def test_degenerate_pages():
    none = np.zeros((0, 4))
    for f in (layout.vertical_blocks, layout.horizontal_blocks):
        assert len(f(none, 100, 100)) == len(f(np.array([(0, 0, 5, 5)]), 0, 100)) == len(f(np.array([(300, 300, 5, 5)]), 100, 100)) == 0
        assert f(np.array([(10, 1, 5, 1)]), 100, 100).tolist() == [[10, 1, 5, 1]]  # noise alone stays


def test_two_columns_are_read_from_the_side_of_the_writing():
    boxes = np.array([(50, 200, 400, 300), (50, 510, 400, 300), (550, 200, 400, 300), (550, 510, 400, 300)])
    v, h = layout.vertical_blocks(boxes, 1000, 1000), layout.horizontal_blocks(boxes, 1000, 1000)
    assert [b[0] < 500 for b in v.tolist()] == [True, False]
    assert len(h) == 1 or [b[0] < 500 for b in h.tolist()] == [False, True]


def test_clusters_grow_downwards():
    boxes = np.array([(0, 0, 100, 20), (10, 25, 80, 20), (200, 0, 50, 20), (0, 300, 100, 20)], float)
    assert sorted(map(sorted, layout.clusters(boxes, 400, 1000))) == [[0, 1], [2], [3]] or len(layout.clusters(boxes, 400, 1000)) == 3


def test_pages_as_groups(spark):
    rows = [("b", 1, x, y, w, h, 1000, 1000) for x, y, w, h in [(50, 200, 400, 300), (550, 200, 400, 300)]] + [("b", 2, None, 1, 1, 1, 10, 10)]
    df = spark.createDataFrame(rows, "book string, page int, x int, y int, width int, height int, image_width int, image_height int")
    assert [(r.page, r.block_no) for r in layout.page_blocks(df, ["book", "page"]).orderBy("block_no").collect()] == [(1, 0), (1, 1)]
    assert layout.page_rects(df.limit(0), ["book", "page"]).count() == 0
    assert layout.page_clusters(df, ["book", "page"]).agg(F.sum("members")).first()[0] == 2


def test_rectangle_columns(spark):
    c = lambda *v: [F.lit(x) for x in v]
    row = spark.range(1).select(
        g.edges(*c(-5, 5, 20, 20, 10, 100)).alias("a"), g.edges(*c(50, 5, 20, 20, 10, 100)).alias("b"), g.round_half_even(F.lit(2.5)).alias("c"), g.round_half_even(F.lit(3.5)).alias("d"),
        g.display_to_natural(F.lit(5.0), F.lit(0.5), F.lit(2)).alias("e"), g.from_polygon(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 2), (9, 2), (9, 7), (1, 7))]), F.lit(8), F.lit(8)).alias("f"),
    ).first()
    assert row.a[:] == (0, 5, 10, 25) and row.b is None and (row.c, row.d, row.e) == (2, 4, 2) and row.f[:] == (1, 2, 8, 7)
    assert spark.range(1).select(g.iou(row_box(0, 0, 10, 10), row_box(5, 0, 15, 10)), g.gap(*c(0, 5, 9, 12)), g.gap(*c(0, 5, 4, 12))).first()[:] == (50 / 150, 4, 0)
    assert spark.range(1).select(g.padded(row_box(5, 5, 90, 90), 15, F.lit(100), F.lit(100)).alias("p")).first().p[:] == (0, 0, 100, 100)


def row_box(l, t, r, b):
    return F.struct(*[F.lit(v).alias(n) for v, n in ((l, "left"), (t, "top"), (r, "right"), (b, "bottom"))])


def test_blocks_of_the_wanted_granularity(spark):
    df = spark.createDataFrame([("vertical", [1], [2], []), ("horizontal", [1], [2], []), ("paragraph", [1], [2], [3]), ("vertical", [1], None, [3])], "g string, p array<int>, v array<int>, h array<int>")
    assert [r[0] for r in df.select(g.active_blocks(*[F.col(c) for c in "gpvh"])).collect()] == [[2], [1], [1], [1]]


def test_pages_go_on_in_the_next_batch():
    import pyarrow as pa

    make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["k", "v"])
    got = [(k, r[:, 0].tolist()) for k, r in layout._pages(iter([make([("a", 1), ("a", 2)]), make([("a", 3), ("b", 4)]), make([]), make([("b", 5)]), make([("c", 6)])]), 1)]
    assert got == [(("a",), [1, 2, 3]), (("b",), [4, 5]), (("c",), [6])]
