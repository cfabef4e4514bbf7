from pyspark.sql import functions as F

from pagewright.operators import validate as v


def regions(spark, **texts):
    return spark.createDataFrame([("b", 1, k, t) for k, t in texts.items()], "book_id string, page int, rect_id string, raw_text string")


def spans(spark, *rows):
    return spark.createDataFrame([(s, "b", 1, r, a, z) for s, r, a, z in rows], "segment_id string, book_id string, page int, rect_id string, start int, end int")


def runs(spark, *rows, **texts):
    return v.depth_runs(spans(spark, *rows), regions(spark, **texts))


def stretch(df):
    return sorted((r.rect_id, r.start, r.end) for r in df.collect())


def test_gaps_overlaps_and_coverage(spark):
    r = runs(spark, ("s", "r", 0, 4), ("t", "r", 2, 6), ("u", "r", 3, 5), ("u", "r", 8, 99), r="0123456789", q="ab")
    assert stretch(v.gaps(r)) == [("q", 0, 2), ("r", 6, 8)]
    assert stretch(v.overlaps(r)) == [("r", 2, 5)]
    c = v.coverage(r).first()
    assert (c.covered, c.total, c.ratio) == (8, 12, 0.666667)
    assert v.coverage(runs(spark, r="x").where("false")).first().ratio == 1.0


def test_references_and_order(spark):
    bad = v.invalid_references(spans(spark, ("s", "r", 0, 4), ("t", "no", 0, 1), ("u", "r", 3, 9)), regions(spark, r="0123"))
    assert sorted(r.segment_id for r in bad.collect()) == ["t", "u"]
    kind = "segment_id string, source_spans array<struct<page: int, rect_id: string, start: int, end: int>>"
    rows = [("ok", [(1, "a", 0, 1), (1, "b", 0, 1), (2, "a", 0, 1)]), ("page", [(2, "a", 0, 1), (1, "a", 0, 1), (0, "a", 0, 1)]), ("start", [(1, "a", 5, 6), (1, "a", 0, 1)]), ("none", [])]
    assert sorted((r.segment_id, r.at) for r in v.reversals(spark.createDataFrame(rows, kind)).collect()) == [("page", 1), ("start", 1)]


def test_cycles_without_tails(spark):
    df = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("t", "a", 1), ("r", None, 1)], "segment_id string, parent_segment_id string, loaded_at int")
    assert sorted((r.segment_id, r.root_id) for r in v.parent_cycles(df).collect()) == [("a", "a"), ("b", "a")]


def test_exit_codes(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (0, 2, 2, 1), (0, 2, 1, 1), (0, 0, 0, 0)], "i int, c int, f int, e int")
    got = [r[0] for r in df.select(v.exit_code(F.col("i"), F.col("c"), F.col("f"), F.col("e"))).collect()]
    assert got == [2, 3, 4, 0]


def test_one_hot_key_in_a_join(spark):
    from pyspark.sql import functions as F

    from pagewright.runtime import skew_join

    many = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("up"))
    one = spark.createDataFrame([("hot", 1), ("950", 2), ("x", 3)], "name string, v int")
    for part in (10, 10_000):
        got = skew_join(many, "up", one, "name", "id", 1000, "left", part)
        assert got.columns == ["id", "up", "name", "v"] and got.count() == 1000 and got.agg(F.sum("v")).first()[0] == 902
        assert skew_join(many, "up", one, "name", "id", 1000, part=part).count() == 901
