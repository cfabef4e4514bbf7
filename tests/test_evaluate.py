import pytest

from pagewright.operators import evaluate

SEG = "segment_id string, book_id string, source_spans array<struct<page: int, rect_id: string, start: int, end: int>>, content_type string, audience string"


def metrics(spark, gold, actual):
    make = lambda rows: spark.createDataFrame([(i, "b", [(1, "r", a, z)], c, au) for i, a, z, c, au in rows], SEG)
    return evaluate.structure(make(gold), make(actual)).first()[:]


def test_structure(spark):
    assert metrics(spark, [("s", 0, 4, "x", "gm")], [("s", 0, 2, "x", "player")]) == (0.5, 0.0, 1.0, 0.0, 1)
    assert metrics(spark, [("s", 0, 4, "x", "gm"), ("t", 2, 6, "y", "gm")], [("s", 0, 4, "x", "gm")]) == (0.666667, 0.5, 0.5, 0.5, 0)
    assert metrics(spark, [], [("s", 0, 4, "x", "gm")]) == (1.0, 1.0, 1.0, 1.0, 0)


def ranking(spark, ranked, relevant, k):
    r = spark.createDataFrame([(q, i, d) for q, ds in ranked.items() for i, d in enumerate(ds, 1)], "query_id string, rank int, item string")
    t = spark.createDataFrame([(q, d) for q, ds in relevant.items() for d in ds], "query_id string, item string")
    return evaluate.ranking_metrics(evaluate.ranking_scores(r, t, k)).first()[:]


def test_rankings(spark):
    assert ranking(spark, {"q": ["s1", "s2", "s3"]}, {"q": ["s2"]}, 3) == (1.0, 0.5, 0.63093)
    assert ranking(spark, {"q": ["s1"]}, {"q": ["s1"], "p": ["s9"]}, 3) == (0.5, 0.5, 0.5)
    assert ranking(spark, {"q": ["s1", "s2"]}, {"q": ["s2"]}, 1) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        ranking(spark, {"q": ["s1"]}, {"q": ["s1"]}, 0)


def test_nearest_breaks_ties_by_id_and_searches_in_blocks(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    monkeypatch.setattr(evaluate, "BLOCK", 1)
    got = [tuple(r) for r in evaluate.nearest(df.where("id in (1, 4)"), df, "id", "v", 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 3), (4, 1, 1), (4, 2, 2)]


def test_relevance_by_label_and_nearest_against_all_pairs(spark, monkeypatch):
    import numpy as np

    from pagewright.operators import evaluate

    monkeypatch.setattr(evaluate, "CELLS", 40)  # several pieces a batch
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (120, 4)).astype(float)  # many ties
    rows = [(i, v[i].tolist(), None if i % 11 == 0 else i % 5) for i in range(120)]
    e = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    near = evaluate.nearest(e.where("vec_id % 10 = 0"), e.select("vec_id", "embedding"), "vec_id", "embedding", 7)
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    want = {(q, k + 1): i for q in range(0, 120, 10) for k, i in enumerate(sorted((i for i in range(120) if i != q), key=lambda i: (-round(float(unit[i] @ unit[q]), 9), i))[:7])}
    assert {(r.query_id, r["rank"]): r.vec_id for r in near.collect()} == want
    ranked = near.withColumnRenamed("vec_id", "item")
    queries, items = e.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "label"), e.selectExpr("vec_id as item", "label")
    pairs = queries.join(items, "label").where("query_id <> item").select("query_id", "item")
    assert {tuple(r) for r in evaluate.label_scores(ranked, queries, items, 5).collect()} == {tuple(r) for r in evaluate.ranking_scores(ranked, pairs, 5).collect()}
