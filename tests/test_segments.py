import hashlib

from pyspark.sql import functions as F

from pagewright.operators import segments as seg

BLOCKS = "book_id string, page int, block_id string, draw_order int, raw_text string, normalized_text string, inherited_audience string, document_type string, operations array<int>, review_reasons array<string>"


def blocks(spark, *names, page=1, audience="shared"):
    return spark.createDataFrame([("b", page, n, i, f"raw {n}", f"norm {n}", audience, "rulebook", [], ["short"] if n == "odd" else []) for i, n in enumerate(names)], BLOCKS)


def proposals(spark, *ids, audience="shared"):
    rows = [("b", 1, k, f"s{k}", list(i), "rule", ["ch"], audience) for k, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "book_id string, page int, seq int, segment_id string, block_ids array<string>, content_type string, section_path array<string>, audience string")


def verdicts(spark, *ids, known=("x", "y", "z")):
    out = seg.checked_proposals(proposals(spark, *ids), blocks(spark, *known)).orderBy("seq").collect()
    return [r.failure for r in out]


def test_claims_in_order(spark):
    assert verdicts(spark, ["x", "y"], ["y", "z"], ["z"]) == [None, "duplicate_block_ref", None]
    assert verdicts(spark, ["x", "x"], ["x", "z"], ["q"], ["y", "x"]) == ["duplicate_block_ref", "non_contiguous_block_ids", "unknown_block_id", None]
    assert verdicts(spark, [], [None]) == ["unknown_block_id"] * 2


def test_assembly_keeps_every_block(spark):
    b, p = blocks(spark, "x", "y", "odd", audience="gm"), proposals(spark, ["y", "x"], ["y"])
    rows = seg.assemble(seg.checked_proposals(p, b), p, b).orderBy("first_order").collect()
    key = hashlib.sha256("b|y,x|rule|ch".encode()).hexdigest()[:16]
    assert rows[0].segment_id == f"b-{key}" and rows[0].block_ids == ["x", "y"] and rows[0].raw_text == "raw x\n\nraw y"
    assert (rows[0].audience, rows[0].review_reasons, rows[0].review_status) == ("gm", ["audience_downgrade_candidate"], "required")
    assert (rows[1].content_type, rows[1].review_reasons, rows[1].audience) == ("unknown", ["short", "unreferenced_block"], "gm")


def test_audience_lattice(spark):
    for values, want in [(["player", "gm"], "gm"), (["player", "unknown"], "unknown"), (["player", "player"], "player"), (["player", "shared"], "shared")]:
        df = spark.createDataFrame([(v,) for v in values], "a string")
        assert df.agg(seg.inherited_audience(F.col("a"))).first()[0] == want
        assert df.agg(F.collect_list("a").alias("a")).select(seg.fold_audience(F.col("a"))).first()[0] == want


def test_windows_take_neighbours_of_adjacent_pages_only(spark):
    b = blocks(spark, "a", "b", page=1).unionByName(blocks(spark, "c", page=2)).unionByName(blocks(spark, "d", page=4))
    rows = {r.page: (r.allowed_block_ids, r.context_block_ids) for r in seg.windows(b).collect()}
    assert rows == {1: (["a", "b"], ["a", "b", "c"]), 2: (["c"], ["b", "c"]), 4: (["d"], ["d"])}


def test_neighbours_across_pages(spark):
    rows = [("b", 1, 1, "a"), ("b", 1, 2, "b"), ("b", 3, 1, "c"), ("c", 1, 1, "d"), ("b", 4, 1, None)]
    df = spark.createDataFrame(rows, "g string, page int, n int, t string")
    got = {(r.g, r.page, r.n): (r.before, r.after) for r in seg.neighbours(df, "g", "page", ["n"], "t").collect()}
    assert got == {("b", 1, 1): ("", "b"), ("b", 1, 2): ("a", "c"), ("b", 3, 1): ("b", ""), ("b", 4, 1): ("c", ""), ("c", 1, 1): ("", "")}
