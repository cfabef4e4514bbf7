import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import typed


def items(spark, *rows):
    df = spark.createDataFrame([(t, i, "img", json.dumps(m)) for i, (t, m) in enumerate(rows)], "type_name string, at int, source string, item string")
    return df.withColumn("item", F.from_json("item", "map<string,string>"))  # keeps the order of keys


def test_fields_in_order_of_appearance_and_lone_dashes(spark):
    i = items(spark, ("skill", {"b": "1", "a": "ー"}), ("skill", {"c": "x ー", "a": "—"}), ("empty", {}))
    f = typed.field_order(i)
    assert [(r.type_name, r.fields) for r in f.collect()] == [("skill", ["b", "a", "c"])]
    rows = typed.tsv_rows(i, f).orderBy("at").collect()
    assert [r.line for r in rows] == ["1\t-\t", "\t-\tx ー"]
    assert typed.tsv_blocks(typed.tsv_rows(i, f), f).first().block == "## skill\nb\ta\tc\n1\t-\t\n\t-\tx ー"


def test_routing(spark):
    schema = spark.createDataFrame([("skill", ["a", "z"])], "type_name string, fields array<string>")
    got = sorted((r.file, r.line) for r in typed.route(items(spark, ("skill", {"b": "1", "a": "2"}), ("odd/name", {"q": "3"})), schema).collect())
    assert got == [("none_odd_name.tsv", "3\timg"), ("skill.tsv", "2\t\timg")]


def test_file_names(spark):
    for name, want in [("a/b:c", "a_b_c"), (" .x. ", "x"), ("", "_"), ("...", "_"), ("あ" * 80, "あ" * 66), ("x" * 250, "x" * 200)]:
        assert spark.createDataFrame([(name,)], "n string").select(typed.file_name(F.col("n"))).first()[0] == want


def test_schemas_are_checked():
    ok = [{"type_name": "技能", "fields": ["a", "b"]}]
    assert typed.checked_schema(ok) == ok
    for name in ("", " ", "a..b", "a\\b", "a\x01", "/a", ".a", "a.", "a ", "あ" * 67, "x.docai", "none_x"):
        with pytest.raises(ValueError):
            typed.checked_schema([{"type_name": name, "fields": ["a"]}])
    for fields in ([], [""], ["a", "a"], ["source"], ["a\n"], [3]):
        with pytest.raises(ValueError):
            typed.checked_schema([{"type_name": "t", "fields": fields}])
    with pytest.raises(ValueError):
        typed.checked_schema([{"type_name": "t", "fields": ["a"]}] * 2)
    with pytest.raises(ValueError):
        typed.checked_schema([])


def test_outcomes_in_order(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (2, 1), (1, 1)], "a int, b int")
    o = df.select(typed.outcome([("missing", F.col("a").isNull()), ("schema_mismatch", F.col("a") != 1), ("source_mismatch", F.col("b") != 1)]).alias("outcome"))
    assert [r[0] for r in o.collect()] == ["missing", "source_mismatch", "schema_mismatch", "hit"]
    assert {(r.outcome, r.n, r.place) for r in typed.outcome_counts(o).collect()} == {("hit", 1, 1), ("missing", 1, 2), ("schema_mismatch", 1, 5), ("source_mismatch", 1, 11)}


def test_collisions_and_trees(spark):
    df = spark.createDataFrame([("a", "a.png"), ("a", "a.jpg"), ("a", "a.jpg"), ("b", "b.png")], "stem string, name string")
    assert [(r.stem, r.members) for r in typed.collisions(df, "stem", "name").collect()] == [("a", ["a.jpg", "a.png"])]
    tree = spark.createDataFrame([("r", ["r"]), ("b", ["r", "b"]), ("a", ["r", "a"]), ("x", ["r", "a", "x"])], "id string, path array<string>")
    assert [(r.id, r.depth) for r in typed.flatten_tree(tree).orderBy("place").collect()] == [("r", 0), ("a", 1), ("x", 2), ("b", 1)]


def test_results_are_checked():
    item = {"a": "1"}
    assert typed.result_problem({"types": [{"type_name": "t", "items": [item]}]}) is None
    for bad, why in [([], "result: not an object"), ({}, "types: not a list"), ({"types": [3]}, "types[0].type_name: not a string"), ({"types": [{"type_name": "t"}]}, "types[0].items: not a list"), ({"types": [{"type_name": "t", "items": [{"a": 1}]}]}, "types[0].items[0]: not an object of strings")]:
        assert typed.result_problem(bad) == why
    schema = [{"type_name": "t", "fields": ["a"]}]
    whole = {"matched_types": [{"type_name": "t", "items": [item]}], "unmatched_types": [{"type_name": "u", "items": [{"z": "1"}]}]}
    assert typed.result_problem(whole, schema) is None
    assert typed.result_problem(whole | {"matched_types": [{"type_name": "u", "items": []}]}, schema) == "matched_types[0].type_name: not declared"
    assert typed.result_problem(whole | {"matched_types": [{"type_name": "t", "items": [{"b": "1"}]}]}, schema) == "matched_types[0].items[0]: other fields than declared"
    assert typed.result_schema(schema)["properties"]["matched_types"]["items"]["anyOf"][0]["properties"]["type_name"] == {"const": "t"}
    assert typed.result_schema()["required"] == ["types"]
    assert typed.fingerprint({"b": 1, "a": 2}) == typed.fingerprint({"a": 2, "b": 1}) != typed.fingerprint({"a": 2})
