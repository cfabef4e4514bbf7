import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions.jsonindex import JsonIndex, decoded
from pagewright.operators.nested import flatten_batch, flatten_records, flatten_tables


def found(payload):
    return [(kind, parent, child) for _, kind, _, _, parent, child, _ in flatten_batch([payload])]


def region(name, **more):
    return {"rectangle": {"rect_id": name, "x": 1}, "text": "t", **more}


def test_shapes_of_regions():
    assert found(json.dumps({"regions": [region("a"), None, region("b")]})) == [("region", "", "a"), ("region", "", "b")]
    assert found(json.dumps({"data": {"items": [{"regions": region("a")}]}})) == [("region", "", "a")]
    assert found(json.dumps({"regions": {"a": {"rectangle": {"x": 1}}, "b": {"rectangle": [{"x": 2}]}, "c": None}})) == [("region", "", "a"), ("region", "", "b")]
    nested = {"regions": [region("a", regions=[region("b", regions=[region("c")])])]}
    assert sorted(found(json.dumps(nested))) == [("region", "", "a"), ("region", "a", "b"), ("region", "b", "c")]
    assert found(json.dumps({"regions": None})) == found(json.dumps({"regions": []})) == []


def test_shapes_of_spans_and_entities():
    span = {"page": "7", "rect_id": "r1", "start": 3, "end": 9}
    for spans in ([span], span, [[span]]):
        assert found(json.dumps({"provenance": {"source_spans": spans}})) == [("span", "", "7:r1:3")]
    for names in (["x"], "x", [["x"]], [{"name": "x", "score": 0.5}], {"name": "x"}, {"x": 0.5}, ["x", None]):
        assert found(json.dumps({"entities": names})) == [("entity", "", "x")], names


def test_encodings_and_incomplete_payloads():
    whole = json.dumps({"entities": ["ツリー\n\"q\"\\"]})
    want = [("entity", "", 'ツリー\n"q"\\')]
    assert found(whole) == found("﻿" + whole) == found(json.dumps(whole)) == found(" \n" + json.dumps(json.loads(whole), ensure_ascii=False, indent=2)) == want
    for end in range(len(whole)):
        assert found(whole[:end]) == []
    for broken in (None, "", "null", "[", '{"entities": ["x"]} x', '{"entities": ["x",]}', '{"entities" ["x"]}', '{"entities": ["x"}]', "{'entities': ['x']}", '{"entities": [tru], "a": 01}'):
        assert found(broken) == []


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, max_size=5), st.data())
def test_index_accepts_what_json_accepts(docs, data):
    texts = [json.dumps(v, ensure_ascii=data.draw(st.booleans())) for v in docs]
    cut = [t[: data.draw(st.integers(0, len(t)))] for t in texts]
    edited = [t[:i] + data.draw(st.sampled_from('{}[],:"\\ax1')) + t[i:] for t in texts for i in [data.draw(st.integers(0, len(t)))]]
    batch = texts + cut + edited

    def complete(t):
        try:
            json.loads(t.strip("﻿ \t\r\n"), parse_constant=lambda _: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    assert JsonIndex([decoded(t) for t in batch]).ok.tolist() == [complete(t) for t in batch]


def test_rows_keep_their_columns_and_parents(spark):
    rows = [(1, "x", json.dumps({"regions": [region("a", regions=[region("b")])]})), (2, None, None), (1, "x", json.dumps({"regions": [region("a", regions=[region("b")])]}))]
    df = spark.createDataFrame(rows, "id int, child string, payload string")
    out = flatten_records(df).orderBy("id", "child_no").collect()
    assert [(r.id, r.child, r.child_no, r.parent_no, r.parent_key, r.child_key) for r in out] == [(1, "region", 0, None, "", "a")] * 2 + [(1, "region", 1, 0, "a", "b")] * 2
    assert out[0].fields == {"text": "t", "rect_id": "a", "x": "1"}
    assert flatten_records(df.limit(0)).count() == 0


def test_any_number_of_encodings():
    text = json.dumps({"entities": ["x"]})
    for _ in range(6):
        assert found(text) == [("entity", "", "x")]
        text = json.dumps(text)


def test_tables_of_any_shape(spark):
    whole = {"id": 7, "box": {"at": {"x": 1}, "name": None}, "parts": [{"k": "a", "tags": ["p", None, "q"], "sub": [{"z": True}, [{"z": False}]]}, None, {"k": "b", "tags": []}], "path": "kept"}
    rows = [(1, json.dumps(whole), "c"), (2, json.dumps([[{"k": 1}], 5]), "c"), (3, '{"a": [', "c"), (4, None, "c"), (5, "", "c"), (6, json.dumps(json.dumps({"a": 1})), "c"), (7, "3", "c")]
    df = spark.createDataFrame(rows, "id int, payload string, path string")
    got = {(r.id, r.row_no): (r.path, r.parent_no, r.place, r.fields) for r in flatten_tables(df).collect()}
    assert got == {
        (1, 0): ("", None, None, {"id": "7", "box.at.x": "1", "box.name": None, "path": "kept"}),
        (1, 1): ("parts", 0, 0, {"k": "a"}), (1, 2): ("parts.tags", 1, 0, {"value": "p"}), (1, 3): ("parts.tags", 1, 2, {"value": "q"}),
        (1, 4): ("parts.sub", 1, 0, {"z": "true"}), (1, 5): ("parts.sub", 1, 0, {"z": "false"}), (1, 6): ("parts", 0, 2, {"k": "b"}),
        (2, 0): ("", None, 0, {"k": "1"}), (2, 1): ("", None, 1, {"value": "5"}), (6, 0): ("", None, None, {"a": "1"}),
    }
    assert flatten_tables(df.limit(0)).count() == 0 and flatten_tables(df).columns == ["id", "path", "row_no", "parent_no", "place", "fields"]
