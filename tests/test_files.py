import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import pages
from pagewright.sources import readers, sinks
from pagewright.streaming import batches


def session(*orders):
    return {"image_name": "p.png", "image_width": 100, "image_height": 100, "regions": [{"rectangle": {"rect_id": f"r{o}", "draw_order": o, "x": 1, "y": 2, "width": 3, "height": 4}, "text": "t", "ocr_status": "done"} for o in orders], "schema_version": 1}


def test_page_sessions(spark, tmp_path):
    for n, orders in ((22, (1, 0)), (23, (0,))):
        (tmp_path / f"p{n:03}.regions.json").write_text(json.dumps(session(*orders), indent=1))
    (tmp_path / "other.txt").write_text("x")
    rows = readers.page_sessions(spark, str(tmp_path), "p*.regions.json", r"p(?P<page>[0-9]{3})\.regions\.json$", "b").orderBy("page").collect()
    assert [(r.page, [x.rectangle.rect_id for x in r.regions], len(r.source_sha256)) for r in rows] == [(22, ["r0", "r1"], 64), (23, ["r0"], 64)]
    (tmp_path / "q022.regions.json").write_text(json.dumps(session(0)))
    with pytest.raises(Exception, match="several files"):
        readers.page_sessions(spark, str(tmp_path), "*.regions.json", r"(?P<page>[0-9]{3})", "b").collect()
    with pytest.raises(Exception, match="no page number"):
        readers.page_sessions(spark, str(tmp_path), "p*.json", r"x(?P<page>[0-9]{3})", "b").collect()


def test_unfinished_regions_are_refused(spark):
    kind = "page int, rect_id string, ocr_status string, text string, x int, y int, width int, height int, image_width int, image_height int"
    good = (1, "r", "done", "t", 0, 0, 5, 5, 10, 10)
    assert pages.refuse_unfinished(spark.createDataFrame([good], kind)).count() == 1
    for at, bad in ((2, "pending"), (3, None), (4, 9)):
        row = [*good]
        row[at] = bad
        with pytest.raises(Exception, match="page 1, r"):
            pages.refuse_unfinished(spark.createDataFrame([tuple(row)], kind)).collect()


def test_page_ranges(spark):
    books = spark.createDataFrame([("b", 1, [(1, 9, "gm"), (5, 6, "player")], [(1, 9, "scenario"), (5, 6, "replay")], "shared", "rulebook"), ("b", None, [(1, 9, "gm"), (5, 6, "player")], [(1, 9, "scenario"), (5, 6, "replay")], "shared", "rulebook"), ("c", 1, None, [], None, None)], "book_id string, schema_version int, audience_overrides array<struct<start_page: int, end_page: int, audience: string>>, document_type_overrides array<struct<start_page: int, end_page: int, document_type: string>>, default_audience string, default_document_type string")
    p = spark.createDataFrame([("b", 5), ("b", 9), ("b", 10), ("c", 1), ("d", 1), ("b", None)], "book_id string, page int")
    got = {(r.book_id, r.page): (r.inherited_audience, r.document_type) for r in pages.page_attributes(p, books).collect()}
    assert got == {("b", 5): ("player", "scenario"), ("b", 9): ("gm", "scenario"), ("b", 10): ("shared", "rulebook"), ("c", 1): ("unknown", "unknown"), ("d", 1): ("unknown", "unknown"), ("b", None): ("shared", "rulebook")}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"review_id": "b:s", "status": "approved"}\n\nnot json\n[1]\n{"review_id": "b:t"}\n{"broken": \n')
    got = readers.tolerant_lines(spark, str(tmp_path / "a.jsonl"), readers.DECISION).orderBy("line_no").collect()
    assert [(r.line_no, r.record.review_id) for r in got] == [(0, "b:s"), (4, "b:t")]
    with pytest.raises(Exception):
        readers.json_records(spark, str(tmp_path / "a.jsonl"), readers.DECISION).collect()
    df = spark.createDataFrame([("x", None, 1), ("日本", "y", None)], "a string, b string, c int")
    sinks.write_json_lines(df, str(tmp_path / "out"))
    lines = sorted(line for p in (tmp_path / "out").glob("*.txt") for line in p.read_text().splitlines())
    assert lines == ['{"a":"x","b":null,"c":1}', '{"a":"日本","b":"y","c":null}']
    assert readers.json_records(spark, str(tmp_path / "out"), df.schema).count() == 2


def test_tsv_blocks_and_proposed_schema(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("## skill\nname\tlevel\nx\t1\ny\t2\n\n## empty\n\nnoise\n\n## item\nname\n")
    (tmp_path / "b.tsv").write_text("## skill\nlevel\trange\nz\t3\n")
    blocks = readers.tsv_blocks(spark, str(tmp_path))
    assert sorted((r.source, r.type_name, r.fields, r.rows) for r in blocks.collect()) == [("a.tsv", "item", ["name"], []), ("a.tsv", "skill", ["name", "level"], [["x", "1"], ["y", "2"]]), ("b.tsv", "skill", ["level", "range"], [["z", "3"]])]
    got = {r.type_name: (r.fields, r.source) for r in readers.proposed_schema(blocks).collect()}
    assert got == {"skill": (["name", "level", "range"], "a.tsv"), "item": (["name"], "a.tsv")}


def test_listing_and_names(spark, tmp_path):
    for n in ("b.PNG", "a.jpg", "a.png", "notes.txt"):
        (tmp_path / n).write_text("x")
    assert [(r.name, r.stem) for r in readers.images(spark, str(tmp_path)).collect()] == [("a.jpg", "a"), ("a.png", "a"), ("b.PNG", "b")]
    assert readers.safe_name("a/b.png") == "a/b.png"
    for n in ("/etc/x", "../x", "a/../../x", ""):
        with pytest.raises(ValueError):
            readers.safe_name(n)
    chunks = readers.request_chunks(spark.createDataFrame([(1,), (15,), (16,)], "page int"), "page")
    assert [r.chunk for r in chunks.orderBy("page").collect()] == [0, 0, 1]
    logs = spark.createDataFrame([("a", 1, "2"), ("a", 2, "1"), ("a", 3, None), ("b", 1, "5")], "path string, line_no int, ts string")
    assert [(r.path, r.timestamp) for r in readers.session_times(logs, "path", "line_no", "ts").collect()] == [("b", "5"), ("a", "1")]


def test_publishing_several_outputs(spark, tmp_path):
    put = lambda text: lambda path: open(path, "w").write(text)
    root = tmp_path / "out"
    names = lambda: sorted(p.name for p in root.iterdir() if not p.name.startswith("."))
    assert sinks.publish(spark, str(root), {"a.tsv": put("1"), "b.tsv": put("2")}) == []

    def fail(path):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.publish(spark, str(root), {"a.tsv": put("9"), "c.tsv": fail})
    assert names() == ["a.tsv", "b.tsv", "manifest.json"] and (root / "a.tsv").read_text() == "1"
    with pytest.raises(OSError):
        sinks.publish(spark, str(root), {"a.tsv": put("9"), "c.tsv": lambda path: None})  # writes nothing
    assert names() == ["a.tsv", "b.tsv", "manifest.json"] and (root / "a.tsv").read_text() == "1"
    assert sinks.publish(spark, str(root), {"a.tsv": put("3")}) == ["b.tsv"]
    assert names() == ["a.tsv", "manifest.json"] and (root / "a.tsv").read_text() == "3"
    assert sinks.managed('{"files": ["../x"]}') == sinks.managed(None) == sinks.managed("[") == [] and sinks.managed('{"files": ["x"]}') == ["x"]


def test_stream_drops_results_of_changed_regions(spark, tmp_path):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "rect_id string, x int")
    results = spark.createDataFrame([("a", 1, "read"), ("b", 9, "moved"), ("c", 1, "gone")], "rect_id string, x int, text string")
    results.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        batches.merge_results(batches.table_stream(spark, str(tmp_path / "in"), results.schema, 100), now, ["rect_id"], ["x"], str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["read"]


def test_logs_are_selected_by_name_or_session(spark):
    logs = spark.createDataFrame([("/l/a.jsonl", "1", "s1"), ("/l/a.jsonl", "4", None), ("/l/b.jsonl", "3", "s1"), ("/l/c.jsonl", "9", "s2")], "path string, ts string, session string")
    pick = lambda w: [tuple(r) for r in readers.select_session(logs, "path", "ts", "session", w).collect()]
    assert pick("s1") == [("/l/a.jsonl", "4")] and pick("b") == [("/l/b.jsonl", "3")] and pick("zz") == []
    assert readers.log_folder("/home/x/y") == "-home-x-y"


def test_stored_detections_that_fit(spark, tmp_path):
    (tmp_path / "a.blocks.json").write_text(json.dumps({"image_name": "a.png", "image_width": 5, "image_height": 5, "blocks": [{"x": 1, "y": 1, "width": 1, "height": 1}]}))
    (tmp_path / "b.blocks.json").write_text("{broken")
    (tmp_path / "c.blocks.json").write_text(json.dumps({"image_name": "c.jpg", "blocks": []}))
    wanted = spark.createDataFrame([("a", "a.png"), ("b", "b.png"), ("c", "c.png"), ("d", "d.png")], "stem string, image_name string")
    assert [r.stem for r in readers.cached_blocks(spark, str(tmp_path), wanted).collect()] == ["a"]


def test_recognised_blocks(spark):
    kind = "page_width int, page_height int, text string, blocks array<struct<vertices: array<struct<x: double, y: double>>, segments: array<struct<start: int, end: int>>, confidence: double>>"
    box = [(0.1, 0.1), (0.9, 0.1), (0.999, 0.5), (0.1, 0.5)]
    df = spark.createDataFrame([(100, 200, "hello world", [(box, [(0, 5), (5, 11)], 0.91), (box[:3], [(0, 5)], 0.5)])], kind)
    assert [tuple(r) for r in readers.block_regions(df).collect()] == [(0, 10, 20, 99, 100, 0.91, "hello world")]
    chunks = spark.createDataFrame([("d", 1, "two ACME"), ("d", 0, "one")], "doc string, chunk int, text string")
    assert readers.joined_recognition(chunks, ["doc"], {"ACME": "A◎ME"}).first().text == "one\ntwo A◎ME"
    cards = spark.createDataFrame([("p", 3, 0.12345), ("p", 1, 0.5)], "page string, top int, confidence double")
    assert [(r.file, r.confidence) for r in sinks.card_meta(cards, "page", ["top"]).orderBy("card").collect()] == [("p_001.png", 0.5), ("p_002.png", 0.1234)]
    images_ = spark.createDataFrame([("a",), ("b",)], "image_name string")
    got = readers.sessions_or_empty(images_, spark.createDataFrame([("a", [1])], "image_name string, regions array<int>"))
    assert {r.image_name: r.regions for r in got.collect()} == {"a": [1], "b": []}


def test_texts_of_structured_pages(spark):
    kind = "page int, organizations array<struct<name: string, classification: string, sub_organizations: array<string>, headquarters: string, description: string>>, rules array<struct<depth: int, title: string, body: string>>"
    rows = [(1, [("ー", None, ["a", "b"], "h", "d")], [(0, "t", "b"), (1, "u", "c")]), (2, [], [])]
    got = {r.page: r.tsv for r in sinks.structured_tsv(spark.createDataFrame(rows, kind), ["page"]).collect()}
    assert got == {1: "## 組織\nname\tclassification\tsub_organizations\theadquarters\tdescription\nー\t\ta, b\th\td\n\n## ルール\ndepth\ttitle\tbody\n0\tt\tb\n1\tu\tc\n", 2: ""}
    assert sinks.schema_lines(spark.createDataFrame([("t", ["a", "b"])], "type_name string, fields array<string>")).first().value == "t\ta\tb"
    assert sinks.metric_lines(spark.createDataFrame([(0.5, 2)], "ratio double, n int")).first().value == "ratio=0.5000\nn=2"
    page = spark.createDataFrame([("s", None, [("1", "a|b", "open")], ["r"], ["a|b"])], "session string, title string, tasks array<struct<id: string, subject: string, status: string>>, reports array<string>, next_work array<string>")
    assert "| 1 | a\\|b | open |" in sinks.handoff_markdown(page).first().markdown


def test_outputs_no_manifest_names(spark):
    names = ["a.tsv", "x.docai.tsv", ".stage/b.tsv", "sub/c.tsv", "note.txt"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in df.where(sinks.is_legacy_output(F.col("name"))).collect()] == ["a.tsv", "sub/c.tsv"]


def test_answers_are_asked_for_again():
    from pagewright.operators import classify

    waits = []
    assert classify.decoded_answer(iter(["{", "[1]"]).__next__, sleep=waits.append) == [1] and waits == [1.0]
    with pytest.raises(ValueError):
        classify.decoded_answer(lambda: "{", sleep=waits.append)
