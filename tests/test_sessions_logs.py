from pyspark.sql import functions as F

from pagewright.operators import handoff, perf, sessions

REGION = "page int, rect_id string, draw_order int, x int, text string, ocr_status string, ocr_error string, ocr_completed_at int"


def regions(spark, *rows):
    return spark.createDataFrame([(1, r, i, x, t, s, None, None) for i, (r, x, t, s) in enumerate(rows)], REGION)


def test_merge_keeps_what_is_done_and_the_new_geometry(spark):
    new = regions(spark, ("a", 5, None, "pending"), ("b", 6, "new", "done"), ("c", 7, None, "pending"))
    old = regions(spark, ("a", 1, "read", "done"), ("b", 1, "bad", "error"), ("gone", 1, "x", "done"))
    got = {r.rect_id: (r.x, r.text, r.ocr_status, r.kept) for r in sessions.merge_regions(new, old, ["page", "rect_id"]).collect()}
    assert got == {"a": (5, "read", "done", True), "b": (6, "new", "done", False), "c": (7, None, "pending", False)}


def test_upsert_and_validity(spark):
    old, new = regions(spark, ("a", 1, "x", "done"), ("b", 1, "y", "done")), regions(spark, ("b", 9, "z", "done"), ("c", 2, "w", "done"))
    got = {r.rect_id: (r.x, r.draw_order) for r in sessions.upsert(old, new, ["page", "rect_id"]).collect()}
    assert got == {"a": (1, 0), "b": (9, 1), "c": (2, 1)}
    assert [r.rect_id for r in sessions.still_valid(regions(spark, ("a", 1, "n", "done"), ("b", 2, "n", "done"), ("q", 1, "n", "done")), old, ["page", "rect_id"], ["x"]).collect()] == ["a"]


def test_work_list_and_markdown(spark):
    r = regions(spark, ("b", 1, "two", "done"), ("a", 1, None, "done"), ("c", 1, None, "error"), ("d", 1, None, "pending"))
    assert {x.rect_id for x in sessions.work_list(r).collect()} == {"c", "d"} and {x.rect_id for x in sessions.work_list(r, False).collect()} == {"d"}
    assert sessions.markdown(r, ["page"]).first().markdown == "two\n\n---\n\n"
    assert sessions.next_order(r, ["page"]).first().next_order == 4


def test_timings(spark):
    rows = [("ocr", "f", 1.5, "step", "success", 1), ("ocr", "f", 3.0, "step", "error", 2), ("wait", "f", 30.0, "wait", "success", 3), ("parse", "g", 1.0, "step", "success", 4)]
    e = spark.createDataFrame(rows, "step_name string, file_key string, elapsed double, kind string, outcome string, seq int")
    step = {r.step_name: r for r in perf.by_step(e).collect()}
    assert (step["ocr"].real_total, step["ocr"].success_total, step["ocr"].attempts, step["ocr"].failures) == (4.5, 1.5, 2, 1)
    file = {r.file_key: r for r in perf.by_file(e).collect()}
    assert (file["f"].real_total, file["f"].success_total, file["f"].waited, file["f"].last_failure) == (34.5, 1.5, 30.0, "ocr")
    assert (file["g"].last_failure, perf.waits(e).first().n) == (None, 1)
    assert [r[0] for r in spark.range(6).select(perf.backoff_seconds(F.col("id"))).collect()] == [30, 60, 120, 240, None, None]


def test_log_texts(spark):
    df = spark.createDataFrame([("API_TOKEN = abc x", "a" * 13000, "é /x|y"), ("my_secret='q r' z", "short", "---"), ("no = secret", None, "2031-04-02T10:11:12Z")], "a string, b string, c string")
    rows = df.select(handoff.redact(F.col("a")).alias("a"), handoff.truncate(F.col("b")).alias("b"), handoff.slug(F.col("c")).alias("s"), handoff.stamp(F.col("c")).alias("t"), handoff.escape_cell(F.col("c")).alias("e")).collect()
    assert [r.a for r in rows] == ["API_TOKEN =[REDACTED] x", "my_secret=[REDACTED] z", "no = secret"]
    assert len(rows[0].b) > 12000 and rows[0].b.endswith("a" * 12000) and [r.b for r in rows[1:]] == ["short", None]
    assert [r.s for r in rows] == ["x-y", "session", "2031-04-02T10-11-12Z"] and rows[2].t == "20310402101112" and rows[0].e.endswith("x\\|y")
    assert spark.range(1).select(handoff.bullets(F.array(F.lit("a"), F.lit(""), F.lit("b")))).first()[0] == "- a\n- b"


def test_log_folds(spark):
    rows = [("s", "title", "one", 1), ("s", "title", "two", 3), ("s", "title", None, 4), ("s", "name", "n", 2), ("t", "other", "q", 1)]
    r = spark.createDataFrame(rows, "session string, type string, value string, line_no int")
    got = {x.session: (x.t, x.n) for x in handoff.last_values(r, "session", ["line_no"], {"title": "t", "name": "n"}).collect()}
    assert got == {"s": ("two", "n"), "t": (None, None)}
    assert {x.session: x["values"] for x in handoff.first_seen(r, "session", "value", ["line_no"]).collect()} == {"s": ["one", "n", "two"], "t": ["q"]}
    texts = spark.createDataFrame([("s", i, f"Phase {i}") for i in range(8)] + [("s", 99, "chat"), ("t", 1, "完了報告 TOKEN=1")], "session string, line_no int, text string")
    assert {x.session: x.reports for x in handoff.last_reports(texts, "session", ["line_no"]).collect()} == {"s": [f"Phase {i}" for i in range(3, 8)], "t": ["完了報告 TOKEN=[REDACTED]"]}
    tasks = spark.createDataFrame([("s", "1", "a", "open"), ("s", "2", "b", "open"), ("s", "3", "", "open")], "session string, task_id string, subject string, status string")
    updates = spark.createDataFrame([("s", "1", "done", 1), ("s", "1", "open", 0), ("s", "9", "done", 1)], "session string, task_id string, status string, line_no int")
    now = handoff.task_states(tasks, updates, "session", ["line_no"])
    assert {x.task_id: x.status for x in now.collect()} == {"1": "done", "2": "open", "3": "open"}
    assert handoff.next_work(now, "session").first().next_work == ["b"]


def test_all_saves_of_a_page_are_folded(spark):
    rows = [
        (1, 1, "a", 1, "first", "done"), (1, 1, "b", 1, None, "pending"), (1, 1, "c", 1, "old", "done"),
        (1, 2, "a", 2, None, "pending"), (1, 2, "b", 2, "middle", "done"),
        (1, 3, "a", 3, "late", "done"), (1, 3, "b", 3, None, "error"), (1, 3, "c", 3, None, "pending"), (1, 3, "d", 3, "new", "done"),
        (2, 9, "a", 7, "only", "done"),
    ]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "page int, at int, rect_id string, x int, text string, ocr_status string, ocr_error string, ocr_completed_at int")
    got = {(r.page, r.rect_id): (r.x, r.text, r.ocr_status, r.kept) for r in sessions.fold_saves(df, ["page"], "rect_id", ["at"]).collect()}
    assert got == {
        (1, "a"): (3, "first", "done", True), (1, "b"): (3, "middle", "done", True), (1, "c"): (3, None, "pending", False),  # c was missing in between
        (1, "d"): (3, "new", "done", False), (2, "a"): (7, "only", "done", False),
    }


def test_secrets_in_quotes_and_bare(spark):
    text = "export MY_TOKEN = \"a \\\" b\" x; api_key='q r' y API_KEYS=abc`d tokens: no PASSWORD=\nz"
    got = spark.createDataFrame([(text,)], "t string").select(handoff.redact(F.col("t"))).first()[0]
    assert got == "export MY_TOKEN =[REDACTED] x; api_key=[REDACTED] y API_KEYS=[REDACTED]`d tokens: no PASSWORD=[REDACTED]"
