from pyspark.sql import functions as F

from pagewright.operators import review, views

SEG = "book_id string, segment_id string, raw_text string, normalized_text string, source_spans array<struct<page: int, rect_id: string, start: int, end: int>>, processing map<string,string>, review_status string, audience string, page int, rect_id string, first_start int, section_path array<string>, content_type string, entities array<string>"


def segments(spark, *rows):
    base = dict(book_id="b", raw_text="raw", normalized_text="norm", source_spans=[(1, "r", 0, 3)], processing={}, review_status="required", audience="player", page=1, rect_id="r", first_start=0, section_path=["ch", "s"], content_type="rule", entities=["x", "y"])
    names = [c.split()[0] for c in SEG.split(", ") if " " in c and not c.startswith(("rect_id: ", "start: ", "end: "))]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], SEG)


def decisions(spark, *rows):
    return spark.createDataFrame(rows, "review_id string, segment_id string, status string, input_hash string, processing_version string, decided_at int")


def test_last_decision_wins_and_stale_ones_return(spark):
    s = segments(spark, *[{"segment_id": n} for n in ("s1", "s2", "s3", "s4", "s5")], {"segment_id": "s6", "processing": {"input_sha256": "given", "review_reasons": "a, b"}})
    h = {r.segment_id: r.h for r in s.select("segment_id", review.input_hash().alias("h")).collect()}
    assert h["s6"] == "given" and h["s1"].startswith("sha256:")
    d = decisions(spark, ("b:s1", "s1", "rejected", h["s1"], "v", 1), ("b:s1", "s1", "approved", h["s1"], "v", 2), ("b:s2", "s2", "approved", "old", "v", 1), ("b:s3", "other", "approved", h["s3"], "v", 1), ("s4", "s4", "rejected", h["s4"], "v", 1), ("b:s6", "s6", "approved", "old", "v", None), (None, "s5", "approved", h["s5"], "v", 1))
    got = {r.segment_id: (r.outcome, r.review_status, r.reasons) for r in review.apply_decisions(s, d).collect()}
    assert got == {
        "s1": ("applied", "approved", []), "s2": ("stale", "required", ["stale_review_decision"]), "s3": ("ignored", "required", []),
        "s4": ("applied", "rejected", []), "s5": ("none", "required", []), "s6": ("stale", "required", ["a", "b", "stale_review_decision"]),
    }


def test_errors_reopen_approved_segments(spark):
    s = segments(spark, {"segment_id": "s1", "review_status": "approved"}).withColumn("reasons", F.array(F.lit("a")))
    e = spark.createDataFrame([("s1", "source_gap"), ("s1", "source_gap"), (None, "x")], "segment_id string, code string")
    r = review.flag_errors(s, e).first()
    assert (r.review_status, r.reasons) == ("required", ["a", "source_gap"])


def test_queue_has_context_and_severity(spark):
    s = segments(spark, {"segment_id": "a", "review_status": "approved", "raw_text": "first"}, {"segment_id": "b", "first_start": 5, "processing": {"review_reasons": " source_gap ,,x"}}, {"segment_id": "c", "page": 3, "raw_text": "third"})
    images = spark.createDataFrame([("b", 1, "p1.png")], "book_id string, page int, image_name string")
    q = {r.segment_id: r for r in review.queue(s, images).collect()}
    assert set(q) == {"b", "c"}
    assert (q["b"].reasons, q["b"].severity, q["b"].image_name, q["b"].context_before, q["b"].context_after) == (["source_gap", "x"], "high", "p1.png", "first", "third")
    assert (q["c"].reasons, q["c"].severity, q["c"].image_name, q["c"].context_after) == (["review_required"], "medium", None, "")
    md = {r.item: r.markdown for r in review.as_markdown(review.queue(s, images)).collect()}
    assert set(md) == {0, 1, 2} and md[0] == "# レビューキュー\n\n件数: 2\n" and md[1].startswith("## 1. b:b\n\n- **review_id**: `b:b`\n") and md[2].startswith("## 2. b:c\n")
    assert "- **危険度 (severity)**: high\n" in md[1] and '```json\n{\n  "review_id": "b:b",\n  "segment_id": "b",\n  "status": "approved",\n' in md[1] and md[1].endswith("```\n")
    assert "### 後文脈 (context_after)\n\n```text\n(なし)\n```\n" in md[2] and "- **ページ (page)**: 1\n- **rect_id**: r\n" in md[1]
    assert spark.range(1).select(review.book_of(F.lit("b:x:y")), review.book_of(F.lit("none"))).first()[:] == ("b", "")


def test_views_hide_what_players_must_not_see(spark):
    s = segments(spark, {"segment_id": "p"}, {"segment_id": "g", "audience": "gm"}, {"segment_id": "u", "audience": None}, {"segment_id": "r", "review_status": "rejected"}, {"segment_id": "e", "entities": [], "section_path": None})
    titles = spark.createDataFrame([("b", "The Book")], "book_id string, title string")
    got = {r.segment_id: r.text for r in views.retrieval(s, titles).collect()}
    assert set(got) == {"p", "e"}
    assert got["p"] == "検索文書: 書籍: The Book\n章節: ch > s\n種別: rule\n本文: norm"
    assert {r.segment_id for r in views.retrieval(s, titles.limit(0), "gm").collect()} == {"p", "g", "u", "e"}
    topics = {r.segment_id: r.text for r in views.topic(s).collect()}
    assert topics["p"].startswith("トピック: x、y\n") and topics["e"].startswith("トピック: \n章節: \n")
