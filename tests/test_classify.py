import sys

import pytest
from pyspark import cloudpickle

from pagewright.operators import classify as c

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import this file

WINDOW = "book_id string, page int, cache_key string, allowed_block_ids array<string>, blocks map<string,string>, inherited_audience string"


def windows(spark, *pages, audience="gm"):
    return spark.createDataFrame([("b", p, f"k{p}", ["x", "y"], {"x": "the altar", "y": "the gate"}, audience) for p in pages], WINDOW)


def answer(**more):
    return {"block_ids": ["x"], "content_type": "rule", "section_path": [], "audience": "player", "entities": ["altar"], "review_reasons": []} | more


class Picky:
    classifier_id = "picky"

    def classify(self, window):
        if window["page"] == 2:
            raise RuntimeError("no answer")
        return [answer()] if window["page"] == 1 else [answer(entities=["ghost"])]


def test_pages_fail_alone(spark):
    rows = {r.page: r for r in c.classify(windows(spark, 1, 2, 3), Picky).collect()}
    assert rows[1].error is None and rows[1].proposals[0].audience == "gm" and rows[1].proposals[0].review_reasons == ["audience_downgrade_candidate"]
    assert rows[2].error == "RuntimeError: no answer" and rows[3].error == "entity not in the text" and rows[3].proposals is None
    assert {r.page for r in c.failures(c.classify(windows(spark, 1, 2, 3), Picky)).collect()} == {2, 3}


def test_answers_are_checked():
    w = {"allowed_block_ids": ["x", "y"], "blocks": {"x": "the altar", "y": "the gate"}}
    for p, want in [(answer(), None), (answer(block_ids=["q"]), "unknown block"), (answer(block_ids=[]), "unknown block"), (answer(block_ids=["x", "x"]), "block named twice"), (answer(block_ids=["y", "x"]), "blocks out of order"), (answer(entities=["gate"]), "entity not in the text"), (answer(block_ids=["x", "y"], entities=["gate"]), None)]:
        assert c.problem(w, [p]) == want


def test_known_windows_are_not_asked_again(spark):
    cache = c.classify(windows(spark, 1, 2), Picky)
    rows = {r.page: (r.reused, r.error) for r in c.classify_or_reuse(windows(spark, 1, 2, 4), cache, c.OneSegmentPerPage).collect()}
    assert rows == {1: (True, None), 2: (False, None), 4: (False, None)}
    assert not any(r.reused for r in c.classify_or_reuse(windows(spark, 1), cache, fresh=True).collect())
    p = c.proposals_of(c.classify(windows(spark, 5))).first()
    assert (p.seq, p.block_ids, p.audience) == (1, ["x", "y"], "gm")


def test_retries_wait_for_rate_limits_only():
    waits, calls = [], []

    def refused():
        calls.append(1)
        if len(calls) < 3:
            raise c.RateLimited
        return "ok"

    assert c.with_retries(refused, sleep=waits.append) == "ok" and waits == [30.0, 60.0]
    with pytest.raises(c.RateLimited):
        c.with_retries(lambda: (_ for _ in ()).throw(c.RateLimited), sleep=waits.append)
    assert waits == [30.0, 60.0, 30.0, 60.0, 120.0, 240.0]
    with pytest.raises(KeyError):
        c.with_retries(lambda: {}["x"], sleep=waits.append)
    assert len(waits) == 6


def test_outlines_are_checked(spark):
    good = {"book_id": "b", "sections": [{"title": "t", "start_page": 1, "end_page": 1}]}
    assert c.outline_problem(good, "b") is None and c.outline_problem(good, "c") == "another book"
    assert c.outline_problem({"book_id": "b", "sections": [{"title": " "}]}, "b") == "section without title"
    assert c.outline_problem({"book_id": "b", "sections": [{"title": "t", "start_page": 3, "end_page": 2}]}, "b") == "section ends before it starts"
    blocks = spark.createDataFrame([("b", 3, "x", "first\nsecond"), ("b", 7, "y", "z" * 300)], "book_id string, page int, block_id string, raw_text string")
    r = c.fallback_outline(blocks).first()
    assert (r.start_page, r.end_page, r.title) == (3, 7, "unknown")
    assert {x.block_id: (x.first_line, len(x["sample"])) for x in c.outline_samples(blocks).collect()} == {"x": ("first", 12), "y": ("z" * 60, 120)}
