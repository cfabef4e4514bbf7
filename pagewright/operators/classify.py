"""The plug-in boundary: windows go to a classifier, proposals come back, checked, remembered and isolated page by page."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPOSAL = "seq int, block_ids array<string>, content_type string, section_path array<string>, audience string, entities array<string>, review_reasons array<string>"
RESULT = f"book_id string, page int, cache_key string, proposals array<struct<{', '.join(p.replace(' ', ': ', 1) for p in PROPOSAL.split(', '))}>>, error string"
#: Attempts at a call the service refuses for its rate, and the seconds before the second one; each wait doubles.
ATTEMPTS, FIRST_WAIT = 5, 30.0


class Classifier(Protocol):
    """What stands behind the boundary. ``classify`` gets the window: page, allowed_block_ids, blocks (id -> text)."""

    classifier_id: str

    def classify(self, window: dict[str, Any]) -> list[dict[str, Any]]: ...


class OneSegmentPerPage:
    """The deterministic default: all blocks of the page in one segment."""

    classifier_id = "default-v1"

    def classify(self, window: dict[str, Any]) -> list[dict[str, Any]]:
        return [{"block_ids": list(window["allowed_block_ids"]), "content_type": "rule.explanation", "section_path": [], "audience": window["inherited_audience"], "entities": [], "review_reasons": []}]


class RateLimited(Exception):
    """The service refuses for now; worth another attempt."""


def with_retries(call: Callable[[], Any], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The result of ``call``; refusals for rate are waited out, any other error is raised at once."""
    for n in range(attempts):
        try:
            return call()
        except RateLimited:
            if n == attempts - 1:
                raise
            sleep(first_wait * 2**n)


def decoded_answer(call: Callable[[], str], attempts: int = 2, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The JSON a call gives; one that can't be read is asked for again, ``attempts`` times in all."""
    for n in range(attempts):
        try:
            return json.loads(call())
        except ValueError:
            if n == attempts - 1:
                raise
            sleep(wait)


def is_rate_limit(code: Column) -> Column:
    """Whether an error's code says that the service refuses for its rate."""
    return F.coalesce(code == 429, F.lit(False))


def missing_entities(entities: Column, text: Column) -> Column:
    """Entities that don't stand verbatim in a text."""
    return F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: e.isNotNull() & ~F.contains(F.coalesce(text, F.lit("")), e))


def problem(window: dict[str, Any], proposals: list[dict[str, Any]]) -> str | None:
    """Why a whole answer is refused: blocks not of the page, named twice or out of order, entities that stand in none of their texts."""
    allowed = {b: i for i, b in enumerate(window["allowed_block_ids"])}
    for p in proposals:
        ids = p.get("block_ids") or []
        if not ids or any(b not in allowed for b in ids):
            return "unknown block"
        places = [allowed[b] for b in ids]
        if len(set(ids)) < len(ids):
            return "block named twice"
        if places != sorted(places):
            return "blocks out of order"
        for e in p.get("entities") or []:
            if not any(e in window["blocks"][b] for b in ids):
                return "entity not in the text"
    return None


def guarded(window: dict[str, Any], proposal: dict[str, Any]) -> dict[str, Any]:
    """A proposal that would open gm text to players is put back to gm and marked."""
    if window["inherited_audience"] == "gm" and proposal.get("audience") in ("player", "shared"):
        reasons = list(proposal.get("review_reasons") or [])
        mark = "audience_downgrade_candidate"
        return proposal | {"audience": "gm", "review_reasons": reasons + [mark] * (mark not in reasons)}
    return proposal


def with_texts(windows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Windows with the raw text of their own blocks and the audience of their page: what a classifier gets."""
    own = blocks.select("book_id", "page", "block_id", "raw_text", "inherited_audience")
    texts = own.groupBy("book_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("block_id", "raw_text"))).alias("blocks"), F.first("inherited_audience").alias("inherited_audience"))
    return windows.join(texts, ["book_id", "page"])


def classify(windows: DataFrame, make: Callable[[], Classifier] = OneSegmentPerPage) -> DataFrame:
    """One answer per window: proposals, or the error that kept them; a failing page leaves the others alone.

    windows: book_id, page, cache_key, allowed_block_ids, blocks, inherited_audience. ``make`` builds the
    classifier once per task, where clients and credentials belong.
    """
    names = [c.split()[0] for c in PROPOSAL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = make()
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                window = row | {"allowed_block_ids": list(row["allowed_block_ids"]), "blocks": dict(row["blocks"])}
                proposals, error = None, None
                try:
                    proposals = with_retries(lambda w=window: classifier.classify(w))
                    error = problem(window, proposals)
                except Exception as e:  # whatever a plug-in raises stays with its page
                    error = f"{type(e).__name__}: {e}"
                rows = None if error else [{n: ({"seq": i} | guarded(window, p)).get(n) for n in names} for i, p in enumerate(proposals, 1)]
                out.append((row["book_id"], row["page"], row["cache_key"], rows, error))
            yield pd.DataFrame(out, columns=["book_id", "page", "cache_key", "proposals", "error"])

    wanted = windows.select("book_id", "page", "cache_key", "allowed_block_ids", "blocks", "inherited_audience")
    return wanted.mapInPandas(run, RESULT)


def classify_or_reuse(windows: DataFrame, cache: DataFrame | None, make: Callable[[], Classifier] = OneSegmentPerPage, fresh: bool = False) -> DataFrame:
    """Answers for all windows, with ``reused``; only windows whose key the cache lacks go to the classifier.

    cache has the columns of an answer; rows with an error don't count. ``fresh`` asks again for all.
    """
    if cache is None or fresh:
        return classify(windows, make).withColumn("reused", F.lit(False))
    good = cache.where("error is null and proposals is not null").dropDuplicates(["cache_key"]).select("cache_key", "proposals")
    hits = windows.select("book_id", "page", "cache_key").join(good, "cache_key").select("book_id", "page", "cache_key", "proposals", F.lit(None).cast("string").alias("error"), F.lit(True).alias("reused"))
    rest = classify(windows.join(good.select("cache_key"), "cache_key", "left_anti"), make)
    return hits.unionByName(rest.withColumn("reused", F.lit(False)))


def proposals_of(answers: DataFrame) -> DataFrame:
    """Answers as rows for ``segments.checked_proposals``."""
    rows = answers.where("proposals is not null").select("book_id", "page", F.explode("proposals").alias("p"))
    return rows.select("book_id", "page", "p.seq", F.format_string("%s:%d:%d", "book_id", "page", "p.seq").alias("segment_id"), "p.block_ids", "p.content_type", "p.section_path", "p.audience")


def failures(answers: DataFrame) -> DataFrame:
    """The answers that failed, for a folder of failures."""
    return answers.where("error is not null").select("book_id", "page", "cache_key", "error")


def fallback_outline(blocks: DataFrame) -> DataFrame:
    """Per book one section of unknown content over all its pages, for when no outline could be made."""
    return blocks.groupBy("book_id").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page")).withColumns({"title": F.lit("unknown"), "default_content_type": F.lit("unknown"), "confidence": F.lit("low")})


def outline_samples(blocks: DataFrame, line: int = 60, text: int = 120) -> DataFrame:
    """What an outline is inferred from: the start of each block's first line and of its text."""
    return blocks.select("block_id", "page", F.substring(F.split("raw_text", "\n")[0], 1, line).alias("first_line"), F.substring("raw_text", 1, text).alias("sample"))


def outline_problem(outline: dict[str, Any], book_id: str) -> str | None:
    """Why an outline is refused: another book, a section without title, or one that ends before it starts."""
    if outline.get("book_id") != book_id:
        return "another book"
    for s in outline.get("sections") or []:
        if not str(s.get("title") or "").strip():
            return "section without title"
        if not 1 <= s.get("start_page", 0) <= s.get("end_page", 0):
            return "section ends before it starts"
    return None
