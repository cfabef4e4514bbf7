"""Queries of the problems on text, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import boilerplate, canonical, leakage, ocrnoise, packing, truncation
from pagewright.llm.sql import SQL
from pagewright.runtime import table


def _p2_titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    titles = table(spark, d, "books").select(F.col("book_id").alias("book"), "title")
    spans = table(spark, d, "segments").selectExpr("book_id as book", "section_path[0] as title", "explode(source_spans.page) as page")
    return titles, spans.where("page is not null and title is not null").select("book", "page", "title").distinct()


def _p2_regions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "region_sessions").selectExpr("session_id", "book_id", "cast(nullif(regexp_extract(file_name, '([0-9]+)', 1), '') as int) as page", "explode(regions) as r")
    return s.select("session_id", F.col("r.rectangle.rect_id").alias("rect_id"), "book_id", "page", F.col("r.text").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocrnoise.find_noise(_p2_regions(spark, d), ["session_id", "rect_id"], "book_id", "page", "text", *_p2_titles(spark, d))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every region with text, as continuous paragraphs."""
    return ocrnoise.repair(_p2_regions(spark, d), ["session_id", "rect_id"], "book_id", "page", "text", *_p2_titles(spark, d))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """raw_text (repaired) and normalized_text (repaired_normalized) of every segment, as continuous paragraphs.

    Where the two differ in blanks and line breaks alone, one repair is that of both: it closes the
    breaks anyway, and only raw_text still has the lines of the page, by which titles, page numbers and
    divided words are known.
    """
    bare = "translate({}, ' \t\r\n\u3000', '')".format
    same = f"{bare('normalized_text')} <=> {bare('raw_text')}"
    s = table(spark, d, "segments").selectExpr("segment_id", "book_id", "source_spans.page as page", "raw_text", "normalized_text").distinct()
    both = s.selectExpr("segment_id", "'raw' as field", "book_id", "page", "raw_text as text").unionByName(
        s.where(f"not ({same})").selectExpr("segment_id", "'normalized' as field", "book_id", "page", "normalized_text as text")
    )
    out = ocrnoise.repair(both, ["segment_id", "field"], "book_id", "page", "text", *_p2_titles(spark, d))
    pick = lambda field: F.max(F.when(F.col("field") == field, F.col("repaired")))
    wide = out.groupBy("segment_id").agg(pick("raw").alias("repaired"), pick("normalized").alias("__other"))
    equal = s.groupBy("segment_id").agg(F.expr(f"bool_and({same})").alias("__same"))
    return wide.join(equal, "segment_id").select("segment_id", "repaired", F.expr("if(__same, repaired, __other)").alias("repaired_normalized"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = canonical.same_on_the_page(table(spark, d, "segments"), "segment_id", "raw_text")
    return pairs.toDF("segment_id_1", "segment_id_2")


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every segment with raw_text and normalized_text in their one form."""
    s = table(spark, d, "segments").select("segment_id", "book_id", "raw_text", "normalized_text").distinct()
    return canonical.canonical_column(s, ["raw_text", "normalized_text"])


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of raw_text and normalized_text of every segment: texts that read the same."""
    s = table(spark, d, "segments").select("segment_id", "raw_text", "normalized_text")
    return canonical.classes(s, "segment_id", ["raw_text", "normalized_text"])


def _p6_lines(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "segments"), "segment_id", "book_id", "raw_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.exact(_p6_lines(spark, d)).select("segment_id", "line_no").distinct()


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every segment without the lines of excessive clusters."""
    s = table(spark, d, "segments").select("segment_id", "book_id", "raw_text").distinct()
    return boilerplate.without_lines(s, "segment_id", "raw_text", _p6_lines(spark, d))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in bins of every container kind."""
    counts = packing.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(counts, "doc_id", table(spark, d, "containers"), "container_id", "capacity_tokens")


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused(p7_packed(spark, d), "container_id")


def _p8_pairs(spark: SparkSession, d: str, edited: bool) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "test_items"), "item_id", "text", edited)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8_pairs(spark, d, False).select("doc_id", "item_id").distinct()


def p8_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of a test item, edited copies included, with the alignment's score."""
    return _p8_pairs(spark, d, True)


def p8_short(spark: SparkSession, d: str) -> DataFrame:
    """Test items too short to be searched for."""
    return leakage.unsearched(table(spark, d, "test_items"), "item_id", "text")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return _p8_pairs(spark, d, False).groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("run").alias("longest_run"))


def p9_marked(spark: SparkSession, d: str) -> DataFrame:
    """Every document with text: whether it was cut, why that is assumed, and whether it ends at a field limit."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", "title")
    return truncation.truncated(docs, "doc_id", "source", "text", "title")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_marked(spark, d).where("cut").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(p9_marked(spark, d), "source")


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """The field limits of each source, in text and title."""
    return truncation.length_spikes(table(spark, d, "documents").select("source", "text", "title"), "source", ["text", "title"])


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Per source and reason: cut texts at a length spike, and those only the look of their end tells."""
    return p9_marked(spark, d).where("cut").groupBy("source", "reason").agg(F.count("*").alias("docs"), F.sum(F.col("limited").cast("long")).alias("at_limit"))


QUERIES = {f.__name__: f for f in (p2_found, p2_repaired, p2_segments, p4_found, p4_canonical, p4_classes, p6_found, p6_cleaned, p7_packed, p7_unused, p8_found, p8_alignments, p8_items, p8_short, p9_found, p9_marked, p9_rates, p9_reasons, p9_limits)}
SQL: dict[str, str] = SQL | {
    "p9_limits": """with t as (select source, 'text' as field, text as v from documents union all select source, 'title', title from documents),
 h as (select source, field, 'chars' as unit, cast(length(v) as int) as length, count(*) as n from t where v <> '' group by all
  union all select source, field, 'bytes', cast(strlen(v) as int), count(*) from t where v <> '' group by all),
 s as (select source, field, unit, length, cast(case when unit = 'bytes' then sum(n) over (partition by source, field, unit order by length range between 3 preceding and current row) else n end as bigint) as rows,
  cast(coalesce(sum(n) over (partition by source, field, unit order by length range between 1 following and unbounded following), 0) as bigint) as longer from h)
 select * from s where rows >= 5 and rows >= 0.3 * (rows + longer)""",
}
