"""Physical lines of a text and the line breaks that may be joined without loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What starts a list row, what ends a sentence, spacing of a table, longest line that stays alone.
LIST_STARTS = "■●▼◆◇・"
SENTENCE_ENDS = "。！？!?：:"
TABLE_SPACING = r"[ 　]{2,}"
SHORT_LINE = 4
JOIN_RULE = "ja-word-wrap-v1"
_BREAK = r"\r\n|\r|\n"
#: Lines whose offsets are added up in one go.
PART_LINES = 256


def physical_lines(text: Column) -> Column:
    """array<struct<text, start, end, line_break>>: lines with half-open character offsets; no empty line after a final break."""
    parts = F.split(text, _BREAK, -1)
    breaks = F.regexp_extract_all(text, F.lit(f"({_BREAK})"), F.lit(1))
    pairs = F.zip_with(parts, breaks, lambda t, b: F.struct(t.alias("text"), F.coalesce(b, F.lit("")).alias("line_break")))
    pairs = F.filter(pairs, lambda p: (p["text"] != "") | (p["line_break"] != ""))
    size = lambda p: F.length(p["text"]) + F.length(p["line_break"])
    kind = "array<struct<text:string,start:int,end:int,line_break:string>>"

    def placed(part: Column, start: Column) -> Column:
        """The lines of a part that begins at ``start``: each step copies what is done, so parts are short."""

        def step(done: Column, p: Column) -> Column:
            end = done["at"] + F.length(p["text"])
            line = F.struct(p["text"].alias("text"), done["at"].alias("start"), end.alias("end"), p["line_break"].alias("line_break"))
            return F.struct((done["at"] + size(p)).alias("at"), F.concat(done["lines"], F.array(line)).alias("lines"))

        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast(kind).alias("lines")), step, lambda done: done["lines"])

    def of_parts(cut: Column) -> Column:
        chars = lambda part: F.aggregate(part, F.lit(0), lambda n, p: n + size(p))
        starts = F.aggregate(cut, F.array(F.lit(0)), lambda at, part: F.concat(at, F.array(F.element_at(at, -1) + chars(part))))
        return _bound(starts, lambda at: F.flatten(F.transform(cut, lambda part, i: placed(part, F.get(at, i)))))

    numbers = lambda p: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(p) / PART_LINES).cast("int") - 1, F.lit(0)))
    return _bound(pairs, lambda p: _bound(F.transform(numbers(p), lambda k: F.slice(p, k * PART_LINES + 1, F.lit(PART_LINES))), of_parts))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def join_decision(left: Column, right: Column) -> Column:
    """struct<should_join, rule_id, review_reason> for two neighbouring lines of one region."""
    listed = left.rlike(f"^[{LIST_STARTS}]") | right.rlike(f"^[{LIST_STARTS}]")
    table = left.rlike(TABLE_SPACING) | right.rlike(TABLE_SPACING)
    complete = (left == "") | (right == "") | left.rlike(f"[{SENTENCE_ENDS}]$")
    short = F.least(F.length(left), F.length(right)) <= SHORT_LINE
    reason = F.when(listed, "bullet_list_structure").when(table, "table_like_spacing").when(~complete & short, "short_independent_line")
    join = ~(listed | table | complete | short)
    return F.struct(join.alias("should_join"), F.when(join, JOIN_RULE).alias("rule_id"), reason.alias("review_reason"))


def with_lines(df: DataFrame, text: str) -> DataFrame:
    """Adds lines and decisions (one for each line but the last)."""
    df = df.withColumn("lines", physical_lines(F.col(text)))
    return df.withColumn("decisions", F.transform(
        F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0))),
        lambda line, i: join_decision(line["text"], F.get("lines", i + 1)["text"]),
    ))


def normalized(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds normalized_text, operations (left_end, right_start of each join) and review_reasons (in order of appearance).

    All inside the row: no shuffle. Empty and null texts give empty arrays.
    """
    df = with_lines(df, text)
    pieces = F.transform("lines", lambda line, i: F.concat(line["text"], F.when(F.coalesce(F.get("decisions", i)["should_join"], F.lit(False)), "").otherwise(line["line_break"])))
    joins = F.filter(F.transform("decisions", lambda d, i: F.struct(d["should_join"].alias("j"), F.get("lines", i)["end"].alias("left_end"), F.get("lines", i + 1)["start"].alias("right_start"))), lambda x: x["j"])
    return df.withColumns({
        "normalized_text": F.array_join(pieces, ""),
        "operations": F.transform(joins, lambda x: F.struct(x["left_end"].alias("left_end"), x["right_start"].alias("right_start"))),
        "review_reasons": F.array_distinct(F.filter(F.transform("decisions", lambda d: d["review_reason"]), lambda r: r.isNotNull())),
    }).drop("lines", "decisions")
