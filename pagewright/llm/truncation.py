"""Text cut off by field limits or broken transfers (problem 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.runtime import cut

#: A length is a spike if at least this many rows, and this share of the rows as long or longer, have it.
SPIKE_ROWS, SPIKE_SHARE = 5, 0.3
#: Bytes below a byte limit at which a cut can end: a character of up to 4 bytes did not fit.
SLACK = 3
#: Documents, and share of all documents, in which a short last line makes it a closing formula.
CLOSING_ROWS, CLOSING_SHARE, CLOSING_CHARS = 5, 0.0005, 30
#: The same for the two words in front of a final "...", as a share of all texts that end so.
TRAIL_ROWS, TRAIL_SHARE = 5, 0.02
#: Different titles, and share of all different titles, that must end like a text of one line for it to be one.
TITLE_ROWS, TITLE_SHARE = 3, 0.0005
# What ends a sentence, what closes a quotation, what starts a list row, marks a cut leaves behind.
_END = "。．.!?！？"
_CLOSE = "」』）)\"”’】〉》"
_BULLET = r"^\s*[・●◆■▶◇○□•*\-–—]\s*\S"
_ROW = r"^\S+(?: \S+)*(?:[ 　]{2,}|\t)\S+(?:(?:[ 　]{2,}|\t)\S+)*$"
_BLANKS = " \t\r\n\x0b\x0c\u00a0\u2007\u202f\u3000"
#: Longest line that can be a table row or a title, and end of a line in which its last words are looked for.
_ROW_CHARS = 200
#: Characters at the end of a text in which a mark or remnant of a cut is looked for.
_REMNANT_CHARS = 20
_TITLED = r"^\p{Lu}[\p{L}'’-]*(?: (?:(?:of|the|and|in|to|for|a|an)\b|\p{Lu}[\p{L}'’-]*|\p{N}+))+$"  # short function words aside, capitals only
_REMNANT = r"(?:�+|[ 　]*\[(?:…|\.\.\.)?\]?|[ 　]*[(（](?:…|\.\.\.)[)）]?|(?<!…)…|\.\.\.)$"


def _counted(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def length_spikes(df: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """Field limits: (source, field, unit, length, rows, longer) where the length histogram of a source's column ends in a spike.

    Histograms are counted per source and column in characters and in UTF-8 bytes, over all rows, with
    partial sums before the shuffle. A length is a spike if it holds SPIKE_ROWS rows and SPIKE_SHARE of
    all rows as long or longer. In bytes the lengths within SLACK below a limit count with it, as a
    character is never split. Null and empty texts are left out; a null source is a source.
    """
    length = lambda c: F.struct(F.lit(c).alias("field"), F.length(f"`{c}`").alias("chars"), F.octet_length(f"`{c}`").alias("bytes"))
    return _spikes(df.select(F.col(f"`{source}`").alias("source"), F.explode(F.array(*map(length, columns))).alias("x")).select("source", "x.*").where("chars > 0"))


def _spikes(lengths: DataFrame) -> DataFrame:
    hist = lengths.select("source", "field", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])).alias("x")).select("source", "field", "x.*")
    hist = _counted(hist, ["source", "field", "unit", "length"])
    # a source has at most as many lengths as its longest text has bytes
    w = Window.partitionBy("source", "field", "unit").orderBy("length")
    rows = F.when(F.col("unit") == "bytes", F.sum("n").over(w.rangeBetween(-SLACK, 0))).otherwise(F.col("n"))
    longer = F.coalesce(F.sum("n").over(w.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    spikes = hist.select("source", "field", "unit", "length", rows.alias("rows"), longer.alias("longer"))
    return spikes.where((F.col("rows") >= SPIKE_ROWS) & (F.col("rows") >= SPIKE_SHARE * (F.col("rows") + F.col("longer"))))


def _last_line(text: Column) -> Column:
    return F.btrim(F.substring_index(text, "\n", -1), F.lit(_BLANKS))


def _endings(df: DataFrame, doc: str, source: str, text: str, title: str | None) -> DataFrame:
    """What the end of each text looks like; the text itself is not carried on."""
    t = F.rtrim(F.col(f"`{text}`").cast("string"), F.lit(_BLANKS))
    out = df.select(
        F.col(f"`{doc}`").alias("doc"), F.col(f"`{source}`").alias("source"), F.length(f"`{text}`").alias("chars"), F.octet_length(f"`{text}`").alias("bytes"),
        F.xxhash64(t).alias("copy"), (F.col(f"`{title}`") if title else F.lit(None).cast("string")).alias("title"),
        _last_line(t).alias("last"), F.size(F.split(t, "\n")).alias("lines"), F.when(F.instr(t, "\n") > 0, _last_line(F.substring_index(F.substring_index(t, "\n", -2), "\n", 1))).alias("before"),
    ).where("chars is not null")
    kept = F.greatest(F.length("last") - _REMNANT_CHARS, F.lit(0))
    bare = F.rtrim(F.concat(F.substring(F.col("last"), F.lit(1), kept), F.regexp_replace(F.right("last", F.lit(_REMNANT_CHARS)), _REMNANT, "")), F.lit(_BLANKS))
    # rows and titles are short; on long lines their patterns would only cost time
    short = lambda c, pattern: F.when(F.length(c) <= _ROW_CHARS, F.col(c).rlike(pattern)).otherwise(False)
    out = out.withColumns({"bare": bare, "bullet": F.col("last").rlike(_BULLET), "row": short("last", _ROW), "listed_before": F.coalesce(F.col("before").rlike(_BULLET), F.lit(False))})
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.right(c, F.lit(1)), r"[0-9０-９]", "0"), r"[A-Za-z]", "a")
    latin = F.col("last").rlike(r"^[\p{IsLatin}\p{N}\p{P}\s]+$")
    return out.select(
        "doc", "source", "chars", "bytes", "copy", (F.col("last") == "").alias("blank"),
        F.right("title", F.lit(2)).alias("title_tail"), F.xxhash64("title").alias("title_hash"), F.right("last", F.lit(2)).alias("tail"),
        F.when((F.length("last") <= CLOSING_CHARS) & (F.col("lines") > 1) & ~F.col("bullet") & ~F.col("row"), F.col("last")).alias("short"),
        F.when(F.col("last").endswith("..."), F.regexp_extract(F.right("last", F.lit(_ROW_CHARS)), r"(\S+\s+\S+)\.\.\.$", 1)).alias("words"),
        (F.col("bare") != F.col("last")).alias("marked"),
        (F.col("bare").rlike(rf"[{_END}…][{_CLOSE}]*$") | F.col("bare").rlike(r"[）)】〉》\"”]$")).alias("stop"),
        F.col("last").rlike(rf"(?:……[{_CLOSE}]*|(?:…|\.\.\.)[{_CLOSE}]+)$").alias("speech"),
        # a list row ends like the row before it; a table row is words and numbers set apart by blanks
        (F.col("bullet") & (~F.col("listed_before") | (shape(F.col("before")) == shape(F.col("last")))) | F.col("row")).alias("listed"),
        (latin & short("last", _TITLED) & (F.col("lines") == 1)).alias("latin_title"),
        (~latin & ~F.col("last").rlike(r"[、。，,「『（？！]") & (F.col("lines") == 1)).alias("plain"),
    )


def truncated(df: DataFrame, doc: str, source: str, text: str, title: str | None = None) -> DataFrame:
    """One row per document with text: doc, source, chars, bytes, limited (at a field limit), cut, reason.

    A text is cut if it ends inside a word or sentence, a mark or remnant of the cut aside. Texts
    that end by intent without a full stop are told apart by what the whole corpus shows: closing
    formulas are last lines that many documents share, trailing-off speech ends in a doubled ellipsis
    or in words many documents end with, a text of one line may end like the titles in ``title``, list
    and table rows have the shape of the row before. At a spike of its source's length histogram
    (characters or bytes) any end without terminal punctuation or closing formula counts as cut.
    Null and blank texts are left out; repeated rows give one row; a null source is a source.
    """
    all_ = cut(_endings(df, doc, source, text, title))  # texts are looked at once
    ends = all_.where("not blank")
    total = ends.agg(F.count("*").alias("total"))
    formula = _counted(ends.where("short is not null").select("short", "copy").distinct(), ["short"]).crossJoin(F.broadcast(total))  # one row
    formula = formula.where((F.col("n") >= CLOSING_ROWS) & (F.col("n") >= F.col("total") * CLOSING_SHARE)).select("short", F.lit(True).alias("closing"))
    # copies of a text or title count once, whatever their number
    dots = ends.where("words <> ''").select("words", "copy").distinct()
    trail = _counted(dots, ["words"]).crossJoin(F.broadcast(dots.agg(F.count("*").alias("total"))))  # one row
    trail = trail.where((F.col("n") >= TRAIL_ROWS) & (F.col("n") >= F.col("total") * TRAIL_SHARE)).select("words", F.lit(True).alias("trailing"))
    named = ends.where("title_tail <> ''").select(F.col("title_tail").alias("tail"), "title_hash").distinct()
    titles = _counted(named, ["tail"]).crossJoin(F.broadcast(named.agg(F.count("*").alias("total"))))  # one row
    titles = titles.where((F.col("n") >= TITLE_ROWS) & (F.col("n") >= F.col("total") * TITLE_SHARE)).select("tail", F.lit(True).alias("as_title"))
    limits = _spikes(all_.withColumn("field", F.lit(text)).where("chars > 0"))
    # one limit shows in both histograms; it is taken in the unit in which it is sharper
    sharper = limits.groupBy("source").agg(F.max(F.struct("rows", "unit"))["unit"].alias("own"))
    limits = limits.alias("l").join(sharper.alias("s"), F.expr("l.source <=> s.source and l.unit = s.own")).select("l.*")
    chars = limits.where("unit = 'chars'").select(F.col("source").alias("cs"), F.col("length").alias("cl"))
    lengths = F.explode(F.sequence(F.col("length") - SLACK, F.col("length")))
    bytes_ = limits.where("unit = 'bytes'").select(F.col("source").alias("bs"), lengths.alias("bl")).distinct()

    # at most 1 / CLOSING_SHARE formulas and 1 / TRAIL_SHARE pairs of words can pass their shares
    x = ends.join(F.broadcast(formula), "short", "left").join(F.broadcast(trail), "words", "left").join(titles, "tail", "left")
    x = x.join(chars, F.col("source").eqNullSafe(F.col("cs")) & (F.col("chars") == F.col("cl")), "left")
    x = x.join(bytes_, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bytes") == F.col("bl")), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    limited = F.col("cl").isNotNull() | F.col("bl").isNotNull()
    reason = (
        F.when(F.col("speech") | yes("trailing") | F.col("stop") | yes("closing"), F.lit(None).cast("string"))
        .when(F.col("marked"), "remnant")
        .when(limited, "limit")
        .when(~(F.col("listed") | F.col("latin_title") | (F.col("plain") & yes("as_title"))), "unfinished")
    )
    out = x.select("doc", "source", "chars", "bytes", limited.alias("limited"), reason.alias("reason")).distinct()
    return out.select(F.col("doc").alias(doc), F.col("source").alias(source), "chars", "bytes", "limited", F.col("reason").isNotNull().alias("cut"), "reason")


def cut_rates(marked: DataFrame, source: str) -> DataFrame:
    """Per source: documents with text, how many were cut, how many of these at a limit, and the rate."""
    return marked.groupBy(source).agg(
        F.count("*").alias("docs"), F.sum(F.col("cut").cast("long")).alias("cut_docs"),
        F.sum((F.col("cut") & F.col("limited")).cast("long")).alias("at_limit"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"),
    )
