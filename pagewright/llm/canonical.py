"""Visually identical text in different characters, brought to one form (problem 4)."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.runtime import spread

# Letters of other alphabets drawn like a Latin letter.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "օ": "o", "ϲ": "c", "ϳ": "j",
}
#: Compatibility forms drawn exactly like what they stand for: Latin ligatures and CJK radicals.
_SAME_SHAPE = [(0xFB00, 0xFB06), (0x2E80, 0x2FDF)]
_DECOMPOSING = [(0x00A0, 0x3400), (0xF900, 0xFFEF), (0x2F800, 0x2FA20)]
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_LINES = re.compile("\r\n|\r|\n")


def invisible() -> str:
    """Every format character and variation selector."""
    return "".join(c for c in map(chr, [*range(0x00AD, 0xFFFF), *range(0xE0100, 0xE01F0)]) if unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or ord(c) >= 0xE0100)


@cache
def transducer() -> tuple[re.Pattern, re.Pattern, re.Pattern, dict[str, str]]:
    """Patterns of marks, of single characters and of clusters that may change, and the mapping of clusters to their one form.

    Built from the Unicode decompositions by rule and checked: no cluster has two outputs, and every
    output is left alone by the mapping.
    """
    table: dict[str, str] = {}

    def put(key: str, out: str) -> None:
        if key != out and table.setdefault(key, out) != out:
            raise ValueError(f"conflicting forms for {key!r}: {table[key]!r}, {out!r}")

    for a, b in _DECOMPOSING:
        for c in map(chr, range(a, b)):
            parts = unicodedata.decomposition(c).split()
            if unicodedata.category(c) == "Zs":
                put(c, " ")
            elif parts and parts[0][0] != "<":
                put(c, unicodedata.normalize("NFC", c))
            elif parts and (parts[0] in ("<wide>", "<narrow>", "<noBreak>") or any(x <= ord(c) <= y for x, y in _SAME_SHAPE)):
                put(c, unicodedata.normalize("NFKC", c))
    put("\t", " ")
    for c in invisible():
        table[c] = ""
    for c, latin in LOOK_ALIKES.items():
        put(c, latin)
    marks = "".join(c for c in map(chr, [*range(0x300, 0x370), 0x3099, 0x309A]) if unicodedata.combining(c))
    wide_marks = {"ﾞ": "゙", "ﾟ": "゚"}
    bases = {c: c for c in map(chr, [*range(0x41, 0x250), *range(0x391, 0x500), *range(0x3041, 0x3100)])} | {k: v for k, v in table.items() if len(v) == 1}
    for key, base in bases.items():
        for m in [*marks, *wide_marks]:
            whole = unicodedata.normalize("NFC", table.get(base, base) + wide_marks.get(m, m))
            if len(whole) == 1:
                put(key + m, whole)
    for out in set(table.values()):
        if table.get(out, out) != out:
            raise ValueError(f"{out!r} is changed again, to {table[out]!r}")
    m = "[" + re.escape(marks + "".join(wide_marks)) + "]"
    # characters beyond the basic plane apart: with them in one class the search would be many times slower
    plane = [[k for k in table if len(k) == 1 and (k > "\uffff") == far] for far in (False, True)]
    single = "[" + re.escape("".join(plane[0])) + "]"
    far = "[" + re.escape("".join(plane[1])) + "]"
    hidden = "[" + re.escape("".join(c for c in invisible() if c <= "\uffff")) + "]"
    return re.compile(m), re.compile(single), re.compile(f".{hidden}*{m}(?:{hidden}*{m})*|{single}|{far}", re.DOTALL), table


@lru_cache(maxsize=1 << 16)
def _cluster(cluster: str) -> str:
    table = transducer()[3]
    bare = "".join(c for c in cluster if table.get(c) != "")
    out, i = [], 0
    while i < len(bare):
        for n in range(min(3, len(bare) - i), 0, -1):
            if bare[i : i + n] in table or n == 1:
                out.append(table.get(bare[i : i + n], bare[i : i + n]))
                i += n
                break
    return unicodedata.normalize("NFC", "".join(out))


def canonical(text: str) -> str:
    """The one form of a text: each cluster replaced by its longest match, in one pass."""
    if text.isascii() and "\t" not in text:
        return text
    marks, single, clusters, table = transducer()
    if marks.search(text) is None and _ASTRAL.search(text) is None:
        return single.sub(lambda m: table[m[0]], text)
    return clusters.sub(lambda m: _cluster(m[0]), text)


def on_the_page(text: str) -> str:
    """Canonical lines without blanks at their ends and without empty lines."""
    return "\n".join(x for line in _LINES.split(canonical(text)) if (x := line.strip()))


def canonical_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces each text column by its canonical form; nulls stay null, other columns stay as they are."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if t is None else canonical(t) for t in b.column(i).to_pylist()], pa.string()) if n in columns else b.column(i) for i, n in enumerate(names)],
                names=names,
            )

    return df.mapInArrow(run, df.schema)


#: Partitions the rows of one text go over when they are joined with what is known of it.
SALTS = 16


def _forms(texts: DataFrame) -> DataFrame:
    """(id, field, form, raw): hashes of the visible form and of the very text t; null and invisible texts and null ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys, raws = [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                if form := on_the_page(t):
                    at.append(k)
                    keys.append(hashlib.sha256(form.encode("utf-8", "surrogatepass")).digest()[:16])
                    raws.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest())
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["id", "field", "form", "raw"])

    return texts.where("id is not null and t is not null").transform(spread, "id").mapInArrow(run, "id string, field string, form binary, raw binary")


def classes(df: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """(node, field, class, links): the class of each text of each column, and how many other texts of the class differ from it.

    Texts of one class read the same on the page, whatever column and row they are from. Null texts,
    texts without any visible character and rows with a null node are left out; equal rows count once.
    """
    one = lambda c: F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("t"))
    rows = _forms(df.select(F.col(f"`{node}`").cast("string").alias("id"), F.inline(F.array(*map(one, columns))))).distinct()
    several = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    texts = rows.join(several, "form", "left_semi").select("form", "raw").distinct().groupBy("form").agg((F.count("*") - 1).alias("links"))
    texts = texts.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(texts, ["form", "salt"], "left")
    return out.select(F.col("id").alias(node), "field", F.lower(F.hex("form")).alias("class"), F.coalesce("links", F.lit(0)).alias("links")).distinct()


def same_on_the_page(df: DataFrame, node: str, text: str) -> DataFrame:
    """Pairs (id_1, id_2), smaller first, of rows whose texts differ but read the same on the page.

    Null texts, and texts without any visible character, take no part. Repeated rows and rows of one
    id give no further pairs. Texts travel as hashes. Exact copies are first brought together, so
    only unequal texts of one class are paired, and a class of copies never meets itself.
    """

    rows = _forms(df.select(F.col(f"`{node}`").cast("string").alias("id"), F.lit(text).alias("field"), F.col(f"`{text}`").cast("string").alias("t"))).drop("field")
    mixed = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    members = rows.join(mixed, "form").distinct()
    texts = members.select("form", "raw").distinct()
    unequal = texts.select("form", F.col("raw").alias("raw_1")).join(texts.select("form", F.col("raw").alias("raw_2")), "form").where("raw_1 < raw_2")
    one = members.select("form", F.col("raw").alias("raw_1"), F.col("id").alias("a"))
    two = members.select("form", F.col("raw").alias("raw_2"), F.col("id").alias("b"))
    pairs = unequal.join(one, ["form", "raw_1"]).join(two, ["form", "raw_2"]).where("a <> b")
    return pairs.select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2")).distinct()
