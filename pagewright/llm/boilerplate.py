"""Lines repeated across one source's documents (problem 6)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.runtime import cut, discard, shipped_hashes, spread, stored

MIN_CHARS = 10
MIN_DOCS = 5
MIN_SHARE = 0.005
SIMILARITY = 0.8
#: Characters in a shingle; lines of running Japanese have no word breaks.
SHINGLE = 5
BANDS, ROWS = 5, 4
#: Of the BANDS * ROWS smallest hashes those that must be equal, to three bits, before texts are compared; of two lines of
#: similarity 0.8 two percent have fewer. Their lengths are as near, unless MOST_EQUAL are equal, as in lines of one repeated mark.
LEAST_EQUAL, MOST_EQUAL, NEAR_LENGTH = 13, 18, 0.75
#: Partitions the rows of one line go over, and masked lines of one bucket that go to one partition.
SALTS, BUCKET_ROWS = 16, 5000
#: Links, of 16 bytes each, that one task resolves.
LAST_LINKS = 2_000_000
#: Characters hashed at once.
_SLICE_CHARS = 500_000
_HIDDEN = re.compile(r"[\s­᠎​-‏‪-‮⁠-⁤︀-️﻿]+")
_MASKS = re.compile(r"[0-9]+(?:[年月日/.:-][0-9]+)*|[A-ZÀ-Þ][a-zà-ÿ]+|[ァ-ヺー]{2,}")


def line_key(line: str) -> str:
    """A line without blanks, invisible characters, width differences and digits at its ends."""
    return _ends(_HIDDEN.sub("", unicodedata.normalize("NFKC", line)))


def _ends(key: str) -> str:
    a, b = 0, len(key)
    while a < b and key[a].isdecimal():
        a += 1
    while b > a and key[b - 1].isdecimal():
        b -= 1
    return key[a:b]


def masked(key: str) -> str:
    """The key with numbers and dates as 0, Latin names as N and katakana names as ア."""
    return _MASKS.sub(lambda m: "0" if m[0][0].isdigit() else "N" if m[0][0].isascii() or m[0][0] < "ʰ" else "ア", key)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SALTS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_hashes(groups: list[str], texts: list[str]) -> np.ndarray:
    """(len(texts), BANDS) signed 64-bit band keys of MinHash signatures; equal keys only within a group."""
    return sketches(groups, texts)[:, :BANDS]


def sketches(groups: list[str], texts: list[str]) -> np.ndarray:
    """The band keys and, in one column more, three bits of each of the BANDS * ROWS smallest hashes."""
    out, a = [np.zeros((0, BANDS + 1), np.int64)], 0
    while a < len(texts):  # in slices of bounded size; a single longer text is a slice of its own
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= _SLICE_CHARS:
            size += len(texts[b])
            b += 1
        out.append(_sketches(groups[a:b], texts[a:b]))
        a = b
    return np.concatenate(out)


def _sketches(groups: list[str], texts: list[str]) -> np.ndarray:
    chars = np.frombuffer("".join(t.ljust(SHINGLE) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter((max(len(t), SHINGLE) for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    n = chars.size - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(1_000_003) + chars[k : k + n]
    h = _mix(h)
    over = np.zeros(chars.size, bool)  # shingles that would run into the next text repeat its first one
    for k in range(1, SHINGLE):
        over[starts + lens - k] = True
    first = np.repeat(h[np.minimum(starts, n - 1)], lens)
    h = np.where(over[:n], first[:n], h)
    seed = {g: np.uint64(_fold(g)) for g in set(groups)}
    group = np.array([seed[g] for g in groups], np.uint64)
    out = np.empty((len(texts), BANDS + 1), np.int64)
    bits = np.zeros(len(texts), np.uint64)
    for b in range(BANDS):
        key = group + np.uint64(b + 1)
        for r in range(ROWS):
            low = np.minimum.reduceat(h * _SALTS[b * ROWS + r] >> np.uint64(1), starts)
            key = _mix(key ^ low)
            bits = bits << np.uint64(3) | _mix(low) & np.uint64(7)
        out[:, b] = key.view(np.int64)
    out[:, BANDS] = bits.view(np.int64)
    return out


def _fold(text: str) -> int:
    v = 0xCBF29CE484222325
    for byte in text.encode("utf-8", "surrogatepass"):
        v = (v ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return v


def _lines(b: pa.RecordBatch) -> tuple[list, list, list, list, list]:
    """(document, source, line number, key, masked key) of each long enough line of a batch."""
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    for i, s, t in zip(*(c.to_pylist() for c in b.columns)):
        for no, line in enumerate(t.split("\n")):
            if len(line) and len(key := line_key(line)) >= MIN_CHARS:
                for c, v in zip(out, (i, s, no, key, masked(key))):
                    c.append(v)
    return out


def _within(sources: list[str], texts: list[str]) -> np.ndarray:
    """64-bit identity of each text within its source."""
    return np.fromiter((xxhash.xxh3_64_intdigest((s + "\n" + t).encode("utf-8", "surrogatepass")) for s, t in zip(sources, texts)), np.uint64, len(texts)).view(np.int64)


def _short(bands: np.ndarray) -> np.ndarray:
    """Five bytes of each band key: enough to tell which are met again, as a false one only lets a line through."""
    return bands >> 24


_TABLE = (1 << 24) - 1


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The low bits that occur among hashes."""
    table = np.zeros(_TABLE + 1, bool)
    table[hashes & _TABLE] = True
    return table


def _among(values: np.ndarray, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are among the sorted hashes; most of the others the table tells."""
    hit = table[values & _TABLE]
    some = values[hit]
    at = np.minimum(np.searchsorted(hashes, some), hashes.size - 1)
    hit[hit] = hashes[at] == some if hashes.size else False
    return hit


def repeated_lines(df: DataFrame, doc: str, source: str, text: str) -> DataFrame:
    """Lines of clusters that stand in too many documents of their source.

    Result: doc, source, line_no, key_docs (distinct documents of the source with this very line),
    cluster_docs (with any line of its cluster of near-copies), source_docs (distinct documents of the
    source, those with null text included). Too many are MIN_DOCS and MIN_SHARE of the source's
    documents. Lines are split at each line feed; lines whose key has fewer than MIN_CHARS characters
    don't count. Rows with a null document or source are ignored; repeated rows count once; an empty
    table gives an empty result.

    Masked keys are hashed into MinHash bands per source. Buckets are looked at first (partial sums
    before the shuffle), so only lines of buckets with two documents go further, as identities; the
    text of a masked line travels once. Masked lines of a bucket that are at least SIMILARITY alike
    (Jaccard of SHINGLE-character shingles) are linked, directly or through the bucket's most frequent
    line; linked lines are one cluster, over any number of buckets.
    """
    base = df.select(F.col(f"`{doc}`").cast("string").alias("doc"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("t"))
    base = base.where("doc is not null and source is not null")
    sizes = base.groupBy("source").agg(F.countDistinct("doc").alias("source_docs"))
    texts = spread(base.where("t is not null and t <> ''"), "doc")

    def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, src, _, _, mask = _lines(b)
            bands = _short(band_hashes(src, mask)).ravel()
            order = np.argsort(bands, kind="stable")
            doc = np.fromiter((xxhash.xxh32_intdigest(i.encode("utf-8", "surrogatepass")) & 0xFFFF for i in ids), np.int32, len(ids)).repeat(BANDS)[order]
            h, first = np.unique(bands[order], return_index=True)
            low, high = (f.reduceat(doc, first) if h.size else doc for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(low), pa.array(high)], names=["h", "low", "high"])

    buckets = texts.mapInArrow(bucket_counts, "h long, low int, high int").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    big = cut(buckets.where("low <> high").select("h"))  # of two documents at least: MIN_DOCS holds for clusters, which may lie over several buckets
    ship = shipped_hashes(big, "h")

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        table = None if ship is None else _bits(ship)
        for b in batches:
            ids, src, no, key, mask = _lines(b)
            bands, bits = np.split(sketches(src, mask), [BANDS], axis=1)
            hit = np.ones(bands.shape, bool) if ship is None else _among(_short(bands), ship, table)
            rows = np.flatnonzero(hit.any(axis=1)).tolist()
            pick = lambda c: [c[i] for i in rows]
            src, mask = pick(src), pick(mask)
            form = _within(src, mask)
            new = [f not in told and not told.add(f) for f in form.tolist()]
            found = [bands[i][hit[i]].tolist() if fresh else None for i, fresh in zip(rows, new)]
            drawn = [int(bits[i, 0]) if fresh else None for i, fresh in zip(rows, new)]
            shown = [m if fresh else None for m, fresh in zip(mask, new)]
            arrays = [pa.array(pick(ids), pa.string()), pa.array(src, pa.string()), pa.array(pick(no), pa.int32()), pa.array(_within(src, pick(key))), pa.array(form), pa.array(shown, pa.string()), pa.array(drawn, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "source", "line_no", "key", "form", "mask", "bits", "bands"])

    lines = stored(texts.mapInArrow(in_buckets, "doc string, source string, line_no int, key long, form long, mask string, bits long, bands array<bigint>"))
    forms = lines.groupBy("form").agg(F.count("*").alias("n"), F.max("mask").alias("mask"), F.max("bits").alias("bits"), F.first("bands", ignorenulls=True).alias("bands"))
    if ship is None:  # all lines came along: keep the forms of large buckets only
        short = F.shiftright("band", 24)
        wanted = forms.select("form", F.explode("bands").alias("band")).join(big, short == F.col("h")).groupBy("form").agg(F.collect_set("band").alias("held"))
        forms = forms.join(wanted, "form").select("form", "n", "mask", "bits", F.col("held").alias("bands"))
    clusters = _clusters(stored(forms))
    # a line, and a source, may hold any share of all rows: they go over SALTS partitions at each join
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    slim = lines.select("form", "key", "source", F.xxhash64("doc").alias("doc")).withColumn("salt", salt("doc")).join(clusters.withColumn("salt", F.explode(salts)), ["form", "salt"])
    held = cut(slim.groupBy("form", "key", "cluster", "source", "doc").agg(F.lit(1).alias("one")).drop("one"))
    docs = held.groupBy("cluster", "source", "doc").agg(F.lit(1)).groupBy("cluster", "source").agg(F.count("*").alias("cluster_docs")).withColumn("salt", salt("cluster"))
    need = F.greatest(F.lit(MIN_DOCS), F.col("source_docs") * MIN_SHARE)
    often = docs.join(sizes.withColumn("salt", F.explode(salts)), ["source", "salt"]).where(F.col("cluster_docs") >= need).select("cluster", "cluster_docs", "source_docs")
    keys = held.groupBy("form", "key", "cluster").agg(F.count("*").alias("key_docs")).join(often, "cluster").select("key", "key_docs", "cluster_docs", "source_docs")
    told = lines.select("doc", "source", "line_no", "key").withColumn("salt", salt("doc"))
    out = told.join(keys.withColumn("salt", F.explode(salts)), ["key", "salt"]).drop("salt").distinct()
    return out.select(F.col("doc").alias(doc), F.col("source").alias(source), "line_no", "key_docs", "cluster_docs", "source_docs")


def _clusters(forms: DataFrame) -> DataFrame:
    """(form, cluster) for the forms of clusters that may stand in MIN_DOCS documents. forms: form, n, mask, bits, bands; a stored table, used up.

    Forms of a shared bucket whose sketches fit are brought together by their identities alone: groups
    whose lines are fewer than MIN_DOCS hold no such cluster, and their texts are not compared.
    """
    held = stored(_held(forms))
    fit = _fit("of", "head_of")
    far = held.select("h", "form", "of", "rows", (~fit).alias("apart"), F.col("form").alias("label"))
    group = linked(held.where(fit).select("form", "head").unionByName(_pairs(far)))
    grouped = forms.select("form", "n").join(group, "form", "left").select("form", "n", F.coalesce("head", "form").alias("group"))
    large = grouped.groupBy("group").agg(F.sum("n").alias("lines")).where(F.col("lines") >= MIN_DOCS).select("group")
    kept = cut(grouped.join(large, "group").select("form"))
    beside = stored(held.join(kept, "form", "left_semi"))
    text = stored(forms.join(kept, "form", "left_semi").select("form", _grams(F.col("mask")).alias("grams")))
    discard(forms, held)
    near = linked(_links(beside, text))
    discard(beside, text)
    return cut(kept.join(near, "form", "left").select("form", F.coalesce("head", "form").alias("cluster")))


def _grams(text: Column) -> Column:
    """The different shingles of a line as hashes of four bytes."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - SHINGLE + 1, F.lit(1))), lambda i: F.hash(F.substring(text, i, F.lit(SHINGLE)))))


def _held(forms: DataFrame) -> DataFrame:
    """(h, form, of, head, head_of, rows): forms beside the most frequent form of each of their buckets, found with partial aggregation; of is (bits, chars)."""
    placed = forms.select("form", "n", F.struct("bits", F.length("mask").alias("chars")).alias("of"), F.explode("bands").alias("h"))
    heads = placed.groupBy("h").agg(F.max(F.struct("n", "form", "of")).alias("top"), F.count("*").alias("rows")).where("rows > 1")
    return placed.select("h", "form", "of").join(heads.select("h", F.col("top.form").alias("head"), F.col("top.of").alias("head_of"), "rows"), "h").where("form <> head")


def _fit(a: str, b: str) -> Column:
    """Whether two forms may be alike: LEAST_EQUAL of their smallest hashes are equal and their lengths are near, or nearly all hashes are equal."""
    a, b = F.col(a), F.col(b)
    x = a["bits"].bitwiseXOR(b["bits"])
    triples = sum(1 << 3 * k for k in range(BANDS * ROWS))
    other = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(triples)))
    near = F.least(a["chars"], b["chars"]) >= NEAR_LENGTH * F.greatest(a["chars"], b["chars"])
    return (BANDS * ROWS - other >= LEAST_EQUAL) & (near | (BANDS * ROWS - other >= MOST_EQUAL))


def _pairs(held: DataFrame) -> DataFrame:
    """(form, head): each form that is ``apart`` from its bucket's head with the others of the bucket that fit and have another label.

    held: h, form, of, rows, apart, label. Large buckets go over several partitions.
    """
    parts = F.ceil(F.col("rows") / BUCKET_ROWS)
    apart = held.where("apart").select("h", "form", "of", "label", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    all_ = held.select("h", F.col("form").alias("other"), F.col("of").alias("other_of"), F.col("label").alias("other_label"), F.pmod(F.xxhash64("form"), parts).alias("part"))
    pairs = apart.join(all_, ["h", "part"]).where((F.col("label") != F.col("other_label")) & _fit("of", "other_of"))
    return pairs.select(F.least("form", "other").alias("form"), F.greatest("form", "other").alias("head")).distinct()


def _links(held: DataFrame, text: DataFrame) -> DataFrame:
    """(form, head): links between forms of a shared bucket, as many as it takes to connect all that are alike.

    Each form is compared with the most frequent one of each of its buckets. Those like it are connected
    through it and need no comparison with each other; every other form of the bucket is compared with
    those of the bucket it is not yet connected with.
    """
    near = cut(_alike(held.where(_fit("of", "head_of")).select("form", "head").distinct(), text))
    label = linked(near).withColumnRenamed("head", "label")
    named = held.join(near.withColumn("near", F.lit(True)), ["form", "head"], "left").join(label, "form", "left")
    named = stored(named.select("h", "form", "of", "rows", F.col("near").isNull().alias("apart"), F.coalesce("label", "form").alias("label")))
    more = cut(_alike(_pairs(named), text))
    discard(named)
    return near.unionByName(more)


def _alike(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """Pairs (form, head) whose masked lines share SIMILARITY of their shingles. text: form, grams."""
    both = pairs.join(text.withColumnRenamed("grams", "a"), "form").join(text.select(F.col("form").alias("head"), F.col("grams").alias("b")), "head")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= SIMILARITY * (F.size("a") + F.size("b") - shared)).select("form", "head")


def linked(edges: DataFrame) -> DataFrame:
    """(form, head): of each form with a link the smallest form its links lead to, at any distance.

    While there are more than LAST_LINKS links, every form is put to the smallest form beside it and the
    links are drawn between what forms were put to; each round leaves a fraction of them. The rest is
    solved in one task.
    """
    links, put = cut(edges.toDF("form", "to").where("form <> to").distinct()), None
    while links.count() > LAST_LINKS:
        ways = links.unionByName(links.select(F.col("to").alias("form"), F.col("form").alias("to")))
        near = cut(ways.groupBy("form").agg(F.least(F.first("form"), F.min("to")).alias("head")))
        beyond = near.select(F.col("form").alias("head"), F.col("head").alias("next"))
        near = cut(near.join(beyond, "head").select("form", F.col("next").alias("head")))
        put = near if put is None else cut(_further(put, near))
        ends = links.join(near.withColumnRenamed("head", "a"), "form").join(near.select(F.col("form").alias("to"), F.col("head").alias("b")), "to")
        links = cut(ends.select(F.least("a", "b").alias("form"), F.greatest("a", "b").alias("to")).where("form <> to").distinct())
    last = links.repartition(1).mapInArrow(_components, "form long, head long")
    return cut(last if put is None else _further(put, cut(last)))


def _further(put: DataFrame, near: DataFrame) -> DataFrame:
    then = near.select(F.col("form").alias("head"), F.col("head").alias("next"))
    return put.join(then, "head", "left").select("form", F.coalesce("next", "head").alias("head"))


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, head) of the links of one task: labels sink to the least one beside them, then to the label of their label."""
    got = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
    if got:
        names, at = np.unique(np.concatenate(got, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        label = np.arange(names.size)
        while True:
            least = np.minimum(label[a], label[b])
            if (label[a] == label[b]).all():
                break
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            while (label[label] != label).any():
                label = label[label]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["form", "head"])


def exact(lines: DataFrame) -> DataFrame:
    """Of repeated lines those that stand in too many documents by themselves, without near-copies."""
    return lines.where((F.col("key_docs") >= MIN_DOCS) & (F.col("key_docs") >= MIN_SHARE * F.col("source_docs")))


def without_lines(df: DataFrame, doc: str, text: str, drop: DataFrame, to: str = "clean_text") -> DataFrame:
    """``df`` with its text less the lines (doc, line_no) of ``drop``; rows without such lines keep their text, nulls stay null."""
    gone = drop.select(F.col(doc).alias("__doc"), "line_no").distinct().groupBy("__doc").agg(F.collect_set("line_no").alias("__gone"))
    kept = F.filter(
        F.transform(F.split(F.col(text), "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
        lambda x: ~F.array_contains(F.col("__gone"), x["i"]),
    )
    joined = df.join(gone, F.col(doc).cast("string") == F.col("__doc"), "left")
    clean = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return joined.withColumn(to, clean).drop("__doc", "__gone")
