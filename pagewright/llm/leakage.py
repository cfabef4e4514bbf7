"""Evaluation passages inside training text (problem 8)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.runtime import spread

#: Letters and digits that a shared run must have, and those of a seed inside it.
RUN, SEED = 40, 20
#: Characters of test items that are searched for at once; more items are searched in further blocks.
BLOCK_CHARS = 4_000_000
#: Scores of the alignment, and the share of an item's letters an alignment must match to be reported.
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0
COVER = 0.6
_MARGIN = 60
_OTHER = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 24
#: Characters hashed at once; longer texts are hashed in pieces that overlap by all but one character of a seed.
PIECE = 400_000


def letters(text: str) -> str:
    """Letters and digits only, in one case and width."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())


class _Known:
    """Membership of hashes in a bounded sorted set, thinned by a bit table first."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.sorted >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``h`` that are known, and the number of each in the sorted set."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        rank = np.searchsorted(self.sorted, h[at])
        rank[rank == self.sorted.size] = 0
        hit = self.sorted[rank] == h[at] if self.sorted.size else np.zeros(0, bool)
        return at[hit], rank[hit]


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    base, inverse = int(_BASE), pow(int(_BASE), -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * PIECE, b, np.uint64)))) for b in (base, inverse))


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Texts in groups of at most PIECE characters: (numbers, offsets, parts); every run of SEED characters is in one part."""
    numbers, offsets, parts, size = [], [], [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(len(t) - SEED + 1, 1), PIECE - SEED + 1):
            part = t[a : a + PIECE]
            if parts and size + len(part) > PIECE:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(k)
            offsets.append(a)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, offsets, parts


def found_seeds(texts: list[str], known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and rank of each known seed in the texts."""
    got = [(np.zeros(0, np.int64),) * 3]
    for numbers, offsets, parts in pieces(texts):
        h, part, place = seed_hashes(parts)
        at, rank = known.find(h)
        p = part[at]
        got.append((np.array(numbers, np.int64)[p], place[at] + np.array(offsets, np.int64)[p], rank))
    return tuple(np.concatenate(c) for c in zip(*got))


def seed_hashes(texts: list[str], size: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` characters, its text's number and its place in the text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.maximum(lens - size + 1, 0)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # sum of c[i] * base^i over a window, shifted by the inverse power: prefix sums, all modulo 2^64
    power, back = _powers()
    h = np.empty(chars.size - size + 1, np.uint64)
    for a in range(0, h.size, PIECE):
        c = chars[a : a + PIECE + size - 1]
        prefix = np.concatenate(([np.uint64(0)], np.cumsum((c + np.uint64(1)) * power[: c.size])))
        h[a : a + PIECE] = (prefix[size:] - prefix[:-size]) * back[: c.size - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    text = np.repeat(np.arange(len(texts)), n)
    starts = np.cumsum(lens) - lens
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return h[np.repeat(starts, n) + place], text, place


def rare_seeds(texts: list[str], known: _Known, counts: np.ndarray, edited: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of RUN characters the seed the corpus has least often: any shared run holds one.

    A run with a seed the corpus lacks is shared by no document and needs none. For edited copies
    every seed the corpus has is taken: the rarest of a run may be one that only another copy has.
    """
    h, text, place = seed_hashes(texts)
    if not h.size:
        return h, text, place
    n = counts[np.searchsorted(known.sorted, h)].astype(np.int64)
    if edited:
        keep = n > 0
        return h[keep], text[keep], place[keep]
    order = np.where(n == 0, np.iinfo(np.int64).max, n)
    width = RUN - SEED + 1
    keep = np.zeros(h.size, bool)
    for t in range(len(texts)):
        a, b = np.searchsorted(text, [t, t + 1])
        if b - a >= width:
            # seeds alike in count are told apart by their hash, so equal windows choose alike
            rank = np.lexsort((h[a:b], order[a:b]))
            value = np.empty(b - a, np.int64)
            value[rank] = np.arange(b - a)
            runs = np.lib.stride_tricks.sliding_window_view(value, width)
            wanted = np.lib.stride_tricks.sliding_window_view(n[a:b] > 0, width).all(axis=1)
            keep[a + np.unique((runs.argmin(axis=1) + np.arange(b - a - width + 1))[wanted])] = True
    return h[keep], text[keep], place[keep]


def align(a: str, b: str) -> tuple[float, int]:
    """Best local alignment of two texts (Smith-Waterman, linear gaps): score, and characters of ``a`` matched in it."""
    if not a or not b:
        return 0.0, 0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    ramp = np.arange(1, y.size + 1) * -GAP
    rows = np.zeros((x.size + 1, y.size + 1))
    for i in range(x.size):
        up = rows[i]
        best = np.maximum(np.maximum(up[:-1] + np.where(y == x[i], MATCH, MISMATCH), up[1:] + GAP), 0)
        rows[i + 1, 1:] = np.maximum.accumulate(best + ramp) - ramp
    i, j = np.unravel_index(rows.argmax(), rows.shape)
    score, same = float(rows[i, j]), 0
    while i and j and rows[i, j] > 0:
        if abs(rows[i, j] - rows[i - 1, j - 1] - (MATCH if x[i - 1] == y[j - 1] else MISMATCH)) < 1e-9:
            same += int(x[i - 1] == y[j - 1])
            i, j = i - 1, j - 1
        elif abs(rows[i, j] - rows[i - 1, j] - GAP) < 1e-9:
            i -= 1
        else:
            j -= 1
    return score, same


def shared_run(a: str, b: str, i: int, j: int) -> int:
    """Length of the common run through a[i] and b[j]."""
    lo = 0
    while i > lo and j > lo and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    hi, n = 0, min(len(a) - i, len(b) - j)
    while hi < n and a[i + hi] == b[j + hi]:
        hi += 1
    return lo + hi


def places(starts: set[int], size: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches of a document around the seed diagonals of an item of ``size`` letters.

    Stretches of neighbouring diagonals that touch are one; a long one is cut into parts that overlap
    by twice the item, as no alignment of a positive score is longer.
    """
    merged: list[list[int]] = []
    for s in sorted(starts):
        a, b = max(0, s - _MARGIN), min(end, s + size + _MARGIN)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    width = 3 * size + 2 * _MARGIN
    for a, b in merged:
        while b - a > width:
            yield a, a + width
            a += width - 2 * size
        yield a, b


def best_place(item: str, doc: str, starts: set[int]) -> tuple[int, float]:
    """Letters matched and score of the item's best alignment; one that covers COVER goes before others.

    Neither can exceed the letters item and place have in common, so places that can't be the best
    are not aligned.
    """
    if item in doc:
        return len(item), float(len(item))
    has, enough = Counter(item), COVER * len(item)
    parts = {doc[a:b] for a, b in places(starts, len(item), len(doc))}  # a passage may be repeated many times
    best = (False, 0.0, 0)
    for most, part in sorted((((has & Counter(p)).total(), p) for p in parts), reverse=True):
        if most <= best[1] and (best[0] or most < enough):
            break
        score, same = align(item, part)
        best = max(best, (same >= enough, score, same))
    return best[2], best[1]


def _blocks(items: DataFrame, item: str, text: str, limit: int) -> Iterator[tuple[list, list[str]]]:
    """The test items, normalised, in blocks of at most ``limit`` characters (one item at least)."""
    ids, texts, size = [], [], 0
    rows = items.select(item, text).where(f"{item} is not null and {text} is not null").distinct().orderBy(item, text)
    for r in rows.toLocalIterator(prefetchPartitions=True):
        t = letters(r[1])
        if len(t) < SEED:
            continue
        if texts and size + len(t) > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(t)
        size += len(t)
    if texts:
        yield ids, texts


def leaked(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, edited: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, item, run, matched, score) for documents and test items that share a passage.

    run is the longest shared run of letters and digits through a seed, everything else between
    them, case and width disregarded. matched and score are those of the best local alignment
    (Smith-Waterman) of the item with the document around its seeds, wherever in the document they
    stand. With ``edited`` off only pairs with a run of RUN or more are given, and all of them. With
    ``edited`` on, pairs are given whose alignment covers COVER of the item as well, paraphrased or
    edited copies among them, if they share a seed of SEED unedited letters with it. Null and empty
    texts, and items of fewer than SEED letters, match nothing (see ``unsearched``); equal rows give
    one row.

    Test items are a stated query set, searched in blocks of bounded size that travel to every task;
    documents are never joined or moved. Corpus counts of all seeds of a block are taken first, then
    of each run of RUN item characters the rarest seed (with ``edited`` every seed that occurs) is
    looked up in every position of every document.
    """
    source = docs.select(doc, text).where(f"{doc} is not null and {text} is not null").transform(spread, doc)
    doc_type, item_type = docs.schema[doc].dataType, items.schema[item].dataType
    schema = f"{doc} {doc_type.simpleString()}, {item} {item_type.simpleString()}, run int, matched double, score double"
    out = None
    for ids, texts in _blocks(items, item, item_text, block_chars):
        known = _Known(seed_hashes(texts)[0])
        if not known.sorted.size:
            continue

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total = np.zeros(known.sorted.size, np.int64)
            for b in batches:
                total += np.bincount(found_seeds([letters(t) for t in b.column(1).to_pylist()], known)[2], minlength=total.size)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["seed", "n"])

        got = source.mapInArrow(count, "seed long, n long").groupBy("seed").sum("n").toArrow()  # at most one row a seed of the block
        counts = np.zeros(known.sorted.size, np.int64)
        counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
        h, owner, place = rare_seeds(texts, known, counts, edited)
        if not h.size:
            continue
        rare = _Known(h)
        order = np.argsort(h, kind="stable")  # the places of one seed stand together
        first = np.searchsorted(h[order], rare.sorted)
        owner, place, ends = owner[order].astype(np.int32), place[order].astype(np.int32), np.append(first[1:], h.size)

        def search(batches: Iterator[pa.RecordBatch], rare=rare, first=first, ends=ends, owner=owner, place=place, texts=texts, ids=ids) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.column(0).to_pylist()
                bare = [letters(t) for t in b.column(1).to_pylist()]
                pairs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for t, p, r in zip(*(c.tolist() for c in found_seeds(bare, rare))):
                    for k in range(first[r], ends[r]):
                        pairs[t, int(owner[k])].append((p, int(place[k])))
                rows = []
                for (t, k), seeds in pairs.items():
                    a, d = texts[k], bare[t]
                    run, done, near_by = 0, set(), set(seeds) if edited else ()
                    for p, q in seeds:
                        if edited and (p - 1, q - 1) in near_by:  # same run as the seed before
                            continue
                        if p - q not in done or run < RUN:
                            run = max(run, shared_run(d, a, p, q))
                            done.add(p - q)
                    if run < RUN and not edited:
                        continue
                    same, score = best_place(a, d, {p - q for p, q in seeds})
                    if run >= RUN or same >= COVER * len(a):
                        rows.append((names[t], ids[k], run, round(same / len(a), 6), score))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows), kinds)], names=[doc, item, "run", "matched", "score"])

        kinds = [_arrow(doc_type), _arrow(item_type), pa.int32(), pa.float64(), pa.float64()]
        part = source.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.distinct()


def unsearched(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, letters) for each item no run can be found of: those with fewer than RUN letters, null texts as none."""
    given = items.select(item, text).where(f"{item} is not null").distinct()
    kind = given.schema[item].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(letters(t or "")) for t in b.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[item, "letters"])

    return given.mapInArrow(run, f"{item} {kind.simpleString()}, letters int").where(f"letters < {RUN}")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
