"""Noise in text from scanned pages: found, and repaired into continuous paragraphs (problem 2)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.boilerplate import line_key
from pagewright.llm.canonical import canonical
from pagewright.runtime import cut, shipped_hashes, spread

# What a scanner reads in place of what is printed.
CONFUSIONS = [
    ("ー", "一"), ("エ", "工"), ("カ", "力"), ("ニ", "二"), ("ロ", "口"), ("ハ", "八"), ("タ", "夕"), ("ト", "卜"), ("チ", "千"), ("オ", "才"), ("ミ", "三"),
    ("シ", "ツ"), ("ツ", "シ"), ("ソ", "ン"), ("ン", "ソ"), ("ラ", "フ"), ("フ", "ラ"), ("ク", "ワ"), ("ワ", "ク"),
    ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("rn", "m"), ("m", "rn"), ("w", "vv"), ("vv", "w"), ("d", "cl"), ("cl", "d"), ("li", "h"), ("h", "li"), ("d", "q"), ("i", "l"), ("l", "i"),
    ("o", "0"), ("i", "1"), ("l", "1"), ("s", "5"), ("b", "8"), ("z", "2"), ("g", "9"), ("g", "6"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("2", "z"), ("9", "g"), ("6", "b"), ("0", "q"), ("9", "q"), ("2", "q"),
]
_PAIRS = set(CONFUSIONS)
#: Weight of an edit, as the factor by which the right form must be more frequent than the misread one (a distance
#: is the sum of their logarithms), and how often the right form must occur at least: for a character of another
#: kind inside a word or number, for one of the same kind, and for one digit in place of another.
WEIGHT = {"mixed": 2.0, "same": 8.0, "digit": 60.0}
LEAST = {"mixed": 2, "same": 8, "digit": 50}
#: Characters of a token; longer runs are no words.
MIN_TOKEN, MAX_TOKEN = 3, 64
#: Characters of a line that may be a page number with marks around it.
_PAGE_CHARS = 200
#: Lines of notices that may stand between the halves of a divided word.
_BETWEEN = 2
_KANJI = "一工力二口八夕卜千才三"
_MARKS = "-‐¬"
_BREAK = re.compile("\r\n|\r|\n")
_SOFT = re.compile("­(?=[ \t　]*(?:[\r\n]|$))")
_TOKENS = re.compile(
    rf"(?P<w>[0-9A-Za-zÀ-ÖØ-öø-ɏ]+(?:[-‐][A-Za-zÀ-ÖØ-öø-ɏ]+)*)|(?P<k>[{_KANJI}]*[ァ-ヺー][ァ-ヺー{_KANJI}]*)"
)
_NUMBER = re.compile(r"[0-9]+|(?=[0-9lIOoSBZ]*[0-9])[0-9lIOoSBZ]+")
_CONTEXT = re.compile(r" ?([^\W\d_]{1,2})")
_LEFT, _RIGHT = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)$"), re.compile(r"[ \t　]*([a-zà-öø-ÿ]+)")
_KANA = re.compile(r"[ぁ-ゖァ-ヺ]")
_SENTENCE_END, _LATIN_END = re.compile("[。．.!?！？…][」』）)\"”’】〉》]*$"), re.compile("[A-Za-zÀ-ÖØ-öø-ɏ0-9:;]$")
_ROW = re.compile(r"\S(?:[ 　]{2,}|\t)\S")
_BULLET = re.compile(r"\s*[・●◆■▶◇○□•]")
_PAGE = re.compile(r"[\W_]*(?:(?:[Pp]{1,2}|[Pp]age|PAGE|第)[.．]?)?[\W_]*(\d+|[〇零一二三四五六七八九十百千]+)(?:頁|ページ)?[\W_]*")
_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0}
_UNITS = {"十": 10, "百": 100, "千": 1000}


def number_of(line: str) -> int | None:
    """The number of a line that holds nothing but a number, in any digits, and marks around it."""
    m = _PAGE.fullmatch(line) if len(line) <= _PAGE_CHARS else None
    if not m:
        return None
    if m[1].isdecimal():
        return int(m[1])
    if not any(c in _UNITS for c in m[1]):
        return int("".join(str(_DIGITS[c]) for c in m[1]))
    total = part = 0
    for c in m[1]:
        if c in _UNITS:
            total, part = total + (part or 1) * _UNITS[c], 0
        else:
            part = _DIGITS[c]
    return total + part


def head_hash(book: str, page: int | None, key: str) -> int:
    """Identity of a running title: of a book, or of one of its pages."""
    return _signed(xxhash.xxh3_64_intdigest(f"{book}\n{page}\n{key}".encode("utf-8", "surrogatepass")))


def token_hash(token: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _paragraph_ends(line: str, following: str) -> bool:
    """Whether an empty line between two lines ends a paragraph."""
    return bool(_SENTENCE_END.search(line[-8:]) or (_LATIN_END.search(line[-8:]) and following.lstrip()[:1].isupper() and following.lstrip()[0] < "ɐ"))


class Reading:
    """One text read line by line: its page-number and title lines, its line-end hyphens, its running text.

    Lines that are just some other number are no running text either: words go on behind them. A text
    of several pages has the numbers of all of them. An empty line ends a paragraph unless the text
    goes on behind it: no sentence ends before it and no Latin line with a capital follows a Latin one.
    """

    def __init__(self, text: str, page: int | list[int] | None, is_head):
        lines = _BREAK.split(canonical(_SOFT.sub("¬", text)))
        full = [line for line in lines if line.strip()]
        apart = [not a.strip() for a, b in zip(["x", *lines], lines) if b.strip()]
        pages = {page} if isinstance(page, int) else set(page or ())
        count = [number_of(line) for line in full]
        numbers = [n is not None and n in pages for n in count]
        heads = [n is None and bool(k := line_key(line)) and is_head(k) for n, line in zip(count, full)]
        body, gap = [], False
        for line, n, own, h, after in zip(full, count, numbers, heads, apart):
            gap |= after  # also the empty lines around a line that is taken out
            if not own and not h:
                body.append((line, n, gap))
                gap = n is not None and gap
        self.page_number = any(numbers) and not all(numbers)
        self.header = any(heads) and bool(body)
        self.hyphens: list[tuple[str, str, bool]] = []  # left, right, certainly no hyphen of the word's own
        body = body or list(zip(full, count, apart))
        inner = [(line, after) for line, n, after in body if n is None]
        self.asides = [line for line, n, _ in body if n is not None] if inner else []
        self.marked = self._join(inner or [(line, after) for line, _, after in body], bool(_KANA.search(text)))

    def _join(self, body: list[tuple[str, bool]], kana: bool) -> str:
        out: list[str] = []
        lines, at, cut_in = [line for line, _ in body], 0, False
        while at < len(lines):
            line = lines[at].lstrip() if cut_in else lines[at]
            at += 1
            cut, cut_in = line.rstrip(), False
            if at == len(lines):
                out.append(cut)
                break
            nxt = lines[at]
            if cut and cut[-1] in _MARKS and (a := _LEFT.search(cut[-MAX_TOKEN - 1 : -1])):
                # notices may stand between the halves of a word
                to = next((k for k in range(at, min(at + _BETWEEN + 1, len(lines))) if _RIGHT.match(lines[k])), None)
                if to is not None:
                    self.hyphens.append((a[1], _RIGHT.match(lines[to])[1], cut[-1] == "¬"))
                    out.append(cut[:-1] + f"\ue000{len(self.hyphens) - 1}\ue001")
                    self.asides += lines[at:to]
                    at, cut_in = to, True
                    continue
            if body[at][1] and _paragraph_ends(cut, nxt):
                out.append(cut + "\n\n")
                continue
            if _ROW.search(line) or _ROW.search(nxt) or _BULLET.match(nxt) or _BULLET.match(line):
                out.append(cut + "\n")
                continue
            cut_in = True
            a, b = cut[-1:], nxt.lstrip()[:1]
            latin = a.isalpha() and a < "ɐ" and b.isalpha() and b < "ɐ"
            out.append(cut + (" " if latin or not kana else ""))
        return "".join(out)

    def running(self, own_hyphen=lambda left, right, sure: False, asides: bool = False) -> str:
        """The text in continuous lines; divided words are joined, compounds keep their hyphen; asides come last."""

        def join(m: re.Match) -> str:
            left, right, sure = self.hyphens[int(m[1])]
            return "-" if own_hyphen(left, right, sure) else ""

        line = re.sub("\ue000(\\d+)\ue001", join, self.marked) if self.hyphens else self.marked
        return "\n".join([line, *self.asides]) if asides else line


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(token with its kind, start, end): words `w`, katakana words `k`, numbers `n` with what follows, compounds `c`."""
    for m in _TOKENS.finditer(text):
        if m.lastgroup == "k":
            if MIN_TOKEN <= m.end() - m.start() <= MAX_TOKEN:
                yield "k" + m[0], m.start(), m.end()
            continue
        w = m[0]
        if len(w) > MAX_TOKEN:
            continue
        if _NUMBER.fullmatch(w):
            if c := _CONTEXT.match(text, m.end()):
                yield f"n{w.lower()}|{c[1].lower()}", m.start(), m.end()
        elif "-" in w or "‐" in w:
            yield "c" + w.lower().replace("‐", "-"), m.start(), m.end()
            at = m.start()
            for part in re.split("[-‐]", w):
                if len(part) >= MIN_TOKEN:
                    yield "w" + part.lower(), at, at + len(part)
                at += len(part) + 1
        elif len(w) >= MIN_TOKEN:
            yield "w" + w.lower(), m.start(), m.end()


@lru_cache(maxsize=1 << 16)
def misread_as(right: str, seen: str) -> tuple[float, int] | None:
    """Weighted edit distance: (least product of the weights of confusions that turn ``right`` into ``seen``, LEAST of the rarest of them); None if none do.

    Both begin with their kind, which is no part of the word. Equal ends are left out but for one
    character, as a changed run may repeat its neighbour (`rn`, `vv`).
    """
    i, n = 0, min(len(right), len(seen))
    while i < n and right[i] == seen[i]:
        i += 1
    start = max(1, i - 1)
    j = 0
    while j < n - start and right[-1 - j] == seen[-1 - j]:
        j += 1
    j = max(0, j - 1)
    ends = (len(right) - j, len(seen) - j)
    layers = {2 * start: {(start, start): (1.0, 0)}}
    for t in range(2 * start, sum(ends) + 1):
        if not layers:
            return None
        for (a, b), (weight, least) in layers.pop(t, {}).items():
            if (a, b) == ends:
                return (weight, least) if least else None
            for p, q in ((1, 1), (1, 2), (2, 1)):
                x, y = right[a : a + p], seen[b : b + q]
                if a + p > ends[0] or b + q > ends[1]:
                    continue
                if x == y:
                    w, m = 1.0, 0
                elif (x, y) in _PAIRS:
                    kind = "mixed" if _mixed(x, y, seen) else "same"
                    w, m = WEIGHT[kind], LEAST[kind]
                elif p == q == 1 and x.isdigit() and y.isdigit():
                    w, m = WEIGHT["digit"], LEAST["digit"]
                else:
                    continue
                layer, to = layers.setdefault(t + p + q, {}), (a + p, b + q)
                layer[to] = min(layer.get(to, (float("inf"), 0)), (weight * w, max(least, m)))
    return None


def _mixed(x: str, y: str, seen: str) -> bool:
    """Whether the wrong character is of another kind than the word or number it stands in."""
    if seen[0] == "n":
        return y.isalpha()
    return y.isdigit() != x.isdigit() or y in _KANJI


def _pages(df: DataFrame, page: str) -> Column:
    """The pages of a text in order, from a column of one page or of an array of them; null if there is none."""
    c = F.col(f"`{page}`")
    pages = c.cast("array<int>") if df.schema[page].dataType.typeName() == "array" else F.array(c.cast("int"))
    pages = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    return F.when(F.size(pages) > 0, pages)


def _flat(df: DataFrame, ids: list[str], book: str, page: str, text: str) -> DataFrame:
    cols = [F.col(f"`{c}`").alias(c) for c in ids]
    return df.select(*cols, F.col(f"`{book}`").cast("string").alias("__book"), _pages(df, page).alias("__page"), F.col(f"`{text}`").cast("string").alias("__text"), F.lit(None).cast("array<bigint>").alias("__heads")).where("__text is not null and __text <> ''").transform(spread, *ids)


def head_hashes(titles: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, page, h): identities of running titles, those of books with a null page. titles: (book, title); chapters: (book, page, title)."""
    both = titles.select("book", F.lit(None).cast("int").alias("page"), "title").unionByName(chapters.select("book", F.col("page").cast("int").alias("page"), "title"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [(k, p, head_hash(k, p, key)) for k, p, t in zip(*(c.to_pylist() for c in b.columns)) if (key := line_key(t))]
            columns = zip(*h) if h else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))], names=["book", "page", "h"])

    return both.where("book is not null and title is not null").distinct().mapInArrow(run, "book string, page int, h long")


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows with the titles of their book and page at hand, for when there are too many to ship: a few values a row."""
    of_page = heads.where("page is not null").groupBy(F.col("book").alias("__book"), F.col("page").alias("__page")).agg(F.collect_set("h").alias("__p"))
    of_book = heads.where("page is null").groupBy(F.col("book").alias("__book")).agg(F.collect_set("h").alias("__b"))
    none = F.array().cast("array<bigint>")
    pages = rows.select("__book", F.col("__page").alias("__all")).distinct().withColumn("__page", F.explode("__all")).join(of_page, ["__book", "__page"])
    pages = pages.groupBy("__book", F.col("__all").alias("__page")).agg(F.array_distinct(F.flatten(F.collect_list("__p"))).alias("__p"))
    joined = rows.join(pages, ["__book", "__page"], "left").join(of_book, "__book", "left")
    return joined.withColumn("__heads", F.concat(F.coalesce("__p", none), F.coalesce("__b", none))).select(*rows.columns)


class Lexicon:
    """Corpus counts of tokens, the compounds among them, and the misread tokens with their candidates."""

    def __init__(self, rows: DataFrame, heads: DataFrame):
        self.heads = cut(heads.distinct())
        ship = self.ship = shipped_hashes(self.heads, "h")
        self.rows = rows = rows if ship is not None else _with_heads(rows, self.heads)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heads_ = _shipped(ship)
            for b in batches:
                total: Counter = Counter()
                once: Counter = Counter()
                for book, page, text, own, copies in zip(*(c.to_pylist() for c in b.columns)):
                    r = Reading(text, page, _heads(heads_, book, page, own))
                    here = Counter(t for t, _, _ in tokens(r.running(lambda *_: True)))
                    here.update("w" + (a + c).lower() for a, c, _ in r.hyphens)
                    once.update(here)
                    for t, n in here.items():
                        total[t] += n * copies
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([once[t] for t in total], pa.int64())], names=["token", "n", "once"])

        # each distinct text is read once, as on the first of its pages
        texts = rows.groupBy("__text").agg(F.min(F.struct("__book", "__page", "__heads")).alias("at"), F.count("*").alias("copies"))
        seen = texts.select("at.__book", "at.__page", "__text", "at.__heads", "copies").mapInArrow(count, "token string, n long, once long")
        self.counts = cut(seen.groupBy("token").agg(F.sum("n").alias("n"), F.sum("once").alias("once")))
        joined = self.counts.select(F.col("token").alias("word"), F.col("n").alias("whole"))
        c = self.counts.where("token like 'c%'").withColumn("word", F.concat(F.lit("w"), F.regexp_replace(F.substring("token", 2, 1 << 30), "-", "")))
        #: compounds whose own hyphen it is: written with it more often than without
        self.compounds = c.join(joined, "word", "left").where("n > coalesce(whole, 0)").select(F.substring("token", 2, 1 << 30).alias("compound"))

    def misread(self) -> DataFrame:
        """(h, token, n, right, right_n, weight): tokens that are misread forms, each with every right form that may be meant.

        Deletions of one character and of two neighbouring ones, of frequent and of suspect tokens
        alike, meet on equal keys; pairs are kept if known confusions separate them and the right
        form is frequent enough for their weight, over all rows or over distinct texts: copies of a
        page do not hide what is misread on it. Counts are those of the two that speak for it.
        """
        words = self.counts.where("substring(token, 1, 1) in ('w', 'k', 'n')").withColumn("len", F.length("token"))
        drop = lambda n: F.transform(F.sequence(F.lit(2), F.col("len") - n + 1), lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring(F.col("token"), i + n, F.lit(1 << 30))))
        keys = F.array_distinct(F.concat(drop(1), F.when(F.col("len") > 2, drop(2)).otherwise(F.array().cast("array<string>"))))
        index = cut(words.select("token", "n", "once", F.explode(keys).alias("key")))
        a = index.where(F.col("n") >= min(LEAST.values())).select("key", F.col("token").alias("right"), F.col("n").alias("right_n"), F.col("once").alias("right_once"))
        b = index.select("key", "token", "n", "once")
        least = min(WEIGHT.values())
        pairs = a.join(b, "key").where((F.col("right") != F.col("token")) & ((F.col("right_n") >= least * F.col("n")) | (F.col("right_once") >= least * F.col("once")))).select("right", "right_n", "right_once", "token", "n", "once").distinct()

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                got = []
                for right, many, texts, seen, n, once in zip(*(c.to_pylist() for c in x.columns)):
                    if found := misread_as(right, seen):
                        weight, needed = found
                        speak = [(m / k, m, k) for m, k in ((many, n), (texts, once)) if m >= needed and m >= weight * k]
                        if speak:
                            _, m, k = max(speak)
                            got.append((token_hash(seen), seen, k, right, m, weight))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["h", "token", "n", "right", "right_n", "weight"])

        return cut(pairs.mapInArrow(verify, "h long, token string, n long, right string, right_n long, weight double"))


class _Shipped:
    """Membership in a sorted array of hashes, most of it decided by a small bit table."""

    _MASK = (1 << 22) - 1

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        table = np.zeros(self._MASK + 1, np.uint8)
        table[hashes & self._MASK] = 1
        self.table = table.tobytes()

    def __contains__(self, h: int) -> bool:
        if not self.table[h & self._MASK]:
            return False
        at = np.searchsorted(self.hashes, h)
        return bool(at < self.hashes.size and self.hashes[at] == h)


def _shipped(hashes: np.ndarray | None) -> _Shipped | None:
    return None if hashes is None else _Shipped(hashes)


def _heads(ship: _Shipped | None, book: str | None, pages: list[int] | None, own: list[int] | None):
    """Whether a line's key is a running title of this book or of one of these pages."""
    known = own or () if ship is None else ship
    if book is None:
        return lambda key: False
    return lambda key: head_hash(book, None, key) in known or any(head_hash(book, p, key) in known for p in pages or ())


def find_noise(df: DataFrame, ids: list[str], book: str, page: str, text: str, titles: DataFrame, chapters: DataFrame, lexicon: Lexicon | None = None, detail: bool = False) -> DataFrame:
    """(ids, noise) for each text with noise of a kind: hyphen, misread, header, page_number.

    With ``detail`` also token and right: the misread token and its right form. ``titles`` has the
    running titles of books (book, title), ``chapters`` those of pages (book, page, title). Null and
    empty texts have no noise; a null page has no page number, a null book no titles; equal rows give
    one row, an empty table none. ``page`` may hold an array: all pages the text is from.

    A token stays as it is if, where it stands, it is likelier than every right form (see _by_context).
    """
    lex = lexicon or Lexicon(_flat(df, ids, book, page, text), head_hashes(titles, chapters))
    wrong = lex.misread()
    seen = _scan(lex.rows, ids, lex, wrong)
    plain = seen.where("noise in ('page_number', 'header') or (noise = 'hyphen' and token is null)")
    compounds = lex.compounds.select(F.col("compound").alias("token")).distinct()
    divided = seen.where("noise = 'hyphen' and token is not null").join(compounds, "token", "left_anti")
    chosen = _by_context(seen.where("noise = 'misread'").select(*ids, "token", "prev", "copy").distinct(), wrong, lex, ids, detail)
    out = [d.select(*ids, "noise", "token", F.lit(None).cast("string").alias("right")) for d in (plain, divided)] + [chosen.select(*ids, F.lit("misread").alias("noise"), "token", "right")]
    whole = out[0].unionByName(out[1]).unionByName(out[2])
    return (whole if detail else whole.select(*ids, "noise")).distinct()


def _scan(rows: DataFrame, ids: list[str], lex: Lexicon, wrong: DataFrame) -> DataFrame:
    """One pass over the texts: (ids, noise, token, prev, copy), the last two what stands before a misread token and the identity of its text."""
    bad, ship = shipped_hashes(wrong, "h"), lex.ship
    schema = rows.select(*ids).schema.add("noise", "string").add("token", "string").add("prev", "string").add("copy", "long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        known, heads = _shipped(bad), _shipped(ship)
        for b in batches:
            out: list[tuple] = []
            for i, (bk, pg, t, own) in enumerate(zip(*(c.to_pylist() for c in b.columns[-4:]))):
                r = Reading(t, pg, _heads(heads, bk, pg, own))
                out += [(i, "page_number", None, None, None)] * r.page_number + [(i, "header", None, None, None)] * r.header
                out += [(i, "hyphen", None if sure else f"{x}-{y}".lower(), None, None) for x, y, sure in r.hyphens]
                line, copy = r.running(lambda *_: False), None
                for tok, at, _ in tokens(line):
                    if (hit := memo.get(tok)) is None:
                        hit = memo[tok] = known is None or token_hash(tok) in known
                    if hit:
                        copy = copy if copy is not None else token_hash(t)
                        out.append((i, "misread", tok, _before(line, at), copy))
            out = list(dict.fromkeys(out))
            if out:
                row, *columns = zip(*out)
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([c.take(take) for c in b.columns[:-4]] + [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=schema.names)

    return cut(rows.mapInArrow(scan, schema))


def _before(line: str, at: int) -> str:
    """What stands before a place, blanks aside: the Latin word or number; where there is none, as in text without word breaks, two characters."""
    end = at
    while end and line[end - 1].isspace():
        end -= 1
    start = end
    while start and end - start <= MAX_TOKEN and (line[start - 1].isascii() or "À" <= line[start - 1] <= "ɏ") and line[start - 1].isalnum():
        start -= 1
    return line[start:end].lower() if end < at and start < end else line[max(0, end - 2) : end]


def _bigrams(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(right, prev, together): in how many different texts a token stands behind ``prev``, for the ``wanted`` pairs at least."""

    def identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(*(c.to_pylist() for c in b.columns)))
            yield pa.RecordBatch.from_arrays([pa.array([token_hash(r) for r, _ in pairs], pa.int64()), pa.array([token_hash(f"{p}\n{r}") for r, p in pairs], pa.int64())], names=["token", "pair"])

    known = cut(wanted.select("right", "prev").mapInArrow(identities, "token long, pair long"))
    rights, both = shipped_hashes(known, "token"), shipped_hashes(known, "pair")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        tokens_, pairs = _shipped(rights), _shipped(both)
        for b in batches:
            total: Counter = Counter()
            for t in b.column(0).to_pylist():
                line, here = canonical(t), set()
                for tok, at, _ in tokens(line):
                    if (hit := memo.get(tok)) is None:
                        hit = memo[tok] = tokens_ is None or token_hash(tok) in tokens_
                    if hit:
                        here.add((tok, _before(line, at)))
                total.update(x for x in here if pairs is None or token_hash(f"{x[1]}\n{x[0]}") in pairs)
            if total:
                names = list(zip(*total))
                yield pa.RecordBatch.from_arrays([pa.array(names[0], pa.string()), pa.array(names[1], pa.string()), pa.array(list(total.values()), pa.int64())], names=["right", "prev", "n"])

    counted = rows.select("__text").distinct().mapInArrow(count, "right string, prev string, n long")
    return counted.groupBy("right", "prev").agg(F.sum("n").alias("together"))


def _by_context(tokens_: DataFrame, wrong: DataFrame, lex: Lexicon, ids: list[str], rivals: bool) -> DataFrame:
    """(ids, token, right) for each misread token: the likeliest right form where it stands, unless the token itself is likelier.

    A form is the likelier the more frequent it is, the smaller its distance and the more texts have it
    behind the same word (the token's own text aside). Counts of what stands together are needed only
    where the token stands behind that word in another text too or, with ``rivals``, has several right forms.
    """
    here = tokens_.groupBy("token", "prev").agg((F.countDistinct("copy") - 1).alias("others"))
    several = wrong.groupBy("token").agg((F.countDistinct("right") > 1).alias("several"))
    ways = cut(here.join(wrong, "token").join(several, "token").select("token", "prev", "others", "n", "right", "right_n", "weight", "several"))
    open_ = F.col("others") > 0
    wanted = cut(ways.where(open_ | F.col("several") if rivals else open_).select("right", "prev").distinct())
    if not wanted.isEmpty():
        ways = ways.join(_bigrams(lex.rows, wanted), ["right", "prev"], "left")
    else:
        ways = ways.withColumn("together", F.lit(None).cast("long"))
    plus = lambda c: 1 + F.coalesce(F.col(c), F.lit(0))
    scored = ways.select("token", "prev", "right", "right_n", (F.col("right_n") / F.col("weight") * plus("together")).alias("score"), (F.col("n") * plus("others")).alias("own"))
    best = scored.groupBy("token", "prev").agg(F.max(F.struct("score", "right_n", "right")).alias("best"), F.max("own").alias("own")).where("best.score >= own").select("token", "prev", "best.score", "best.right")
    # a row may hold the token in several places: one right form for all of them
    return tokens_.join(best, ["token", "prev"]).groupBy(*ids, "token").agg(F.max(F.struct("score", "right"))["right"].alias("right"))


def repair(df: DataFrame, ids: list[str], book: str, page: str, text: str, titles: DataFrame, chapters: DataFrame, to: str = "repaired") -> DataFrame:
    """``ids`` and the repaired text of each row with text: continuous paragraphs without the noise.

    Running titles and page numbers are taken out, divided words joined (compounds keep their own
    hyphen), line breaks inside paragraphs closed, paragraphs set apart by an empty line, misread tokens replaced. Of several right forms
    the likeliest wins (see _by_context).
    Null and empty texts give no row; repeated rows give one row.
    """
    lex = Lexicon(_flat(df, ids, book, page, text).distinct(), head_hashes(titles, chapters))
    rows = lex.rows
    detail = find_noise(df, ids, book, page, text, titles, chapters, lex, detail=True).where("noise in ('misread', 'hyphen')")
    ship = lex.ship
    chosen = detail.where("right is not null")
    per_row = chosen.groupBy(*ids).agg(F.map_from_entries(F.collect_set(F.struct("token", "right"))).alias("__fixes"))
    own = detail.where("noise = 'hyphen' and token is not null").groupBy(*ids).agg(F.collect_set("token").alias("__divided"))
    joined = rows.join(per_row, ids, "left").join(own, ids, "left")
    schema = rows.select(*ids).schema.add(to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = _shipped(ship)
        for b in batches:
            out = []
            for bk, pg, t, own, fix, divided in zip(*(c.to_pylist() for c in b.columns[-6:])):
                r = Reading(t, pg, _heads(heads, bk, pg, own))
                apart = set(divided or ())
                line = r.running(lambda x, y, sure: not sure and f"{x}-{y}".lower() not in apart, asides=True)
                out.append(_replace(line, dict(fix or ())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-6], pa.array(out, pa.string())], names=schema.names)

    return joined.select(*ids, "__book", "__page", "__text", "__heads", "__fixes", "__divided").mapInArrow(run, schema)


def _replace(line: str, fixes: dict[str, str]) -> str:
    if not fixes:
        return line
    parts, last = [], 0
    for tok, a, b in tokens(line):
        if tok in fixes and a >= last:
            seen, right = line[a:b], fixes[tok][1:].split("|")[0]
            if seen.isupper() and not seen.isdigit() and right.isalpha():
                right = right.upper()
            elif seen[:1].isupper() and right[:1].isalpha() and len(right) > 1:
                right = right[0].upper() + right[1:]
            parts += [line[last:a], right]
            last = b
    return "".join(parts) + line[last:]
