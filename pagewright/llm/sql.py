"""SQL the text queries are compared with, where SQL can express them over whole tables."""

from __future__ import annotations

import unicodedata

from pagewright.llm import boilerplate, canonical, leakage


def _mapped(column: str, single: dict[str, str], several: dict[str, str], gone: str = "") -> str:
    """A column with characters replaced or taken out, in composed form."""
    text = lambda t: "'" + t.replace("'", "''") + "'"
    for a, b in several.items():
        column = f"replace({column}, {text(a)}, {text(b)})"
    return f"nfc_normalize(translate({column}, {text(''.join(single) + gone)}, {text(''.join(single.values()))}))"


def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility forms of one character, and of several in the blocks of punctuation, letter-like and squared signs and ligatures."""
    forms = {c: f for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0xFFF0)]) if (f := unicodedata.normalize("NFKC", c)) != c}
    blocks = [range(0xA0, 0x100), range(0x2000, 0x2150), range(0x3200, 0x3400), range(0xFB00, 0xFB07)]
    return {c: f for c, f in forms.items() if len(f) == 1}, {c: f for c, f in forms.items() if len(f) > 1 and any(ord(c) in b for b in blocks)}


def _on_the_page(column: str) -> str:
    table = canonical.transducer()[3]
    one = {k: v for k, v in table.items() if len(k) == 1 and len(v) == 1 and k not in "ﾞﾟ"} | {"ﾞ": "゙", "ﾟ": "゚"}
    return _mapped(column, one, {k: v for k, v in table.items() if len(k) == 1 and len(v) > 1}, "".join(k for k, v in table.items() if len(k) == 1 and not v))


_HIDDEN = r"[\s\x{AD}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FE00}-\x{FE0F}\x{FEFF}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_KEY = f"regexp_replace(regexp_replace({_mapped('line', *_compatible())}, '{_HIDDEN}', '', 'g'), '^\\p{{Nd}}+|\\p{{Nd}}+$', '', 'g')"
_LETTERS = lambda column: f"regexp_replace(lower({_mapped(column, *_compatible())}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_R, _S = leakage.RUN, leakage.SEED

_NEAR = f"""with d as (select distinct doc_id, {_LETTERS("text")} as t from documents where text is not null), i as (select distinct item_id, {_LETTERS("text")} as t from test_items where text is not null),
 b as (select item_id, t, substr(t, k, {_S}) as part from (select item_id, t, unnest(range(1, length(t) - {_S} + 2, {_S})) as k from i where length(t) >= {_R})),
 near as (select distinct d.doc_id, d.t as doc, b.item_id, b.t as item from b join d on contains(d.t, b.part)),
 start as (select *, substr(item, k, {_R}) as run from (select *, unnest(range(1, length(item) - {_R} + 2)) as k from near))"""

SQL = {
    "p4_found": f"""with t as (select distinct segment_id, raw_text from segments where segment_id is not null and raw_text is not null),
 f as (select segment_id, raw_text, array_to_string(list_filter(list_transform(regexp_split_to_array({_on_the_page("raw_text")}, '\\r\\n|\\r|\\n'), lambda l: trim(l)), lambda l: l <> ''), chr(10)) as form from t)
 select distinct a.segment_id as segment_id_1, b.segment_id as segment_id_2 from f a join f b on a.form = b.form and a.segment_id < b.segment_id where a.raw_text <> b.raw_text and a.form <> ''""",
    "p4_classes": f"""with t as (select distinct segment_id, 'raw_text' as field, raw_text as x from segments where segment_id is not null and raw_text is not null union select distinct segment_id, 'normalized_text', normalized_text from segments where segment_id is not null and normalized_text is not null),
 f as (select *, array_to_string(list_filter(list_transform(regexp_split_to_array({_on_the_page("x")}, '\\r\\n|\\r|\\n'), lambda l: trim(l)), lambda l: l <> ''), chr(10)) as form from t), c as (select form, count(distinct x) - 1 as links from f where form <> '' group by 1)
 select distinct segment_id, field, left(sha256(form), 32) as class, links from f join c using (form)""",
    "p4_canonical": f"""with s as (select distinct segment_id, book_id, raw_text, normalized_text from segments) select segment_id, book_id, {_on_the_page("raw_text")} as raw_text, {_on_the_page("normalized_text")} as normalized_text from s""",
    "p6_found": f"""with s as (select distinct segment_id, book_id, raw_text from segments where segment_id is not null and book_id is not null), n as (select book_id, count(distinct segment_id) as docs from s group by 1),
 l as (select segment_id, book_id, lines[i] as line, cast(i - 1 as int) as line_no from (select segment_id, book_id, string_split(raw_text, chr(10)) as lines, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) as i from s where raw_text is not null)),
 k as (select segment_id, book_id, line_no, {_KEY} as key from l), c as (select book_id, key, count(distinct segment_id) as n from k where length(key) >= {boilerplate.MIN_CHARS} group by 1, 2)
 select distinct segment_id, line_no from k join c using (book_id, key) join n using (book_id) where c.n >= {boilerplate.MIN_DOCS} and c.n >= {boilerplate.MIN_SHARE} * docs""",
    "p8_found": f"{_NEAR} select distinct doc_id, item_id from start where contains(doc, run)",
    "p8_items": f"""{_NEAR}, longer as (select doc_id, doc, item_id, substr(item, k, n) as run, cast(n as int) as n from (select *, unnest(range({_R}, length(item) - k + 2)) as n from start where contains(doc, run)))
 select item_id, count(distinct doc_id) as docs, max(n) as longest_run from longer where contains(doc, run) group by 1""",
    "p8_short": f"with i as (select distinct item_id, cast(length({_LETTERS('text')}) as int) as n from test_items where item_id is not null) select item_id, coalesce(n, 0) as letters from i where coalesce(n, 0) < {_R}",
}
