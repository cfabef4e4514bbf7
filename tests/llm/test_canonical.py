import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm.canonical import canonical, canonical_column, classes, on_the_page, same_on_the_page, transducer


def test_forms():
    for given_, want in [
        ("ｶﾞｷﾞ ﾊﾟ", "ガギ パ"), ("が", "が"), ("Ａｂ１！", "Ab1!"), ("é", "é"), ("е́", "é"), ("Аа Οο", "Aa Oo"), ("⼿羅ﬁ", "手羅fi"), ("a b　c d", "a b c d"),
        ("a​b﻿c­", "abc"), ("カ‍゙", "ガ"), ("", ""),
    ]:
        assert canonical(given_) == want, given_


def test_visible_differences_stay():
    for text in ("…", "①", "Ⓒ", "ー一", "カ力", "ニ二", "é", "a  b", "²", "株式会社㈱", "O0", "l1"):
        assert canonical(text) == text


def test_mapping_is_stable_and_free_of_conflicts():
    *_, table = transducer()
    assert all(table.get(out, out) == out for out in table.values())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", categories=("L", "M", "N", "P", "Z", "Cf"))))
def test_canonical_is_idempotent(text):
    once = canonical(text)
    assert canonical(once) == once


def test_lines_on_the_page():
    assert on_the_page("\n a \r\n\r\n b　\rc\n") == on_the_page("a\nb\nc") == "a\nb\nc"
    assert on_the_page(" ​\n") == ""


def test_pairs(spark):
    rows = [("b", "Ａ x"), ("a", "A x"), ("c", "A x"), ("c", "A x"), ("d", "A x"), ("e", "A  x"), ("f", None), (None, "A x"), ("g", ""), ("h", " "), ("a", "Ａ x")]
    df = spark.createDataFrame(rows, "n string, id string").selectExpr("n as seg", "id as form")
    got = {tuple(r) for r in same_on_the_page(df, "seg", "form").collect()}
    assert got == {("a", "b"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d"), ("a", "c")}
    assert same_on_the_page(df.limit(0), "seg", "form").count() == 0


def test_pairs_of_a_hot_class(spark):
    df = spark.range(400).selectExpr("cast(id as string) as n", "case when id = 7 then 'ｘ' else 'x' end as t")
    assert same_on_the_page(df, "n", "t").count() == 399


def test_columns(spark):
    df = spark.createDataFrame([(1, "Ａ", "Ｂ"), (2, None, "")], "i int, a string, b string")
    assert [tuple(r) for r in canonical_column(df, ["a"]).orderBy("i").collect()] == [(1, "A", "Ｂ"), (2, None, "")]
    assert unicodedata.normalize("NFC", canonical("ﾊﾟ")) == "パ"


def test_classes_over_both_columns(spark):
    rows = [("a", "ＡＢ", "AB"), ("b", "AB", None), ("b", "AB", None), ("c", "別", "\u200b"), (None, "AB", "AB")]
    got = {(r.id, r.field): (r["class"], r.links) for r in classes(spark.createDataFrame(rows, "id string, x string, class string"), "id", ["x", "class"]).collect()}
    assert set(got) == {("a", "x"), ("a", "class"), ("b", "x"), ("c", "x")}
    assert len({got[k][0] for k in got if k[0] != "c"}) == 1 and {got[k][1] for k in got if k[0] != "c"} == {1} and got["c", "x"][1] == 0
    assert classes(spark.createDataFrame([], "id string, x string"), "id", ["x"]).count() == 0
