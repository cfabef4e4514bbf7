import numpy as np
import pytest

from pagewright.llm import ocrnoise as oc

NONE = lambda key: False


def read(text, page=None, heads=()):
    return oc.Reading(text, page, lambda k: k in heads)


def test_numbers_of_pages():
    for line, n in [("12", 12), (" - 12 - ", 12), ("〔１２〕", 12), ("一二", 12), ("十二", 12), ("百二十", 120), ("一〇三", 103), ("p.7", 7), ("第7頁", 7), ("[7]", 7), ("7 章", None), ("", None), ("---", None), ("x7", None)]:
        assert oc.number_of(line) == n, line


def test_lines_that_are_no_text():
    r = read("12 鉄の章\n夜の砦で\n12", 12, {"鉄の章"})
    assert (r.page_number, r.header, r.running()) == (True, True, "夜の砦で")
    r = read("鉄の章", 12, {"鉄の章"})
    assert (r.page_number, r.header, r.running()) == (False, False, "鉄の章")
    assert not read("12", 12).page_number and not read("13\n夜", 12).page_number and not read("12\n夜").page_number
    assert read("ダメー\n99\nジを", 12).running() == "ダメージを"  # another number stays an aside
    assert read("ダメー\n99\nジを", 12).running(asides=True) == "ダメージを\n99"


def test_divided_words():
    own = lambda a, b, sure: f"{a}-{b}" == "moss-grown" and not sure
    assert read("the chro-\nnicle").running(own) == read("the chro­\nnicle").running(own) == read("the chro‐ \n\n nicle").running(own) == "the chronicle"
    assert read("a moss-\ngrown gate").running(own) == "a moss-grown gate" and read("a moss¬\ngrown gate").running(own) == "a mossgrown gate"
    for text in ("the gate -\nor not", "夜—\nthe", "12-\nfold", "Jor-\nGarfal", "end-\n"):
        assert read(text).hyphens == []
    assert read("chro-\nAs told to X\nnicle").hyphens == [("chro", "nicle", False)]
    assert read("chro-\n12\nnicle", 12).running() == "chronicle"


def test_line_breaks():
    assert read("ゲームマス\nターが").running() == "ゲームマスターが"
    assert read("the keeper\nof it").running() == "the keeper of it" and read("夜のSol\nTar名").running() == "夜のSol Tar名"
    assert read("力  3\n技  4\n本文").running() == "力  3\n技  4\n本文" and read("前文\n・札\n●札").running() == "前文\n・札\n●札"


def test_weighted_distance():
    for right, seen, kinds in [
        ("kカード", "k力ード", ["mixed"]), ("kシナリオ", "kツナリオ", ["same"]), ("wburning", "wbuming", ["same"]), ("wgamemaster", "wgarnemaster", ["same"]), ("wtoward", "wt0ward", ["mixed"]),
        ("whollow", "whollovv", ["same"]), ("n25|点を", "n2s|点を", ["mixed"]), ("n21|点を", "n71|点を", ["digit"]), ("kカード", "kカート", None), ("wgate", "wgates", None), ("wgate", "wgate", None),
        ("wcheese", "wehccse", ["same"] * 3), ("n10|点", "nlo|点", ["mixed", "mixed"]), ("wclone", "wdonc", ["same", "same"]), ("wlittle", "w1itt1e", ["mixed", "mixed"]), ("wx", "kx", None),
    ]:
        want = kinds and (float(np.prod([oc.WEIGHT[k] for k in kinds])), max(oc.LEAST[k] for k in kinds))
        assert oc.misread_as(right, seen) == want, (right, seen)


KIND = "sid int, rid string, book string, page int, text string"


def noise(spark, rows, titles=(), chapters=()):
    df = spark.createDataFrame(rows, KIND)
    return oc.find_noise(df, ["sid", "rid"], "book", "page", "text", *heads(spark, titles, chapters))


def heads(spark, titles, chapters):
    return spark.createDataFrame(list(titles), "book string, title string"), spark.createDataFrame(list(chapters), "book string, page int, title string")


@pytest.fixture(scope="module")
def rows():
    good = [(i, "r", "b", 1, "ダメージを25点受けて、この章のカードを引く。") for i in range(20)] + [(100 + i, "r", "b", 1, "the keeper mends a moss-grown gateway at once") for i in range(20)]
    bad = [(900, "r", "b", 3, "ダメ一ジを2S点受けて、\n鉄の章\n終わり。"), (901, "r", "b", 3, "the keeper mcnds a moss-\ngrown gate-\nway"), (902, "r", "b", 4, "鉄の章\nカードを"), (903, "q", "b", 4, "The Book 4\nカード\n〔4〕")]
    return good + bad + bad[:1] + [(904, "r", None, None, None), (905, "r", None, None, ""), (906, "r", None, None, "カード")]


def test_found(spark, rows):
    got = {tuple(r) for r in noise(spark, rows, [("b", "The Book"), (None, "x"), ("b", None)], [("b", 3, "鉄の章"), ("b", 3, None)]).collect()}
    assert got == {
        (900, "r", "misread"), (900, "r", "header"), (901, "r", "misread"), (901, "r", "hyphen"), (903, "q", "header"), (903, "q", "page_number"),
    }


def test_found_without_shipped_hashes(spark, rows, monkeypatch):
    more = ([("b", "The Book")], [("b", 3, "鉄の章")])
    want = {tuple(r) for r in noise(spark, rows, *more).collect()}
    monkeypatch.setattr(oc, "shipped_hashes", lambda *_: None)
    assert {tuple(r) for r in noise(spark, rows, *more).collect()} == want and len(want) == 6


def test_repaired(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    out = oc.repair(df, ["sid", "rid"], "book", "page", "text", *heads(spark, [("b", "The Book")], [("b", 3, "鉄の章")]))
    got = {r.sid: r.repaired for r in out.where("sid >= 900").collect()}
    assert got == {900: "ダメージを25点受けて、終わり。", 901: "the keeper mends a moss-grown gateway", 902: "鉄の章カードを", 903: "カード", 906: "カード"}
    assert out.count() == 45


def test_empty_table(spark):
    assert noise(spark, []).count() == 0


def test_neighbours_choose_between_right_forms(spark):
    rows = [(i, "r", "b", 1, "to hold it") for i in range(20)] + [(50 + i, "r", "b", 1, "my hoid is") for i in range(12)] + [(90, "r", "b", 1, "my ho1d is"), (91, "r", "b", 1, "go ho1d it")]
    out = oc.repair(spark.createDataFrame(rows, KIND), ["sid", "rid"], "book", "page", "text", *heads(spark, [], []))
    assert {r.sid: r.repaired for r in out.where("sid >= 90").collect()} == {90: "my hoid is", 91: "go hold it"}


def test_very_long_texts(spark):
    rows = [(1, "r", "b", 1, "-" * 100_000), (2, "r", "b", 1, "a" * 100_000 + "-\nb"), (3, "r", "b", 1, "ア" * 100_000), (4, "r", "b", 1, "word " * 50_000), (5, "r", "b", 1, "1" * 50_000)]
    assert {tuple(r) for r in noise(spark, rows, [("b", "x")]).collect()} == {(2, "r", "hyphen")}


def test_copies_do_not_hide_a_misread(spark):
    good = [(i, "r", "b", i, f"row {chr(97 + i) * 4} of the gateway") for i in range(20)]
    bad = [(100 + i, "r", "b", 50 + i % 2, "the gatcway is shut") for i in range(30)]
    assert {tuple(r) for r in noise(spark, good + bad).collect()} == {(100 + i, "r", "misread") for i in range(30)}


def test_paragraphs_over_empty_lines():
    assert read("夜は終わる。\n\n朝が\n来た").running() == "夜は終わる。\n\n朝が来た" and read("夜の砦\n\nで休む").running() == "夜の砦で休む"
    assert read("It ends.\n\nthe gate\n\nof it\n\nNow").running() == "It ends.\n\nthe gate of it\n\nNow"
    assert read("終わる。\n\n12\n\n次の", 12).running() == "終わる。\n\n次の"


def test_texts_of_several_pages(spark):
    df = spark.createDataFrame([(1, "r", "b", [71, 72, 71], "夜の\n— 72 —\n鉄の章\n砦で休む。"), (2, "r", "b", [None], "夜"), (3, "r", "b", None, "朝")], "sid int, rid string, book string, page array<int>, text string")
    out = oc.repair(df, ["sid", "rid"], "book", "page", "text", *heads(spark, [], [("b", 72, "鉄の章")]))
    assert {r.sid: r.repaired for r in out.collect()} == {1: "夜の砦で休む。", 2: "夜", 3: "朝"}


def test_both_texts_of_segments(spark, tmp_path):
    from pagewright.llm.queries import p2_segments

    span = "array<struct<page int, rect_id string, start int, end int>>"
    rows = [("s1", "b", ["鉄の章"], [(1, "r", 0, 9), (2, "r", 0, 9)], "夜の\n- 2 -\n砦", "夜の\n2\n砦に"), ("s2", "b", None, None, "朝", "朝"), ("s3", "b", None, None, "朝", None), ("s4", "b", ["鉄の章"], [(3, "r", 0, 9)], "夜の\n3\n砦で\n休む", "夜の3\n砦で　休む")]
    spark.createDataFrame(rows, f"segment_id string, book_id string, section_path array<string>, source_spans {span}, raw_text string, normalized_text string").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([("b", "本")], "book_id string, title string").write.parquet(f"{tmp_path}/books.parquet")
    assert {tuple(r) for r in p2_segments(spark, str(tmp_path)).collect()} == {("s1", "夜の砦", "夜の砦に"), ("s2", "朝", "朝"), ("s3", "朝", None), ("s4", "夜の砦で休む", "夜の砦で休む")}


def test_the_word_before_chooses_with_and_without_shipped_pairs(spark, monkeypatch):
    rows = [(i, "r", "b", 1, f"so hold it {i}") for i in range(20)] + [(50 + i, "r", "b", 1, f"go hoid is {i}") for i in range(12)] + [(90, "r", "b", 1, "go ho1d is")]
    fixed = lambda: {r.repaired for r in oc.repair(spark.createDataFrame(rows, KIND), ["sid", "rid"], "book", "page", "text", *heads(spark, [], [])).where("sid = 90").collect()}
    assert fixed() == {"go hoid is"}
    monkeypatch.setattr(oc, "shipped_hashes", lambda *_: None)
    assert fixed() == {"go hoid is"}


def test_a_word_that_belongs_where_it_stands_is_not_misread(spark):
    rows = [(i, "r", "b", 1, f"the burning gate {i}") for i in range(60)] + [(100 + i, "r", "b", 1, f"ash buming cord {'abcdefg'[i]}") for i in range(6)] + [(200, "r", "b", 1, "one buming gate")]
    assert {tuple(r) for r in noise(spark, rows).collect()} == {(200, "r", "misread")}


def test_many_lines():
    assert len(read("夜の\n" * 200_000).running()) == 400_000
