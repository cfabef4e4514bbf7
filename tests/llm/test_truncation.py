from pagewright.llm import truncation as tr


def marked(spark, rows):
    df = spark.createDataFrame([(i, s, t, h) for i, (s, t, h) in enumerate(rows)], "doc int, src string, text string, title string")
    return {r.doc: (r.cut, r.reason) for r in tr.truncated(df, "doc", "src", "text", "title").collect()}


WHOLE = ["夜の砦で休む。", "「行くのか？」", "そして彼は黙り込んだ……", "「まさか…」", "表です。\n筋力  12\n薬学  7", "列です。\n・札 箱 3個\n●札 箱 12個", 'He said "no."', "It ends!", "（終わり）", "Done. \n\n"]
CUT = ["夜の砦で休", "カードを2", "knows that the kee", "夜の砦で休む。そのあと彼は、", "門を抜け…", "門を抜け�", "the Farh [", "まだ話し…", "The keeper - once", "列です。\n・札 箱 3個\n●札 箱 12", "「行くと言った」"]


def test_endings(spark):
    got = marked(spark, [("s", t, None) for t in WHOLE + CUT])
    assert [k for k, (c, _) in sorted(got.items()) if c] == list(range(len(WHOLE), len(WHOLE) + len(CUT)))


def test_formulas_titles_and_trailing_words_are_learned(spark):
    rows = [("s", f"本文その{i}。\n次回へつづく", None) for i in range(6)] + [("s", f"Number {i} is here. And then Bo{i} fell silent...", None) for i in range(6)]
    rows += [("s", "本文です。\nどこにもない行", None), ("s", "the gate was op...", None)]
    rows += [(h, "重い天秤と砂の荷車", h) for h in ("小さな荷車", "古い荷車", "青い荷車")] + [("t", "The Cracked Harbor of Elnal", None), ("u", "As the gamemaster of Gel", None), ("v", "Lenis: B", None)]
    got = marked(spark, rows)
    assert [k for k, (c, _) in sorted(got.items()) if c] == [12, 13, 18, 19]


def test_spikes_at_a_field_limit(spark):
    rows = [("limit", ("行%d。" % i + "あ" * 99)[:40], None) for i in range(12)] + [("limit", "短い。", None)] + [("free", "い" * (20 + i) + "。", None) for i in range(12)]
    rows += [("limit", "列。\n" + "・" + "札" * 32 + " 12個"[:4], None), ("bytes", "", None)]
    rows += [("bytes", ("第%d。" % (10 + i) + "あ" * 99)[:33] + "a" * (i % 3), None) for i in range(12)]
    df = spark.createDataFrame([(s, t) for s, t, _ in rows], "src string, text string")
    spikes = {(r.source, r.unit, r.length) for r in tr.length_spikes(df, "src", ["text"]).collect()}
    assert ("limit", "chars", 40) in spikes and not any(s == "free" for s, *_ in spikes)
    got = marked(spark, rows)
    assert all(got[k] == (True, "limit") for k in range(12)) and got[12] == (False, None)


def test_rates_nulls_and_repeats(spark):
    rows = [("s", "休む。", None), ("s", "休", None), ("s", None, None), ("s", "  \n", None), (None, "休", None)]
    got = marked(spark, rows)
    assert got == {0: (False, None), 1: (True, "unfinished"), 4: (True, "unfinished")}
    df = spark.createDataFrame([(1, "s", "休"), (1, "s", "休"), (2, "s", "休む。")], "doc int, source string, last string")
    out = tr.truncated(df, "doc", "source", "last")
    assert out.count() == 2
    r = tr.cut_rates(out, "source").first()
    assert (r.docs, r.cut_docs, r.rate) == (2, 1, 0.5)
    assert tr.truncated(df.limit(0), "doc", "source", "last").count() == 0


def test_very_long_texts(spark):
    words, blanks = "word " * 60_000, " " * 100_000
    got = marked(spark, [("s", words + "end.", None), ("s", words + "en", None), ("s", "a" + blanks + "b", None), ("s", "x." + blanks, None), ("s", "あ" * 200_000 + "...", None)])
    assert {k: c for k, (c, _) in got.items()} == {0: False, 1: True, 2: True, 3: False, 4: True}


def test_copies_count_once_for_endings(spark):
    rows = [("s", "Once the gate was op...", None)] * 6 + [("s", "重い天秤と砂の荷車", "古い荷車")] * 4 + [("s", f"本文その{i}。", f"題{i}の箱") for i in range(3)] + [("s", "砂の箱", None)]
    assert [k for k, (c, _) in sorted(marked(spark, rows).items()) if c] == list(range(10))
