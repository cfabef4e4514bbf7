from pagewright.operators.normalize import normalized, with_lines


def one(spark, text):
    return normalized(spark.createDataFrame([(text,)], "raw_text string")).first()


def test_word_wrap_is_joined_with_offsets(spark):
    r = one(spark, "ゲームマス\nターが進行する。")
    assert r.normalized_text == "ゲームマスターが進行する。"
    assert [(o.left_end, o.right_start) for o in r.operations] == [(5, 6)]
    assert r.review_reasons == []


def test_what_keeps_its_break(spark):
    for text, reason in [("説明文です\n●項目その一", "bullet_list_structure"), ("名前  値\n筋力  10", "table_like_spacing"), ("見出しです\n注釈", "short_independent_line")]:
        r = one(spark, text)
        assert (r.normalized_text, r.review_reasons, r.operations) == (text, [reason], [])
    for text in ("終わりました。\n次の行です", "空の行\n\nその次の行", "本文です\n", "", "一行だけ"):
        r = one(spark, text)
        assert (r.normalized_text, r.review_reasons, r.operations) == (text, [], [])


def test_all_kinds_of_breaks_and_wide_characters(spark):
    df = spark.createDataFrame([("本文😀\r\nあ\rい\n",), ("\n\nx",), (None,)], "raw_text string")
    rows = with_lines(df, "raw_text").collect()
    assert [(x.text, x.start, x.end, x.line_break) for x in rows[0].lines] == [("本文😀", 0, 3, "\r\n"), ("あ", 5, 6, "\r"), ("い", 7, 8, "\n")]
    assert [(x.text, x.start) for x in rows[1].lines] == [("", 0), ("", 1), ("x", 2)]
    assert not rows[2].lines


def test_reasons_in_order_once(spark):
    text = "長い行の終わりに\n・項目\n・項目二\n数値  と表\n長い行の終わりに"
    assert one(spark, text).review_reasons == ["bullet_list_structure", "table_like_spacing"]


def test_offsets_over_many_lines(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import normalize

    text = "".join(f"line {i}" + ("\r\n" if i % 3 else "\n") for i in range(2000))
    lines = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(normalize.physical_lines(F.col("t")).alias("l")).collect()
    assert [text[x.start : x.end] for x in lines[0].l] == [x.text for x in lines[0].l] == [f"line {i}" for i in range(2000)]
    assert lines[1].l == [] and not lines[2].l
