import __spark_entry__ as entry


def test_names_agree():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert {f"p{n}_found" for n in (1, 3, 5)} <= set(q)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment_id", "input_type", "text", "book_id", "audience", "content_type", "spans"]
    assert df.count() > 0
