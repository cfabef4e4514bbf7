import random

import pytest

from pagewright.llm import packing as pk

tiktoken = pytest.importorskip("tiktoken")


def packed(spark, sizes, capacities, open_bins=pk.OPEN_BINS):
    counts = spark.createDataFrame([(f"d{i}", n) for i, n in enumerate(sizes)], "doc string, tokens long")
    kinds = spark.createDataFrame(list(enumerate(capacities)), "kind int, cap int")
    return pk.pack(counts, "doc", kinds, "kind", "cap", open_bins)


def test_every_item_once_and_no_bin_over_capacity(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 700) for _ in range(600)] + [512, 513, 1024, 5000, 0, None]
    for open_bins in (3, 4096):
        df = packed(spark, sizes, [512, 1024], open_bins)
        rows = df.collect()
        for kind, cap in ((0, 512), (1, 1024)):
            own = [r for r in rows if r.kind == kind]
            bins, parts = {}, {}
            for r in own:
                if r.bin is not None:
                    bins[r.bin] = bins.get(r.bin, 0) + r.tokens
                parts.setdefault(r.doc, []).append((r.piece, r.start, r.tokens))
            assert max(bins.values()) <= cap
            for i, n in enumerate(sizes):
                p = sorted(parts[f"d{i}"])
                assert sum(t for *_, t in p) == (n or 0) and len(p) == max(1, -(-(n or 0) // cap))
                assert [s for _, s, _ in p] == [k * cap for k in range(len(p))]
        share = {r.kind: r.unused_share for r in pk.unused(df, "kind").collect()}
        assert all(v < 0.02 for v in share.values()) if open_bins > 3 else all(v < 0.5 for v in share.values())


def test_best_fit_and_closing():
    b = pk.OpenBins(10, 2)
    assert [b.put(n) for n in (6, 7, 3, 4)] == [0, 1, 1, 0]
    assert b.count == 0 and b.put(10) == 2 and b.count == 0
    assert [b.put(n) for n in (6, 7, 8)] == [3, 4, 5]  # a third open bin: the fullest, 5, closes
    assert b.put(2) == 4 and b.put(4) == 3


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "The crooked altar"), (2, None), (3, ""), (4, "夜の砦 " * 20000), (1, "The crooked altar")], "id int, text string")
    got = {r.id: r.tokens for r in pk.token_counts(df, "id", "text").collect()}
    assert got[1] > 2 and got[2] is None and got[3] == 0 and got[4] > 60000


def test_no_containers_and_no_items(spark):
    assert packed(spark, [1, 2], []).count() == packed(spark, [], [512]).count() == packed(spark, [1], [0, -3]).count() == 0
