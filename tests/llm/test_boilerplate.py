import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import boilerplate as bp


def found(spark, rows, exact=True):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "seg string, book string, text string, line_no int, key string")
    out = bp.repeated_lines(df, "seg", "book", "text")
    return {(r.seg, r.line_no) for r in (bp.exact(out) if exact else out).collect()}


def brute(rows):
    docs, occ = {}, {}
    for seg, book, text in rows:
        if seg is None or book is None:
            continue
        docs.setdefault(book, set()).add(seg)
        for no, line in enumerate((text or "").split("\n")):
            if len(k := bp.line_key(line)) >= 10:
                occ.setdefault((book, k), set()).add((seg, no))
    return {x for (book, _), v in occ.items() if (n := len({s for s, _ in v})) >= 5 and n >= 0.005 * len(docs[book]) for x in v}


def test_keys():
    assert bp.line_key(" 12 本書の​無断 転載34　") == bp.line_key("本書の無断転載") == "本書の無断転載"
    assert bp.line_key("ＡＢＣ１２") == "ABC" and bp.line_key("2031 年") == "年" and bp.line_key("123") == ""
    assert bp.masked("As told to Lorren 12/3 ヤマダ") == "N told to N 0 ア"


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["鉄朱評議会の羅針盤", "As told to Lorren branch", "感想は編集部までお寄せください", "複写と再配布には許可が要ります"]
    rows = []
    for i in range(400):
        lines = ["".join(rng.choice("あいうえおかきくけこ") for _ in range(rng.randrange(5, 30))) for _ in range(3)]
        if rng.random() < 0.2:
            lines.insert(rng.randrange(3), rng.choice(["", "12 ", "​"]) + rng.choice(words) + rng.choice(["", " 7", "　", "\r"]))
        rows.append((f"s{i}", "big" if i < 300 else rng.choice("xyz"), "\n".join(lines)))
    rows += rows[:50] + [("n1", "x", None), ("n2", "x", ""), (None, "x", words[0]), ("n3", None, words[0])]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 30


def test_share_of_a_large_source(spark):
    line = "この行はどこにでもあります"
    rows = [(f"s{i}", "b", line if i < 6 else "") for i in range(1400)]
    assert found(spark, rows) == set()  # 6 of 1,400 are under half a percent
    assert len(found(spark, rows[:1200])) == 6


def test_near_copies_form_clusters(spark):
    line = "この頁の内容は組合の会員だけが使うことができるものとする規則である"
    rows = [(f"s{i}", "b", line) for i in range(3)] + [(f"t{i}", "b", line + c) for i, c in enumerate("。！")]
    assert found(spark, rows) == set()
    assert found(spark, rows, exact=False) == {(r[0], 0) for r in rows}


def test_bands_of_equal_texts_agree_within_a_source_only():
    a = bp.band_hashes(["x", "x", "y"], ["同じ行であること", "同じ行であること", "同じ行であること"])
    assert (a[0] == a[1]).all() and not (a[0] == a[2]).any()
    assert bp.band_hashes(["x"], ["短い"]).shape == (1, bp.BANDS) and bp.band_hashes([], []).shape == (0, bp.BANDS)
    assert (bp.band_hashes(["x"] * 2, ["最後の行の最後の五文字", "別の行"])[1] == bp.band_hashes(["x"], ["別の行"])[0]).all()
    assert a.dtype == np.int64


def test_without_shipping_the_result_is_the_same(spark, monkeypatch):
    rows = [(f"s{i}", "b", "いつもの行がここにあります\n" + chr(0x3042 + i) * 12) for i in range(9)]
    want = found(spark, rows)
    monkeypatch.setattr(bp, "shipped_hashes", lambda *_: None)
    assert found(spark, rows) == want == {(f"s{i}", 0) for i in range(9)}


def test_cleaning(spark):
    df = spark.createDataFrame([("a", "x\ny\n\nz"), ("b", "x"), ("c", None), ("d", "q")], "id string, t string")
    drop = spark.createDataFrame([("a", 0), ("a", 2), ("b", 0)], "id string, line_no int")
    assert {r.id: r.clean_text for r in bp.without_lines(df, "id", "t", drop).collect()} == {"a": "y\nz", "b": "", "c": None, "d": "q"}


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_chains_of_near_copies_are_one_cluster(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(3, 99), (99, 50)], "form long, head long")
    assert {(r.form, r.head) for r in bp.linked(edges).collect()} == {(k, 10) for k in range(10, 41)} | {(k, 3) for k in (3, 50, 99)}
    rng = random.Random(8)
    line = [chr(0x4E00 + rng.randrange(900)) for _ in range(90)]
    rows = []
    for k in range(6):  # each differs from the one before in one place, the last from the first in five
        line[15 * k] = "あいうえおか"[k]
        rows.append((f"s{k}", "b", "".join(line)))
    assert found(spark, rows, exact=False) == {(f"s{k}", 0) for k in range(6)}


def test_recall_of_near_copies_against_all_pairs(spark):
    rng = random.Random(11)
    letters = [chr(0x3042 + k) for k in range(80)]
    texts = []
    for _ in range(60):
        base = [rng.choice(letters) for _ in range(rng.randrange(40, 90))]
        texts.append("".join(base))
        for _ in range(6):  # one edit, or two, which leaves a similarity around the limit
            copy = list(base)
            for _ in range(rng.randrange(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(letters)
            texts.append("".join(copy))
    grams = [{t[k : k + bp.SHINGLE] for k in range(len(t) - bp.SHINGLE + 1)} for t in texts]
    alike = lambda a, b: len(grams[a] & grams[b]) >= bp.SIMILARITY * len(grams[a] | grams[b])
    home = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if alike(a, b) and home[a] != home[b]:
                home = [home[b] if x == home[a] else x for x in home]
    size = {x: home.count(x) for x in home}
    want = {(f"s{k}", 0) for k, x in enumerate(home) if size[x] >= bp.MIN_DOCS}
    got = found(spark, [(f"s{k}", "b", t) for k, t in enumerate(texts)], exact=False)
    assert got <= want and len(want) > 100 and len(got) >= 0.9 * len(want)


def test_large_buckets_lose_no_link(spark):
    forms = spark.createDataFrame([(k, 9 - k, m, int(bp.sketches(["b"], [m])[0, bp.BANDS]), [7]) for k, m in enumerate(["あいうえおかきくけこ" * 3, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmn", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmo", "どれとも似ていない行がここにひとつある"])], "form long, n long, mask string, bits long, bands array<long>")
    assert {tuple(r) for r in bp._links(bp._held(forms), forms.select("form", bp._grams(F.col("mask")).alias("grams"))).collect()} == {(1, 2)}


def test_links_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(bp, "LAST_LINKS", 3)
    rng = random.Random(2)
    names = rng.sample(range(10_000), 300)
    edges = [(names[k], names[k + 1]) for k in range(298) if k % 50 != 49]
    want = {f: min(names[k - k % 50 : min(k - k % 50 + 50, 299)]) for k, f in enumerate(names[:299])}
    got = {r.form: r.head for r in bp.linked(spark.createDataFrame(edges, "form long, head long")).collect()}
    assert got == {f: h for f, h in want.items() if any(f in e for e in edges)}
