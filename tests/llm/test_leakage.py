import random

import numpy as np

from pagewright.llm import leakage as lk


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def items(spark, *texts):
    return spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "item_id int, text string")


def found(spark, d, i, **more):
    return {(r.doc_id, r.item_id) for r in lk.leaked(docs(spark, *d), "doc_id", "text", items(spark, *i), "item_id", "text", **more).collect()}


def brute(d, i):
    runs = lambda t: {s[k : k + lk.RUN] for s in [lk.letters(t or "")] for k in range(len(s) - lk.RUN + 1)}
    return {(a, 100 + b) for a, x in enumerate(d) for b, y in enumerate(i) if runs(x) & runs(y)}


def test_letters():
    assert lk.letters("Ｔhe  夜・の　カー（x）２_d6!") == "the夜のカーx2d6"


def test_hashes_depend_on_the_window_alone():
    text = "".join(chr(0x3042 + k % 80) for k in range(300))
    h, t, p = lk.seed_hashes(["x" * 5, text, "", text[50:120]])
    assert h.size == 281 + 51 and set(t.tolist()) == {1, 3}
    assert (h[t == 3] == h[t == 1][50:101]).all() and p[t == 3].tolist() == list(range(51))
    assert np.unique(h[t == 1][:80]).size == 80


def test_matches_brute_force_at_the_border_of_the_run(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("あいうえおかきくけこさしすせそabcde") for _ in range(n))
    i = [word(rng.randrange(10, 160)) for _ in range(12)] + ["", None, word(39), word(40)]
    d = []
    for _ in range(60):
        item = rng.choice([x for x in i if x])
        n = rng.choice([20, 38, 39, 40, 41, 80])
        a = rng.randrange(max(1, len(item) - n + 1))
        part = item[a : a + n]
        d.append(word(rng.randrange(100)) + "".join(c + rng.choice(["", "", "、", " \n"]) for c in part).upper() + word(rng.randrange(50)))
    d += [None, "", i[-1], i[-1] * 3]
    want = brute(d, i)
    assert found(spark, d, i) == want and len(want) > 10
    assert found(spark, d, i, block_chars=1) == want  # one item a block


def test_common_seeds_do_not_hide_a_run(spark):
    common = "どの文書にもある同じ長い決まり文句のひとつである"
    item = common + "ここだけの続きがさらに長くつづいていくのであった"
    d = [common + "別の話" + str(k) for k in range(50)] + [item]
    assert found(spark, d, [item]) == {(50, 100)}


def test_edited_copies_are_aligned(spark):
    base = "".join(chr(0x4E00 + k) for k in range(120))
    edited = base[:35] + "變" + base[36:70] + base[72:105] + "新" + base[105:]
    r = lk.leaked(docs(spark, "前" + edited + "後", base[:30]), "doc_id", "text", items(spark, base), "item_id", "text", edited=True).collect()
    assert [(x.doc_id, x.run < lk.RUN, x.matched > 0.9) for x in r] == [(0, True, True)]
    assert found(spark, [edited], [base]) == set()


def test_alignment():
    assert lk.align("abcdef", "xxabdefyy") == (4.0, 5)
    assert lk.align("", "a") == (0.0, 0) and lk.align("abc", "xyz") == (0.0, 0)


def test_empty_tables(spark):
    assert found(spark, [], ["x" * 50]) == found(spark, ["x" * 50], []) == set()


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("あいうえおかき") for _ in range(n)) for n in (0, 19, 20, 21, 333, 64, 5)]
    known = lk._Known(lk.seed_hashes(["".join(texts)[100:260], texts[5]])[0])
    whole = sorted(zip(*(c.tolist() for c in lk.found_seeds(texts, known))))
    monkeypatch.setattr(lk, "PIECE", 50)
    lk._powers.cache_clear()
    assert sorted(zip(*(c.tolist() for c in lk.found_seeds(texts, known)))) == whole and len(whole) > 100
    lk._powers.cache_clear()


def test_an_edited_copy_beside_an_exact_one(spark):
    base = "".join(chr(0x4E00 + k) for k in range(120))
    edited = "".join("變" if k % 30 == 29 else c for k, c in enumerate(base))
    r = lk.leaked(docs(spark, base, edited), "doc_id", "text", items(spark, base), "item_id", "text", edited=True).collect()
    assert {(x.doc_id, x.run, x.matched) for x in r} == {(0, 120, 1.0), (1, 29, 0.966667)}


def test_the_best_of_several_places_is_scored(spark):
    base = "".join(chr(0x4E00 + k) for k in range(120))
    edited = "".join("變" if k % 30 == 29 else c for k, c in enumerate(base))
    far = "".join(chr(0x3042 + k % 80) for k in range(500))
    d = [base[10:30] + far + edited, base[10:55] + far + edited, far + base[10:30] + far]
    r = lk.leaked(docs(spark, *d), "doc_id", "text", items(spark, base), "item_id", "text", edited=True).collect()
    assert {(x.doc_id, x.run, x.matched) for x in r} == {(0, 29, 0.966667), (1, 45, 0.966667)}


def test_places():
    assert list(lk.places({0, 1000, 1010}, 100, 5000)) == [(0, 160), (940, 1170)]
    parts = list(lk.places(set(range(0, 3000, 50)), 100, 9000))
    assert parts[0][0] == 0 and parts[-1][1] == 3110 and all(b - a <= 420 for a, b in parts)
    assert all(b - c == 200 for (_, b), (c, _) in zip(parts, parts[1:]))


def test_recall_of_edited_copies_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda n: "".join(chr(0x3042 + rng.randrange(80)) for _ in range(n))
    i = [word(120) for _ in range(30)]
    d = []
    for k, item in enumerate(i):
        copy = list(item)
        for at in rng.sample(range(120), 4):
            copy[at] = rng.choice("xyz")
        d.append(rng.choice(["", item[30:55]]) + word(400) + "".join(copy) + word(60))  # a quotation may stand far before the copy
        d.append(word(80) + i[k - 1][: rng.randrange(10, 30)] + word(80))
    d += i[:10]
    want = {(a, 100 + b) for a, x in enumerate(d) for b, y in enumerate(i) if lk.align(y, x)[1] >= lk.COVER * len(y)}
    got = found(spark, d, i, edited=True)
    assert got <= want and len(want) >= 40 and len(got) >= 0.9 * len(want)


def test_scores_are_those_of_the_alignment(spark):
    item = "夜の砦で旅人が休むときは必ず火を絶やさず見張りを立てるものとするのが古くからの掟である"
    rows = lk.leaked(docs(spark, "はじめに、" + item + "。おわり", item[:41] + "ちがう終わり"), "doc_id", "text", items(spark, item), "item_id", "text").collect()
    got = {r.doc_id: (r.run, r.matched, r.score) for r in rows}
    assert got[0] == (len(item), 1.0, float(len(item))) and got[1][0] == 41 and got[1][1] < 1 and got[1][2] == lk.align(item, item[:41] + "ちがう終わり")[0]


def test_items_too_short_to_search(spark):
    given = items(spark, "あ" * 39, "あ" * 40, None, "", "あ、い")
    assert {tuple(r) for r in lk.unsearched(given, "item_id", "text").collect()} == {(100, 39), (102, 0), (103, 0), (104, 2)}
