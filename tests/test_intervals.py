import random

from pagewright.operators.intervals import covered_and_gaps


def brute(rows):
    out = set()
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "covered", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, start long, end long").selectExpr("k", "start", "end", "k as k0", "start as s")
    return [tuple(r) for r in covered_and_gaps(df, ["k"], width=width).select("k", "kind", "span_start", "span_end").collect()]


def test_matches_brute_force_across_shards(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab") + str(rng.randrange(3)), s, s + rng.choice([1, 3, 10, 70])) for s in (rng.randrange(-100, 400) for _ in range(300))]
    rows += rows[:40] + [("a0", 5, 5), ("a0", 9, 2), (None, 1, 2), ("a0", None, 2), ("a0", 1, None), ("far", 0, 1), ("far", 10**6, 10**6 + 5), ("touch", 0, 64), ("touch", 64, 128), ("long", 0, 5000)]
    for width in (64, 1000, 4096):
        got = run(spark, rows, width)
        assert len(got) == len(set(got))
        assert set(got) == brute(rows)


def test_empty_table(spark):
    assert run(spark, [], 64) == []
