import random

from pagewright.operators import hierarchy
from pagewright.operators.hierarchy import descendants, resolve_hierarchy


def brute(links):
    parent = {k: p for k, p in links.items()}
    out = {}
    for x in parent:
        seen, at = [], x
        while True:
            if at in seen:
                ring = seen[seen.index(at) :]
                out[x] = (min(ring), -1, None, x in ring)
                break
            seen.append(at)
            up = parent[at]
            if up is None or up not in parent:
                out[x] = (at, len(seen) - 1, seen[::-1], False)
                break
            at = up
    return out


def resolved(spark, rows, **more):
    df = spark.createDataFrame(rows, "id string, p string, at int, root_id string").toDF("n", "p", "at", "root_id")
    return resolve_hierarchy(df, "n", "p", "at", **more)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    links = {f"n{i}": (None if i < 3 else f"n{rng.randrange(i)}") for i in range(60)}
    links |= {f"c{i:02}": f"c{i - 1:02}" if i else "n0" for i in range(45)}  # a long chain
    links |= {"lost": "nowhere", "self": "self", "a": "b", "b": "c", "c": "a", "t1": "a", "t2": "t1", "z": "y", "y": "z", "A": "t2"}
    links |= {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)} | {f"q{i}": f"q{i + 1}" for i in range(20)} | {"q20": "r4"}
    rows = [(k, p, 2, "x") for k, p in links.items()] + [(k, p, 2, "x") for k, p in list(links.items())[:9]] + [("n5", "gone", 1, "x"), (None, "n1", 1, "x")]
    want = brute(links)
    for last, levels in [(0, 2), (0, 6), (0, 100), (10**6, 1), (10**6, 6)]:
        monkeypatch.setattr(hierarchy, "LAST_NODES", last)
        found = {r.n: (r.root_id, r.depth, r.on_cycle) for r in resolved(spark, rows, levels=levels).collect()}
        assert found == {k: (r, d, c) for k, (r, d, _, c) in want.items()}
    for levels in (2, 6, 100):
        got = {r.n: (r.root_id, r.depth, r.path, r.on_cycle) for r in resolved(spark, rows, paths=True, levels=levels).collect()}
        assert got == want
    assert resolved(spark, rows).count() == len(want)
    pairs = {(r.ancestor, r.n, r.distance) for r in descendants(resolved(spark, rows, paths=True), "n").collect()}
    assert pairs == {(a, x, len(path) - 1 - i) for x, (_, d, path, _) in want.items() if d > 0 for i, a in enumerate(path[:-1])}


def test_children_of_one_parent_over_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "HOT_CHILDREN", 7)
    rows = [("r", None, 1, ""), ("q", "r", 1, "")] + [(f"a{i}", "r", 1, "") for i in range(40)] + [(f"b{i}", "a3", 1, "") for i in range(30)]
    got = {r.n: r.depth for r in resolved(spark, rows).collect()}
    assert len(got) == 72 and sum(d == 2 for d in got.values()) == 30


def test_only_cycles_and_empty(spark):
    assert {(r.n, r.root_id, r.depth) for r in resolved(spark, [("b", "a", 1, ""), ("a", "b", 1, "")]).collect()} == {("a", "a", -1), ("b", "a", -1)}
    assert resolved(spark, []).count() == 0


def test_one_hot_ancestor_behind_the_walked_levels(spark, monkeypatch):
    from pagewright import runtime

    monkeypatch.setattr(hierarchy, "LAST_NODES", 0)
    monkeypatch.setattr(hierarchy, "HOT_CHILDREN", 7)
    whole = runtime.skew_join
    monkeypatch.setattr(hierarchy, "skew_join", lambda *a, **k: whole(*a, **k, part=7))
    rows = [("r", None, 1, "")] + [(f"c{i}", f"c{i - 1}" if i else "r", 1, "") for i in range(9)] + [(f"x{i:03}", "c8", 1, "") for i in range(90)]  # nine tenths under one node
    got = {r.n: (r.root_id, r.depth) for r in resolved(spark, rows, levels=3).collect()}
    assert len(got) == 100 and all(got[f"x{i:03}"] == ("r", 10) for i in range(90))
