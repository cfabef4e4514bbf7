"""Parent links to full hierarchies: root, depth, path, descendants and cycles (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.runtime import cut, laid_out, skew_join

#: Levels walked one join at a time; longer chains are jumped in doubling steps.
LEVELS = 6
#: Nodes left after these levels that one task follows to their ends, some 100 bytes each; more are followed by joins.
LAST_NODES = 300_000
#: Children of one parent that go into one partition.
HOT_CHILDREN = 500_000


def resolve_hierarchy(df: DataFrame, node: str, parent: str, order: str | None = None, paths: bool = False, levels: int = LEVELS) -> DataFrame:
    """One row for each distinct ``node``: node, root_id, depth, cycle, on_cycle and, with ``paths``, path (root first).

    A node whose parent is null or absent is a root of depth 0. A node on a cycle, or whose parents
    lead into one, has the smallest node of that cycle as root_id, depth -1, cycle true and a null
    path; on_cycle tells the two apart. Rows with a null node are ignored. Of several parents given for a node the one of the
    latest ``order`` row counts (the largest parent if there is no order or a tie). Other columns are
    dropped; an empty table gives an empty result.

    The frontier is joined level by level from the roots; edges are laid out and sorted by parent once (a
    parent of very many children over several partitions), so each level only moves the frontier. Chains that go on after ``levels`` levels are followed by doubling
    the distance they know, and what is never reached is on or behind a cycle.
    """
    link = F.struct(F.col(f"`{order}`") if order else F.lit(0), F.col(f"`{parent}`").cast("string").alias("p"))
    pick = cut(df.where(F.col(f"`{node}`").isNotNull()).groupBy(F.col(f"`{node}`").cast("string").alias("id")).agg(F.max(link)["p"].alias("parent")))
    # children of one parent may be any share of all rows: such parents get several salts, and there are at most 10,000
    # of them, which makes their list small enough to broadcast
    total = pick.count()
    many = max(HOT_CHILDREN, total // 10_000)
    given = pick.where("parent is not null")
    hot = cut(given.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > many).select(F.col("parent").alias("hot"), F.ceil(F.col("n") / many).alias("salts"))) if total > many else None
    known = _copied(pick.select(F.col("id").alias("known")), "known", hot)
    linked = given.withColumn("salt", F.lit(0).cast("long")) if hot is None else given.join(F.broadcast(hot), F.col("parent") == F.col("hot"), "left").select("id", "parent", F.coalesce(F.pmod(F.xxhash64("id"), "salts"), F.lit(0).cast("long")).alias("salt"))
    linked = cut(linked.join(known, (F.col("parent") == F.col("known")) & (F.col("salt") == F.col("copy")), "left").select("id", F.col("known").alias("parent"), "salt"))
    edges = laid_out(linked.where("parent is not null"), "parent", "salt")

    path = F.array("id") if paths else F.lit(None).cast("array<string>")
    roots = pick.where("parent is null").select("id").unionByName(linked.where("parent is null").select("id"))
    level = roots.select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), path.alias("path"))
    done = [level]
    grown = F.concat("path", F.array("id")) if paths else F.col("path")
    deep = True
    for d in range(1, levels + 1):
        up = _copied(done[-1].select(F.col("id").alias("up"), "root_id", "path"), "up", hot)
        level = cut(edges.join(up, (F.col("parent") == F.col("up")) & (F.col("salt") == F.col("copy"))).select("id", "root_id", F.lit(d).alias("depth"), grown.alias("path")))
        deep = not level.isEmpty()
        if not deep:
            break
        done.append(level)
    reached = done[0]
    for x in done[1:]:
        reached = reached.unionByName(x)
    left = cut(edges.select("id", "parent").join(reached.select(F.col("id").alias("up")), F.col("id") == F.col("up"), "left_anti"))
    rest = left.count()
    if rest and rest <= LAST_NODES and not paths:
        walked = cut(left.repartition(1).mapInArrow(_walk, "id string, end string, dist int, root_id string, on_cycle boolean"))
        ends = done[-1].select(F.col("id").alias("to"), F.col("root_id").alias("to_root"), "depth")
        far = skew_join(walked.where("end is not null"), "end", ends, "to", "id", rest)
        done.append(far.select("id", F.col("to_root").alias("root_id"), (F.col("depth") + F.col("dist")).alias("depth"), F.lit(None).cast("array<string>").alias("path")))
        return _finish(done, walked.where("end is null").select("id", "root_id", "on_cycle"), node, paths)
    if rest and deep:
        far, left = _jump(left, done[-1], paths)
        done += far
    return _finish(done, _cycles(left) if rest and not left.isEmpty() else None, node, paths)


def _copied(one: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``one`` with a copy for each salt of its key."""
    if hot is None:
        return one.withColumn("copy", F.lit(0).cast("long"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))
    return one.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left").withColumn("copy", copies).drop("hot", "salts")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task followed to their ends by doubling: (id, end, dist, null, null), the parent that is not among the ids and how
    far it is; for a node on or behind a cycle (id, null, null, smallest node of the cycle, whether it is on it)."""
    links = [pair for b in batches for pair in zip(*(c.to_pylist() for c in b.columns))]
    if not links:
        return
    names = sorted(child for child, _ in links)  # by code point
    number = {name: i for i, name in enumerate(names)}
    outside: list[str | None] = [None] * len(names)
    to = np.arange(len(names))
    for child, up in links:
        i = number[child]
        to[i] = number.get(up, i)
        outside[i] = up if up not in number else None
    last = np.array([o is not None for o in outside])
    far, dist, least, ring = to.copy(), (~last).astype(np.int64), np.arange(len(names)), to.copy()
    for _ in range(len(names).bit_length() + 1):
        dist += dist[far]
        far = far[far]
        least = np.minimum(least, least[ring])
        ring = ring[ring]
    ended = last[far]
    cyclic = np.zeros(len(names), bool)
    cyclic[far[~ended]] = True  # so many steps lead from any node onto its cycle, and round the whole of it
    out = [
        [outside[t] if e else None for t, e in zip(far.tolist(), ended.tolist())], [d + 1 if e else None for d, e in zip(dist.tolist(), ended.tolist())],
        [None if e else names[k] for k, e in zip(least[far].tolist(), ended.tolist())], [None if e else c for c, e in zip(cyclic.tolist(), ended.tolist())],
    ]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["id", "end", "dist", "root_id", "on_cycle"])


def _finish(done: list[DataFrame], cycles: DataFrame | None, node: str, paths: bool) -> DataFrame:
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.withColumns({"cycle": F.lit(False), "on_cycle": F.lit(False)})
    if cycles is not None:
        out = out.unionByName(cycles.select("id", "root_id", F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.lit(True).alias("cycle"), "on_cycle"))
    return out.select(F.col("id").alias(node), "root_id", "depth", "cycle", "on_cycle", *(["path"] if paths else []))


def _jump(left: DataFrame, base: DataFrame, paths: bool) -> tuple[list[DataFrame], DataFrame]:
    """Nodes below the last walked level, resolved by doubling; and those no jump ever resolves.

    ``base`` is the last walked level: every unreached chain that ends at a root passes through it. A
    node whose pointer ends at a node resolved last is resolved; a pointer that ends at a node still open
    is lengthened by that node's own. So pointers only end at open nodes and at those resolved last, and
    a round that resolves none leaves only cycles.
    """
    none = F.lit(None).cast("array<string>")
    open_ = left.select("id", F.col("parent").alias("up"), F.lit(1).alias("dist"), (F.array("id") if paths else none).alias("path"), F.col("parent").alias("origin"))
    whole = F.concat("to_path", "path") if paths else F.col("path")
    last, done, rows = base, [], left.count()
    while True:
        ends = last.select(F.col("id").alias("to"), F.col("root_id"), F.col("depth"), F.col("path").alias("to_path"))
        step = cut(skew_join(open_, "up", ends, "to", "id", rows, "left").select("id", "root_id", (F.col("depth") + F.col("dist")).alias("depth"), F.when(F.col("to").isNull(), F.col("path")).otherwise(whole).alias("path"), "up", "dist", "origin"))
        last, still = step.where("root_id is not null").select("id", "root_id", "depth", "path"), step.where("root_id is null")
        if last.isEmpty():
            return done, still.select("id", F.col("origin").alias("parent"))
        done.append(last)
        hop = still.select(F.col("id").alias("to"), F.col("up").alias("to_up"), F.col("dist").alias("to_dist"), F.col("path").alias("to_path"))
        longer = skew_join(still, "up", hop, "to", "id", rows, "left")
        open_ = cut(longer.select("id", F.coalesce("to_up", "up").alias("up"), (F.col("dist") + F.coalesce("to_dist", F.lit(0))).alias("dist"), F.when(F.col("to").isNull(), F.col("path")).otherwise(whole).alias("path"), "origin"))


def _cycles(rest: DataFrame) -> DataFrame:
    """(id, root_id, on_cycle): for nodes whose parents never end, the smallest node of the cycle they run into.

    Pointers are doubled until the set they point to stops shrinking: then it is exactly the nodes on
    cycles. The smallest node of each cycle is found by doubling along the cycle itself.
    """
    far = rest.select("id", F.col("parent").alias("up"))
    targets, rows = None, rest.count()
    while True:
        hop = far.select(F.col("id").alias("to"), F.col("up").alias("to_up"))
        far = cut(skew_join(far, "up", hop, "to", "id", rows).select("id", F.col("to_up").alias("up")))
        count = far.select("up").distinct().count()
        if count == targets:
            break
        targets = count
    ring = far.select(F.col("up").alias("id")).distinct()
    ring = cut(rest.join(ring, "id", "left_semi").select("id", F.col("parent").alias("up"), F.least("id", "parent").alias("least")))
    while True:
        hop = ring.select(F.col("id").alias("to"), F.col("up").alias("to_up"), F.col("least").alias("to_least"))
        step = cut(ring.join(hop, F.col("up") == F.col("to")).select("id", F.col("to_up").alias("up"), F.least("least", "to_least").alias("least"), (F.col("to_least") < F.col("least")).alias("better")))
        ring = step.drop("better")
        if not step.where("better").limit(1).count():
            break
    ends = ring.select(F.col("id").alias("to"), F.col("least").alias("root_id"))
    on = ring.select("id", F.lit(True).alias("on_cycle"))
    return far.join(ends, F.col("up") == F.col("to")).join(on, "id", "left").select("id", "root_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def descendants(resolved: DataFrame, node: str) -> DataFrame:
    """(ancestor, node, distance) for each node and each node above it, from the paths of ``resolve_hierarchy``.

    Nodes on or behind cycles have no path and give no pair.
    """
    up = resolved.where("path is not null").select(F.col(node), F.posexplode("path").alias("__at", "ancestor"), F.size("path").alias("__size"))
    return up.where("__at < __size - 1").select("ancestor", node, (F.col("__size") - 1 - F.col("__at")).alias("distance"))
