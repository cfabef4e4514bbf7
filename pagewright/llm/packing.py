"""Filling fixed-capacity containers with texts (problem 7)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.runtime import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bins open at a time.
OPEN_BINS = 1024
#: A group of items would fill so many times the open bins, and has at most so many items on average.
ROUNDS, GROUP_ITEMS = 2, 250_000
#: Container kinds a call takes at most; they are a parameter table.
MAX_CONTAINERS = 1000
#: Longer texts are encoded in parts that end at line feeds or blanks where there are any.
PART_CHARS = 50_000


class OpenBins:
    """Bounded-space online best fit: open bins in a bitset keyed by free space, the fullest closes first."""

    def __init__(self, capacity: int, limit: int = OPEN_BINS):
        self.capacity, self.limit, self.count, self.made = capacity, limit, 0, 0
        self.bits, self.at = 0, [[] for _ in range(capacity + 1)]

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def _take(self, free: int) -> int:
        stack = self.at[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return b

    def put(self, size: int) -> int:
        """The bin the item goes into: the open bin it leaves least free, else a new one."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.capacity, self.new()
        free -= size
        if free:
            self.at[free].append(b)
            self.bits |= 1 << free
            self.count += 1
            if self.count > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return b


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str) -> Iterator[str]:
    while len(text) > PART_CHARS:
        at = max(text.rfind("\n", 1, PART_CHARS), text.rfind(" ", 1, PART_CHARS))
        at = at if at > 0 else PART_CHARS
        yield text[:at]
        text = text[at:]
    yield text


def token_counts(df: DataFrame, item: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(item, tokens) for each distinct row: tokens of the whole text, null for a null text."""
    given = df.select(F.col(f"`{item}`").alias(item), F.col(f"`{text}`").cast("string").alias("t")).where(f"`{item}` is not null").transform(spread, item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or _encoder(tokenizer)
            n = [None if t is None else sum(len(enc.encode_ordinary(p)) for p in _parts(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[item, "tokens"])

    return given.mapInArrow(run, given.select(item).schema.add("tokens", "long"))


def pack(counts: DataFrame, item: str, containers: DataFrame, container: str, capacity: str, open_bins: int = OPEN_BINS) -> DataFrame:
    """Assigns each item to bins of each container kind.

    ``counts`` has one row per item with its tokens. Result: container, capacity, bin, item, piece,
    start, tokens. An item goes whole into one bin unless it exceeds the capacity; then it fills bins
    of its own from the start and only its rest is placed like an item. Items of zero or null tokens
    take no room: they are given with a null bin. Containers with a null or non-positive capacity
    are left out; equal item rows are one item.

    Items are dealt into groups by hash, each about as large as ROUNDS times ``open_bins`` bins hold
    and of some GROUP_ITEMS items at most, so a group is bounded whatever the number of items. A group
    hands its items one after the other, the largest first, to the online best fit with at most
    ``open_bins`` open bins; when one more would be open the fullest closes for good.
    """
    kinds = containers.select(container, F.col(capacity).cast("long").alias("cap")).where("cap > 0").distinct().limit(MAX_CONTAINERS + 1).collect()
    if len(kinds) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} container kinds")
    item_type, kind_type = counts.schema[item].dataType, containers.schema[container].dataType
    schema = f"{container} {kind_type.simpleString()}, capacity long, bin long, {item} {item_type.simpleString()}, piece int, start long, tokens long"
    spark = counts.sparkSession
    if not kinds:
        return spark.createDataFrame([], schema)
    items = cut(counts.groupBy(item).agg(F.max("tokens").alias("tokens")))
    total, some = items.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    least = lambda cap: max(1, -(-(total or 0) // (ROUNDS * open_bins * cap)), -(-some // GROUP_ITEMS))
    choices = F.array(*[F.struct(F.lit(k[0]).cast(kind_type).alias("kind"), F.lit(k[1]).cast("long").alias("cap"), F.lit(least(k[1])).cast("long").alias("groups")) for k in kinds])
    dealt = items.withColumn("k", F.explode(choices)).select(item, "tokens", "k.*")
    placed = dealt.where("tokens > 0").withColumn("group", F.pmod(F.xxhash64(F.col(item)), F.col("groups")))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, cap, group = key
        cap = int(cap)
        bins = OpenBins(cap, open_bins)
        rows = rows.sort_values(["tokens", item], ascending=[False, True], kind="stable")
        out: list[tuple] = []
        rests = []
        for i, n in zip(rows[item].tolist(), rows["tokens"].tolist()):
            whole = n // cap
            out += [(bins.new(), i, p, p * cap, cap) for p in range(whole)]
            if n % cap:
                rests.append((n % cap, i, whole))
        for size, i, p in sorted(rests, key=lambda r: -r[0]):
            out.append((bins.put(size), i, p, p * cap, size))
        made = pd.DataFrame(out, columns=["bin", item, "piece", "start", "tokens"])
        made.insert(0, container, kind)
        made.insert(1, "capacity", cap)
        made["bin"] += int(group) << 32
        return made

    packed = placed.groupBy("kind", "cap", "group").applyInPandas(fill, schema)
    free = dealt.where("tokens is null or tokens <= 0").select(
        F.col("kind").alias(container), F.col("cap").alias("capacity"), F.lit(None).cast("long").alias("bin"), item, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")
    )
    return packed.unionByName(free)


def unused(packed: DataFrame, container: str) -> DataFrame:
    """Per container kind: bins, pieces, tokens and the share of capacity left unused."""
    per = packed.where("bin is not null").groupBy(container, "capacity", "bin").agg(F.sum("tokens").alias("t"), F.count("*").alias("p"))
    sums = per.groupBy(container, "capacity").agg(F.count("*").alias("bins"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"))
    return sums.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))
