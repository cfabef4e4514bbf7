"""Session helpers shared by all operators: lineage cuts, size-checked broadcasts, table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a key list may be shipped to every task as 8-byte hashes (64 MB at most).
MAX_SHIPPED_HASHES = 8_000_000
_FOLDERS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget how it was made.

    Files there survive lost executors. A checkpoint still carries the size estimated for the plan it came
    from, and estimates of joins multiply: after some rounds of a loop they have millions of digits. So
    the rows are taken up afresh, unless their layout is to be kept.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    kept = df.checkpoint(eager=True)
    if keep_layout:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def own_folder(spark: SparkSession) -> str:
    """A folder in the shared one that is removed when the session ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, where a checkpoint would be large; removed when the session ends."""
    spark = df.sparkSession
    name = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(name)
    out = spark.read.schema(df.schema).parquet(name)
    out._stored_at = name
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables before the session ends, once all that was made of them is materialised."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def laid_out(df: DataFrame, *by: str) -> DataFrame:
    """A materialised ``df`` partitioned and sorted by columns, in a form whose layout joins on them know and use.

    Adaptive execution is off while it is written: a plan it changes tells nothing of its layout.
    """
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by), keep_layout=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of this machine's own is taken only where master and executors are on it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not (sc.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "pagewright-checkpoints")


def skew_join(many: DataFrame, key: str, one: DataFrame, one_key: str, by: str, rows: int, how: str = "inner", part: int = 200_000) -> DataFrame:
    """Equi-join of rows any share of which may have one ``key`` with a side that has each ``one_key`` once.

    Keys of more than ``part`` rows, and of more than a ten thousandth of the ``rows`` of all, go over several
    partitions, by ``by``; so there are at most 10,000 of them, which makes their list small enough to broadcast.
    """
    part = max(part, rows // 10_000)
    if rows <= part:  # no key can be large
        return many.join(one, F.col(key) == F.col(one_key), how)
    hot = F.broadcast(many.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") > part).select("__hot", F.ceil(F.col("__n") / part).alias("__salts")))
    salted = many.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), "__salts"), F.lit(0).cast("long"))).drop("__hot", "__salts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)).cast("long") - 1))
    spread_ = one.join(hot, F.col(one_key) == F.col("__hot"), "left").withColumn("__copy", copies).drop("__hot", "__salts")
    return salted.join(spread_, (F.col(key) == F.col(one_key)) & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__copy")


def shipped_hashes(keys: DataFrame, column: str, limit: int = MAX_SHIPPED_HASHES):
    """Sorted numpy array of the distinct 64-bit values of ``column``, or None when there are more than ``limit``.

    Used only to thin rows before an exact join; with None the join sees every row, so the result
    is the same at every size.
    """
    import numpy as np

    distinct = keys.select(F.col(column).cast("long").alias("h")).where("h is not null").distinct()
    rows = distinct.limit(limit + 1).toArrow().column("h").to_numpy()
    return None if len(rows) > limit else np.sort(rows.astype(np.int64))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over all cores before work in Python, where its scan has fewer parts than there are cores.

    A large table has more parts than cores and is left as it is; only small files are dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *by)
