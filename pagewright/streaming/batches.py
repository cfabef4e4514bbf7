"""Results of region work as a stream of small batches, merged into the state that is valid now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.operators.sessions import still_valid


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files under ``path`` (a folder or a glob) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def user_activity(events: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Events, failures and elapsed time per user and window; rows later than ``late`` behind the newest are dropped."""
    w = F.window("ts", every)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.sum("value"), 4).alias("elapsed"))


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what there is now, exactly once per checkpoint folder, into parquet files."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_results(stream: DataFrame, current: DataFrame, keys: list[str], geometry: list[str], target: str, checkpoint: str) -> None:
    """Appends each batch's results whose region still exists unchanged; a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        still_valid(batch, current, keys, geometry).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
