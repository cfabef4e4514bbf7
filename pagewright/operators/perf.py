"""Summaries of timed steps. Events: step_name, file_key, elapsed, kind (step, wait), outcome (success, error), seq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _parts():
    ok = F.col("outcome") == "success"
    return [
        F.round(F.sum("elapsed"), 4).alias("real_total"), F.round(F.avg("elapsed"), 4).alias("real_avg"), F.round(F.coalesce(F.sum(F.when(ok, F.col("elapsed"))), F.lit(0.0)), 4).alias("success_total"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("elapsed"))), F.lit(0.0)), 4).alias("success_avg"), F.count("*").alias("attempts"), F.count_if(~ok).alias("failures"),
    ]


def by_step(events: DataFrame) -> DataFrame:
    """Totals, means, attempts and failures of each step, with the place of its first event."""
    return events.where("kind = 'step'").groupBy("step_name").agg(*_parts(), F.min("seq").alias("first_seq"))


def by_file(events: DataFrame) -> DataFrame:
    """Per file: time with and without waits, attempts, failures, and the step that failed last."""
    step = F.col("kind") == "step"
    failed = step & (F.col("outcome") == "error")
    return events.groupBy("file_key").agg(
        F.round(F.sum("elapsed"), 4).alias("real_total"), F.round(F.coalesce(F.sum(F.when(step & (F.col("outcome") == "success"), F.col("elapsed"))), F.lit(0.0)), 4).alias("success_total"),
        F.round(F.coalesce(F.sum(F.when(~step, F.col("elapsed"))), F.lit(0.0)), 4).alias("waited"), F.count_if(step).alias("attempts"), F.count_if(failed).alias("failures"),
        F.max_by(F.when(failed, F.col("step_name")), F.when(failed, F.col("seq"))).alias("last_failure"),
    )


def waits(events: DataFrame) -> DataFrame:
    return events.where("kind = 'wait'").agg(F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 4).alias("total"), F.round(F.coalesce(F.avg("elapsed"), F.lit(0.0)), 4).alias("mean"), F.count("*").alias("n"))


def backoff_seconds(attempt, base: int = 30, attempts: int = 5):
    """Seconds to wait before each further attempt; null when no attempt is left."""
    return F.when(attempt < attempts - 1, base * F.pow(F.lit(2), attempt))
