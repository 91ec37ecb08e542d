"""Jobs: states, timeouts, cancellation, folding of a transition log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Job states, default and longest timeout.
STATES = ["pending", "running", "completed", "failed", "timeout", "cancelled"]
FINAL = ["completed", "failed", "timeout", "cancelled"]
DEFAULT_MS, LONGEST_MS = 120_000, 600_000


def timeout_ms(seconds: Column) -> Column:
    return F.least(F.coalesce(seconds * 1000, F.lit(DEFAULT_MS)), F.lit(LONGEST_MS)).cast("long")


def counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES], F.count(F.lit(1)).alias("total"))


def listed(jobs: DataFrame, status: str | None = None, tool_id: str | None = None, limit: int = 20) -> DataFrame:
    for column, value in (("status", status), ("tool_id", tool_id)):
        if value is not None:
            jobs = jobs.filter(F.col(column) == value)
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def fold(log: DataFrame, final_wins: bool = False) -> DataFrame:
    """job_id, state: the last transition; with final_wins the first final one, if any."""
    last = F.max_by("state", "seq")
    if final_wins:
        is_final = F.col("state").isin(*FINAL)
        last = F.coalesce(F.min_by(F.when(is_final, F.col("state")), F.when(is_final, F.col("seq"))), last)
    return log.groupBy("job_id").agg(last.alias("state"))


def cancel(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """job_id, outcome of cancelling: ok, not found, already finished."""
    x = wanted.join(jobs.select("job_id", "status"), "job_id", "left")
    return x.select("job_id", F.when(F.col("status").isNull(), "not found").when(F.col("status").isin(*FINAL), "already finished").otherwise("ok").alias("outcome"))
