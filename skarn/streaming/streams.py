"""Streaming forms of the event logs: running statistics, calendar weeks, clicks joined to searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_stats(traces: DataFrame) -> DataFrame:
    """Per-tool totals of a trace stream, for update or complete output."""
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    return traces.groupBy("tool_id").agg(F.count(F.lit(1)).alias("total"), ok.alias("success"), (F.count(F.lit(1)) - ok).alias("fail"))


def drained(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """What a stream's aggregate says once all input there is has been read; its progress and result lie below `folder`."""
    import uuid

    at = f"{folder}/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/result")


def into_batches(stream: DataFrame, at: str, mode: str) -> None:
    """Runs a stream over all input there is into at/batches/number=N. A batch that is run again after a failure replaces what it gave before."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batches/number={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def newest(spark: SparkSession, at: str, schema: str, key: str) -> DataFrame:
    """Of each key the row of the last batch that has it: what an update stream says now."""
    every = spark.read.schema(f"{schema}, number long").parquet(f"{at}/batches")
    rest = [c for c in every.columns if c not in (key, "number")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), "number").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def weekly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts in ISO weeks (Monday, UTC): append output gives closed weeks, update output also the running one."""
    w = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("week_start"), "n")


def successful_searches(searches: DataFrame, clicks: DataFrame, within: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Searches with a click on their query in time; both sides have watermarks, so state stays bounded."""
    s = searches.withWatermark("ts", late).select(F.col("query").alias("q"), F.col("ts").alias("s_ts"), F.col("seq").alias("s_seq"))
    c = clicks.withWatermark("ts", late).select(F.col("query").alias("cq"), F.col("ts").alias("c_ts"))
    return s.join(c, F.expr(f"q = cq AND c_ts BETWEEN s_ts AND s_ts + INTERVAL {within}")).select("q", "s_seq", "s_ts", "c_ts")


def debounced(events: DataFrame, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The last event of each burst: a burst ends with a quiet time."""
    w = F.session_window("ts", quiet)
    return events.withWatermark("ts", late).groupBy(w, "user").agg(F.max_by("query", "ts").alias("query"), F.count(F.lit(1)).alias("n")).select("user", "query", "n")


def unexpired(entries: DataFrame, now, ttl_seconds: int) -> DataFrame:
    return entries.filter(F.col("timestamp") >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds)))
