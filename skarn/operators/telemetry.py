"""Execution telemetry: per-tool statistics, the materialised summary, redaction, chat export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(traces: DataFrame) -> DataFrame:
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    return traces.groupBy("tool_id").agg(F.count(F.lit(1)).alias("total"), ok.alias("success"), (F.count(F.lit(1)) - ok).alias("fail"), (ok / F.count(F.lit(1))).alias("success_rate"))


def summary(traces: DataFrame) -> DataFrame:
    """One row: what the summary file would hold."""
    s = stats(traces)
    return s.agg(F.sum("total").alias("total_traces"), F.count(F.lit(1)).alias("tools"), F.sum("success").alias("success"), F.sum("fail").alias("fail"))


def is_stale(generated_at: Column, now: Column, hours: int = 1) -> Column:
    return generated_at.isNull() | (generated_at < now - F.make_interval(hours=F.lit(hours)))


def redacted(args: Column) -> Column:
    return F.when(F.size(args) > 0, "[REDACTED]").otherwise("")


def export_chats(traces: DataFrame, tools: DataFrame) -> DataFrame:
    """Chat lines of successful runs without (so unredacted) arguments."""
    good = traces.filter(F.col("success") & (F.coalesce("args", F.lit("")) == "")).join(tools.select(F.col("id").alias("tool_id"), "name", "description"), "tool_id")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    line = F.to_json(F.struct(F.array(message("user", F.col("description")), message("assistant", F.col("name"))).alias("messages")))
    return good.select("event_id", line.alias("line"))


def conversations_as_chats(turns: DataFrame) -> DataFrame:
    """One line for each conversation, its turns as messages in order."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("line"))


def materialized(traces: DataFrame, path: str, hours: float = 1.0) -> DataFrame:
    """stats as a table at path with generated_at, built again where it is missing or older."""
    from skarn.sources.files import fresh

    return fresh(traces.sparkSession, path, lambda: stats(traces), hours)
