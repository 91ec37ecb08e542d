"""Written results: the weekly report, the leaderboard view, the statistics page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_report(ranked: DataFrame, week: str, tracked: int, live: int, top: int = 10) -> DataFrame:
    """One row: the report's text. ranked is a leaderboard, so its rows are few."""
    line = F.format_string("| %d | %s | %d | +%d |", "rank", "full_name", "stars", "delta")
    rows = ranked.filter(F.col("rank") <= top).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    head = f"# {week}\n\n- tracked: {tracked}\n- live: {live}\n\n| rank | repository | stars | delta |\n|---|---|---|---|\n"
    return rows.select(F.concat(F.lit(head), F.array_join(F.col("l")["line"], "\n")).alias("text"))


def leaderboard_view(ranked: DataFrame, top: int = 10) -> DataFrame:
    """rank, mark (medals for three), full_name, change (stars alone where nothing grew)."""
    mark = F.when(F.col("rank") == 1, "🥇").when(F.col("rank") == 2, "🥈").when(F.col("rank") == 3, "🥉").otherwise(F.col("rank").cast("string"))
    change = F.when(F.col("delta") > 0, F.concat(F.lit("+"), F.format_number("delta", 0))).otherwise(F.concat(F.format_number("stars", 0), F.lit(" (待比對)")))
    return ranked.filter(F.col("rank") <= top).select("rank", mark.alias("mark"), "full_name", change.alias("change"))


def statistics(tools: DataFrame, k: int = 5) -> DataFrame:
    """kind, label, value: totals, and the k most frequent categories and languages."""
    def most(column, kind: str) -> DataFrame:
        n = tools.groupBy(column.alias("label")).agg(F.count(F.lit(1)).alias("value"))
        return n.orderBy(F.desc("value"), "label").limit(k).select(F.lit(kind).alias("kind"), F.col("label").cast("string").alias("label"), "value")

    total = tools.agg(F.count(F.lit(1)).alias("tools"), F.sum(F.coalesce("stars", F.lit(0))).alias("stars"), F.floor(F.avg(F.coalesce("stars", F.lit(0))) + 0.5).alias("mean"))
    total = total.select(F.explode(F.map_from_arrays(F.array(F.lit("tools"), F.lit("stars"), F.lit("mean_stars")), F.array("tools", "stars", "mean"))).alias("label", "value"))
    return total.select(F.lit("total").alias("kind"), "label", "value").unionByName(most(F.get("category", F.lit(0)), "category")).unionByName(most(F.col("language"), "language"))
