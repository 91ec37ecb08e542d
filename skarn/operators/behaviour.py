"""Search behaviour: popular queries, unmet needs, click statistics, success within a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def popular(log: DataFrame, limit: int = 10) -> DataFrame:
    s = log.filter("type = 'search'").groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return s.orderBy(F.desc("n"), "first_seq").limit(limit)


def unmet(log: DataFrame, least: int = 3, key: str = "query") -> DataFrame:
    """Queries searched at least so often, without a click after their first search."""
    first = log.filter("type = 'search'").groupBy(F.col(key).alias("query")).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("searches"))
    clicks = log.filter("type = 'click'").select(F.col(key).alias("query"), F.col("seq").alias("click_seq"))
    hit = clicks.join(first.filter(F.col("searches") >= least), "query").filter("click_seq > first_seq").select("query").distinct()
    return first.filter(F.col("searches") >= least).join(hit, "query", "left_anti")


def success_rate(log: DataFrame, within_s: int = 30) -> DataFrame:
    """Per query: searches, and those with a click on the same query in [ts, ts + within_s].

    The next click after each search decides. Rows of a query are read from the last to the first, so the click seen last is
    the next one, and each row costs the same.
    """
    after = Window.partitionBy("query").orderBy(F.desc("ts"), F.when(F.col("type") == "click", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    x = log.filter(F.col("type").isin("search", "click")).withColumn("next_click", F.last(F.when(F.col("type") == "click", F.col("ts")), ignorenulls=True).over(after)).filter("type = 'search'")
    ok = F.coalesce(F.col("next_click") <= F.col("ts") + F.make_dt_interval(secs=F.lit(within_s)), F.lit(False))
    return x.groupBy("query").agg(F.count(F.lit(1)).alias("searches"), F.count_if(ok).alias("successes")).withColumn("rate", F.col("successes") / F.col("searches"))


def tool_clicks(log: DataFrame, now, days: int = 30) -> DataFrame:
    recent = F.col("ts") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return log.filter("type = 'click'").groupBy("query").agg(F.count(F.lit(1)).alias("clicks"), F.count_if(recent).alias("recent"), F.max_by("ts", "seq").alias("last_ts"))


def report(log: DataFrame) -> DataFrame:
    n = lambda t: F.count_if(F.col("type") == t)
    one = log.agg(n("search").alias("searches"), n("click").alias("clicks"), n("abandon").alias("abandons"), F.count_distinct(F.when(F.col("type") == "search", F.col("query"))).alias("queries"))
    return one.withColumn("rate", F.coalesce(F.try_divide(F.col("clicks").cast("double"), F.col("searches")), F.lit(0.0)))


def last_events(log: DataFrame, keep: int = 1000) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(keep)
