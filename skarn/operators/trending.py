"""Weekly growth leaderboards over star snapshots (week, full_name, stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP, ANOMALY, NEW_DAYS, FLOOR = 20, 0.8, 30, 50


def latest_of_all(snaps: DataFrame) -> DataFrame:
    """All weeks merged, the later one wins for each repository."""
    return snaps.groupBy("full_name").agg(F.max_by("stars", "week").alias("stars"))


def of_week(snaps: DataFrame, week: str) -> DataFrame:
    """full_name, stars of a week; where a series has several snapshots of it (snap_idx), of the first."""
    x = snaps.filter(F.col("week") == week)
    if "snap_idx" in snaps.columns:
        x = x.join(F.broadcast(x.agg(F.min("snap_idx").alias("snap_idx"))), "snap_idx")  # one row
    return x.select("full_name", "stars")


def dense(snaps: DataFrame) -> DataFrame:
    """Every repository in every week from its first: a missing value carries the last one forward.

    Weeks are few, so they are broadcast; each repository gets one row for each of them.
    """
    weeks = F.broadcast(snaps.select("week").distinct())
    grid = snaps.groupBy("full_name").agg(F.min("week").alias("first")).crossJoin(weeks).filter("week >= first").select("full_name", "week")
    upto = Window.partitionBy("full_name").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(snaps, ["full_name", "week"], "left").withColumn("stars", F.last("stars", ignorenulls=True).over(upto))


def deltas(snaps: DataFrame) -> DataFrame:
    """Week-over-week change; null where there is no week before."""
    return snaps.withColumn("delta", F.col("stars") - F.lag("stars").over(Window.partitionBy("full_name").orderBy("week")))


def ranking(live: DataFrame, baseline: DataFrame, allow_new: bool, week_end: str | None = None, top: int = TOP) -> DataFrame:
    """rank, full_name, stars, delta. live: full_name, stars, ord and, if allow_new, created_at.

    A baseline of 0 counts as missing. A repository without one is kept, with its full count, only if new ones are
    allowed and it is at most 30 days older than the week's end. A change above 0.8 of the count is an anomaly and goes.
    """
    b = baseline.select("full_name", F.col("stars").alias("prev"))
    x = live.join(b, "full_name", "left").withColumn("prev", F.coalesce("prev", F.lit(0))).withColumn("delta", F.col("stars") - F.col("prev"))
    new = F.lit(False) if not allow_new else F.date_diff(F.lit(week_end).cast("date"), F.col("created_at").cast("date")) <= NEW_DAYS
    x = x.filter((F.col("prev") > 0) | F.coalesce(new, F.lit(False))).filter((F.col("prev") == 0) | (F.abs("delta") <= ANOMALY * F.col("stars")))
    x = x.orderBy(F.desc("delta"), "ord").limit(top)
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("delta"), "ord"))).select("rank", "full_name", "stars", "delta")


def baseline_for(snaps: DataFrame, *weeks: str) -> DataFrame:
    """The first of these weeks that has a snapshot, else the latest snapshot, else all history."""
    order = F.when(F.lit(False), 0)
    for i, w in enumerate(weeks):
        order = order.when(F.col("week") == w, i)
    newest = snaps.agg(F.max("week").alias("newest"))
    ranked = snaps.join(F.broadcast(newest), F.lit(True)).withColumn("p", F.coalesce(order, F.when(F.col("week") == F.col("newest"), len(weeks))))
    best = ranked.agg(F.min("p").alias("best"))
    return ranked.join(F.broadcast(best), F.col("p") == F.col("best")).select("full_name", "stars", "week")


def upsert(snaps: DataFrame, live: DataFrame, week: str) -> DataFrame:
    """Snapshots with this week's replaced: all history, overlaid by the live counts."""
    history = snaps.filter(F.col("week") != week)
    over = latest_of_all(history).withColumnRenamed("stars", "old").join(live.select("full_name", F.col("stars").alias("new")), "full_name", "full")
    return history.select("week", "full_name", "stars").unionByName(over.select(F.lit(week).alias("week"), "full_name", F.coalesce("new", "old").alias("stars")))


def trackable(snaps: DataFrame) -> DataFrame:
    """Snapshot rows whose name has exactly two parts and whose count reaches the floor."""
    parts = F.split("full_name", "/")
    return snaps.filter((F.size(parts) == 2) & (F.col("stars") >= FLOOR))


def flagged(ranked: DataFrame, registry: DataFrame, added: DataFrame) -> DataFrame:
    """ranked (url, ...) with in_registry (its url is known, whatever the case) and was_added (exactly this url was added)."""
    known = registry.select(F.lower("url").alias("known_url")).distinct()
    new = added.select(F.col("url").alias("added_url")).distinct()
    x = ranked.join(known, F.lower("url") == F.col("known_url"), "left").join(new, F.col("url") == F.col("added_url"), "left")
    return x.withColumn("in_registry", F.col("known_url").isNotNull()).withColumn("was_added", F.col("added_url").isNotNull()).drop("known_url", "added_url")


def tracked(registry: DataFrame, snaps: DataFrame, two_parts: bool = False) -> DataFrame:
    """Pool: registry repositories (full_name, added_at), and snapshot ones above the floor that are not among them.

    two_parts: only names of the form owner/repository.
    """
    first = (trackable(snaps) if two_parts else snaps.filter(F.col("stars") >= FLOOR)).groupBy("full_name").agg(F.min_by("stars", "week").alias("stars"))
    extra = first.join(registry.select("full_name"), "full_name", "left_anti")
    return registry.select("full_name", F.lit(None).cast("long").alias("stars"), F.lit(True).alias("in_registry")).unionByName(extra.select("full_name", "stars", F.lit(False).alias("in_registry")))


def first_seen(live: DataFrame) -> DataFrame:
    """One row for each repository over several query results: the first one found. Forks and nameless rows go."""
    w = Window.partitionBy("full_name").orderBy("query_idx", "item_idx")
    x = live.filter(F.col("full_name").isNotNull() & (F.col("full_name") != "") & ~F.coalesce("fork", F.lit(False)))
    return x.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def ingest(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows that a leaderboard adds to the catalog: growing, url unknown; a taken id gets the owner's first 8 letters.

    An id that the catalog has even so is left out; rows of one leaderboard with the same bare id and owner get the same id.
    """
    x = ranked.filter("delta > 0").join(catalog.select(F.lower("url").alias("u")), F.lower("url") == F.col("u"), "left_anti")
    turn = F.row_number().over(Window.partitionBy("bare").orderBy("rank"))
    x = x.withColumn("turn", turn).join(catalog.select(F.col("id").alias("bare"), F.lit(True).alias("taken")).distinct(), "bare", "left")
    x = x.withColumn("id", F.when((F.col("turn") == 1) & F.col("taken").isNull(), F.col("bare")).otherwise(F.concat_ws("-", "bare", F.substring("owner", 1, 8))))
    return x.join(catalog.select("id"), "id", "left_anti").select("rank", "id", "url", "delta")


def report_lines(ranked: DataFrame, top: int = 10) -> DataFrame:
    """Table rows of the weekly report."""
    return ranked.filter(F.col("rank") <= top).select("rank", F.format_string("| %d | %s | %d | +%d |", "rank", "full_name", "stars", "delta").alias("line"))
