"""The weekly job as one run: nine steps, each of which may fail and be run again.

Every step writes a folder of its own below the run's (staged), so what is there already is read and not computed again; a step that was
cut short has no mark of success and is written anew. Nothing outside the run's folder changes before the last steps: the week's partition of
the snapshots is replaced, and only that one; then the catalog's additions are put, by id, in place of what the same week put before; and last
the manifest names the week as done. Run again after that, the job only reads.

Tables below root: snapshots (partitioned by week: full_name, stars), registry additions (partitioned by week: rank, id, url, delta),
reports (partitioned by week), manifest (one folder for each week that is done).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import trending as T
from skarn.sources.files import exists

STEPS = ["pool", "history", "live", "last_week", "week_to_date", "candidates", "snapshots", "additions", "manifest"]


class WeeklyRun:
    def __init__(self, spark: SparkSession, root: str, week: str):
        self.spark, self.root, self.week = spark, root, week
        self.stage = f"{root}/runs/{week}"

    def done(self) -> bool:
        return exists(self.spark, f"{self.root}/manifest/week={self.week}/_SUCCESS")

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of the root, empty if it isn't there yet."""
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def snapshots(self) -> DataFrame:
        return self.table("snapshots", "full_name string, stars long, week string")

    def additions(self) -> DataFrame:
        return self.table("additions", "rank int, id string, url string, delta long, week string")

    def _staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.stage}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _replace(self, name: str, rows: DataFrame) -> None:
        """This week's partition of a table, and no other."""
        rows.withColumn("week", F.lit(self.week)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(f"{self.root}/{name}")

    def run(self, registry: DataFrame, live: DataFrame, previous: str, before: str, week_end: str, after: Callable[[str], None] = lambda step: None) -> dict[str, DataFrame]:
        """All steps. registry: id, full_name, url; live: full_name, stars, query_idx, item_idx, fork, created_at, url, owner, bare; previous, before: the two weeks before.

        after: called with the name of each step once it is done. Returns the tables of the week.
        """
        r = self._staged
        pool = r("pool", lambda: T.tracked(registry.select("full_name"), self.snapshots().filter(F.col("week") < self.week)))
        after("pool")
        history = r("history", lambda: self.snapshots().filter(F.col("week") < self.week))
        after("history")
        seen = r("live", lambda: T.first_seen(live).withColumn("ord", F.col("query_idx") * (1 << 32) + F.col("item_idx")))
        after("live")
        base = lambda *weeks: T.baseline_for(history, *weeks)
        newest = lambda: T.of_week(history, previous).join(seen.drop("stars"), "full_name")
        last = r("last_week", lambda: T.ranking(newest(), base(before), False))
        after("last_week")
        now = r("week_to_date", lambda: T.ranking(seen, base(previous, before), True, week_end))
        after("week_to_date")
        named = lambda: last.join(seen.select("full_name", "url", "owner", "bare"), "full_name")
        added = r("candidates", lambda: T.ingest(named(), registry.select("id", "url")))
        after("candidates")
        # the live counts over all history: a repository not seen this week keeps its last count
        counts = r("counts", lambda: T.upsert(history, seen.select("full_name", "stars"), self.week).filter(F.col("week") == self.week).select("full_name", "stars"))
        self._replace("snapshots", counts)
        after("snapshots")
        self._replace("additions", added.select("rank", "id", "url", "delta"))
        after("additions")
        if not self.done():
            self.spark.range(1).select(F.lit(counts.count()).alias("tracked"), F.lit(pool.count()).alias("pool"), F.lit(added.count()).alias("added")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/week={self.week}")
        after("manifest")
        return {"pool": pool, "last_week": last, "week_to_date": now, "additions": added, "counts": counts}
