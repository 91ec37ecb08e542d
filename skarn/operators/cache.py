"""A kept cache of search results by (fingerprint of the catalog, query, filters), with an age limit and a bounded size.

Each batch of stored results is one more folder that is never altered; the last row of a key says what holds: stored, or evicted.
A lookup is a join, what it lacks an anti-join; a catalog that has changed has another fingerprint and finds nothing. Beyond `most`
entries the first stored go; storing a key anew while it is there refreshes its age, not its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["fingerprint", "query", "filters"]
SCHEMA = "fingerprint string, query string, filters string, results string, stored_at timestamp, first long, kept boolean"


class ResultCache:
    def __init__(self, spark: SparkSession, path: str, hours: float = 1.0, most: int = 1000):
        self.spark, self.path, self.hours, self.most = spark, path, hours, most
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if n.startswith("batch-") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        self.batches = sorted(int(n[6:]) for n in done)

    def entries(self) -> DataFrame:
        """What the cache holds, of any age."""
        if not self.batches:
            return self.spark.createDataFrame([], SCHEMA)
        every = None
        for n in self.batches:
            one = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/batch-{n}").withColumn("batch", F.lit(n))
            every = one if every is None else every.unionByName(one)
        rest = ["results", "stored_at", "first", "kept"]
        last = every.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("batch", ~F.col("kept"))).alias("e"))
        return last.select(*KEY, *[F.col(f"e.{c}").alias(c) for c in rest]).filter("kept")

    def _fresh(self, now) -> DataFrame:
        return self.entries().filter(F.col("stored_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(self.hours * 3600)))

    def hits(self, asked: DataFrame, now) -> DataFrame:
        """asked (KEY, more) with the results of those that are there and not too old."""
        return asked.join(self._fresh(now).select(*KEY, "results"), KEY)

    def misses(self, asked: DataFrame, now) -> DataFrame:
        """Each key once that has to be searched."""
        return asked.select(*KEY).distinct().join(self._fresh(now), KEY, "left_anti")

    def put(self, results: DataFrame, now) -> ResultCache:
        """results (KEY, results), a row for each key, stored at `now`; a run that fails leaves the cache as it was and can be repeated."""
        n = self.batches[-1] + 1 if self.batches else 0
        old = self.entries()
        new = results.select(*KEY, "results").join(old.select(*KEY, "first"), KEY, "left")
        new = new.select(*KEY, "results", F.lit(now).cast("timestamp").alias("stored_at"), F.coalesce("first", F.lit(n)).cast("long").alias("first"), F.lit(True).alias("kept"))
        every = old.join(new.select(*KEY), KEY, "left_anti").unionByName(new)
        excess = every.count() - self.most
        if excess > 0:
            gone = every.orderBy("first", *KEY).limit(excess).withColumn("kept", F.lit(False)).withColumn("results", F.lit(None).cast("string"))
            new = new.unionByName(gone.select(*new.columns))
        new.write.mode("overwrite").parquet(f"{self.path}/batch-{n}")
        return ResultCache(self.spark, self.path, self.hours, self.most)

    def compact(self) -> ResultCache:
        """All entries as one batch; the folders before it go once it is there."""
        n = self.batches[-1] + 1 if self.batches else 0
        self.entries().write.mode("overwrite").parquet(f"{self.path}/batch-{n}")
        jvm = self.spark.sparkContext._jvm
        for m in self.batches:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-{m}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return ResultCache(self.spark, self.path, self.hours, self.most)
