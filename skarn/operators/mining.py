"""Synonym mining kept up to date: counts change by what changes in the catalog, never by a pass over all of it.

Two terms count as one pair for each tool that lists both, so a changed tool takes its old pairs away and adds its new ones, and no
other tool matters. Each change is one more folder with the tools it puts or removes, written first, and one with what that adds to
the counts of terms and of pairs, which commits it; the sums over all changes are the counts. A term that becomes common, or rare
again, retracts or restores its pairs when these are read, as counts of common terms are kept too: pairs of a tool are few, so they
stay in proportion to the catalog. Pairs are summed once for each state, into a folder of their own, from which all that is mined is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import norm
from skarn.operators.synonyms import COMMON, is_chinese, mined

TOOLS = "id string, zh array<string>, en array<string>, change int"
COUNTS = "a string, b string, by long"
PAIRS = "zh string, en string, n long"


class MinedTerms:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        p = self._at("")
        names = [f.getPath().getName() for f in p.getFileSystem(self._conf()).listStatus(p)] if self._there("") else []
        self.changes = sorted(int(n[7:]) for n in names if n.startswith("change-") and self._there(f"{n}/_SUCCESS"))

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _there(self, name: str) -> bool:
        p = self._at(name)
        return p.getFileSystem(self._conf()).exists(p)

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _kept(self) -> DataFrame:
        return self._read([f"tools-{n}" for n in self.changes], TOOLS)

    def tools(self) -> DataFrame:
        """id, terms of every tool that is there; terms are null for one that has been removed."""
        last = self._last(self._kept())
        return last.filter("zh is not null").select("id", F.concat("zh", "en").alias("terms"))

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.max_by(F.struct("zh", "en"), "change").alias("t")).select("id", "t.zh", "t.en")

    def put(self, tools: DataFrame) -> MinedTerms:
        """tools (id, triggers), in place of those with the same id."""
        terms = F.array_distinct(F.filter(F.transform(F.coalesce("triggers", F.array()), norm), lambda t: t != ""))
        return self._change(tools.select(F.col("id").cast("string").alias("id"), terms.alias("terms")))

    def remove(self, ids: DataFrame) -> MinedTerms:
        return self._change(ids.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("array<string>").alias("terms")).distinct())

    def _change(self, new: DataFrame) -> MinedTerms:
        n = self.changes[-1] + 1 if self.changes else 0
        zh, en = F.filter("terms", is_chinese), F.filter("terms", lambda t: ~is_chinese(t))
        new.select("id", zh.alias("zh"), en.alias("en"), F.lit(n).alias("change")).write.mode("overwrite").parquet(f"{self.path}/tools-{n}")
        new = self._read([f"tools-{n}"], TOOLS)
        both = new.select("zh", "en", F.lit(1).alias("by"))
        if self.changes:
            old = self._last(self._kept().join(new.select("id").distinct(), "id", "left_semi"))
            both = both.union(old.select("zh", "en", F.lit(-1)))
        single = F.transform(F.concat("zh", "en"), lambda t: F.struct(t.alias("a"), F.lit(None).cast("string").alias("b")))
        pairs = F.flatten(F.transform("zh", lambda z: F.transform("en", lambda e: F.struct(z.alias("a"), e.alias("b")))))
        counts = both.filter("zh is not null").select(F.explode(F.concat(single, pairs)).alias("p"), "by").groupBy("p.a", "p.b").agg(F.sum("by").alias("by")).filter("by <> 0")
        kind = F.when(F.col("b").isNull(), "term").otherwise("pair")
        counts.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/change-{n}")
        return MinedTerms(self.spark, self.path)

    def _counts(self, kind: str, *by: str) -> DataFrame:
        names = [f"change-{n}/kind={kind}" for n in self.changes]
        return self._read([n for n in names if self._there(n)], COUNTS).groupBy(*by).agg(F.sum("by").alias("n")).filter("n > 0")

    def frequencies(self) -> DataFrame:
        return self._counts("term", "a").select(F.col("a").alias("term"), F.col("n").alias("df"))

    def pairs(self) -> DataFrame:
        """(zh, en, n) as synonyms.pairs gives over all tools."""
        if not self.changes:
            return self.spark.createDataFrame([], PAIRS)
        last = self.changes[-1]
        if not self._there(f"pairs-{last}/_SUCCESS"):
            common = self.frequencies().filter(F.col("df") > COMMON).select("term")
            p = self._counts("pair", "a", "b").select(F.col("a").alias("zh"), F.col("b").alias("en"), "n")
            p = p.join(common.withColumnRenamed("term", "zh"), "zh", "left_anti").join(common.withColumnRenamed("term", "en"), "en", "left_anti")
            p.select("zh", "en", "n").write.mode("overwrite").parquet(f"{self.path}/pairs-{last}")
        return self._read([f"pairs-{last}"], PAIRS)

    def mine(self, seeds: DataFrame | None = None, aliases: DataFrame | None = None, least: int = 1) -> DataFrame:
        return mined(self.pairs(), seeds, aliases, least)
