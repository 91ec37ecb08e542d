"""Catalog statistics and changes: KPIs, categories, insert-if-absent, replace, delete, skills, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_id(tools: DataFrame, tool_id: str) -> DataFrame:
    return tools.filter(F.col("id") == tool_id).limit(1)


def kpis(tools: DataFrame) -> DataFrame:
    return tools.agg(
        F.count(F.lit(1)).alias("tools"), F.count_distinct(F.get("category", F.lit(0))).alias("categories"), F.count_distinct("language").alias("languages"),
        F.sum(F.size("subTools")).cast("long").alias("sub_tools"), F.sum(F.coalesce("stars", F.lit(0))).alias("stars"), F.floor(F.avg("stars") + 0.5).alias("mean_stars"),
    )


def by_category(tools: DataFrame) -> DataFrame:
    """category, n, stars, its first place in the catalog; a tool with several categories counts in each."""
    x = tools.select("id", "ord", F.coalesce("stars", F.lit(0)).alias("stars"), F.explode(F.when(F.size("category") > 0, F.col("category")).otherwise(F.array(F.lit("未分類")))).alias("category"))
    return x.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("stars").alias("stars"), F.min("ord").alias("first_ord")).orderBy(F.desc("stars"), F.desc("n"))


def top_in_category(tools: DataFrame, k: int = 3) -> DataFrame:
    x = tools.select("id", "ord", "stars", F.explode("category").alias("category"))
    w = Window.partitionBy("category").orderBy(F.desc(F.coalesce("stars", F.lit(0))), "ord")
    return x.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("category", "r", "id", "stars")


def languages(tools: DataFrame, k: int = 5) -> DataFrame:
    return tools.groupBy(F.coalesce(F.nullif("language", F.lit("")), F.lit("other")).alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(k)


def belongs(category: str) -> Column:
    return F.array_contains("category", category)


def add(tools: DataFrame, new: DataFrame) -> DataFrame:
    """tools and the rows of new whose url is not there; a taken id gets the owner in front."""
    x = new.join(tools.select("url"), "url", "left_anti").join(tools.select("id", F.lit(True).alias("taken")), "id", "left")
    owner = F.regexp_extract("url", r"github\.com/([^/]+)/", 1)
    x = x.withColumn("id", F.when(F.col("taken"), F.concat_ws("-", owner, "id")).otherwise(F.col("id"))).drop("taken")
    return tools.unionByName(x)


def remove(tools: DataFrame, id_or_url: str) -> DataFrame:
    """tools without the first row that has this id or url."""
    hit = (F.col("id") == id_or_url) | (F.col("url") == id_or_url)
    first = tools.filter(hit).agg(F.min("ord").alias("gone"))
    return tools.join(F.broadcast(first), F.col("ord") == F.col("gone"), "left_anti")


def merge_pool(old: DataFrame, new: DataFrame) -> DataFrame:
    """full_name, category, note: the new category unless it is null, the old note."""
    o, n = old.select("full_name", F.col("category").alias("oc"), F.col("note").alias("o_note")), new.select("full_name", F.col("category").alias("nc"), F.col("note").alias("n_note"))
    return o.join(n, "full_name", "full").select("full_name", F.coalesce("nc", "oc").alias("category"), F.coalesce("o_note", "n_note").alias("note"))


def union_skills(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Skills of both sources (id, ...), the later one wins; the second counts only if the first has under limit / 2."""
    few = first.limit(limit).count() < limit / 2
    every = first.withColumn("prio", F.lit(0))
    if few:
        every = every.unionByName(second.withColumn("prio", F.lit(1)))
    rest = [c for c in first.columns if c != "id"]
    x = every.groupBy("id").agg(F.max_by(F.struct(*rest), "prio").alias("s"))
    return x.select("id", "s.*").orderBy("id").limit(limit)


def parse_skills(text: DataFrame, limit: int = 10) -> DataFrame:
    """Lines like owner/repo@name 12 installs of each text, in order, as rows; other columns stay."""
    pattern = r"(\w+/\w+)@([\w-]+)\s+(\d+)\s+installs?"
    found = F.slice(F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(pattern))), 1, limit)
    x = text.withColumn("line", F.explode(found))
    part = lambda g: F.regexp_extract("line", pattern, g)
    kept = [c for c in text.columns if c != "text"]
    return x.select(*kept, F.concat(part(1), F.lit("@"), part(2)).alias("id"), part(2).alias("name"), part(1).alias("source"), part(3).cast("long").alias("installs"))


def url_lines(text: DataFrame) -> DataFrame:
    """Distinct urls of a batch file in order of appearance; blanks and # lines go."""
    x = text.select(F.trim("value").alias("url"), F.col("pos")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))
    return x.groupBy("url").agg(F.min("pos").alias("pos"))


def category_changes(old_new: DataFrame) -> DataFrame:
    return old_new.filter(~F.col("old").eqNullSafe(F.col("new"))).groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))
