"""Hierarchy graph (root, category, tool, first sub-tools) as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 3


def nodes_and_edges(tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tools: id, name, category (text), ord, subs (array of text). Tools without a category are left out."""
    t = tools.filter(F.coalesce(F.col("category") != "", F.lit(False)))
    cats = t.groupBy("category").agg(F.min("ord").alias("o"), F.count(F.lit(1)).alias("n"))
    cats = cats.withColumn("idx", F.row_number().over(Window.orderBy("o", "category")) - 1)  # as many rows as categories
    cats = cats.select("category", F.concat(F.lit("cat_"), F.col("idx").cast("string")).alias("cat_id"), "n")
    in_cat = t.join(F.broadcast(cats) if cats.limit(10_001).count() <= 10_000 else cats, "category").select(F.concat(F.lit("tool_"), F.col("id")).alias("tool_node"), "id", "name", "cat_id", "category", "subs")
    subs = in_cat.select("tool_node", "category", "id", F.posexplode(F.slice("subs", 1, SHOWN)).alias("i", "sub"))
    subs = subs.select("tool_node", "category", F.concat_ws("_", F.lit("sub"), "id", F.col("i").cast("string")).alias("sub_node"), "sub")
    root = tools.agg(F.concat_ws("", F.lit("catalog ("), F.count(F.lit(1)).cast("string"), F.lit(")")).alias("label"))
    nodes = root.select(F.lit("root").alias("id"), "label", F.lit("root").alias("kind"), F.lit(None).cast("string").alias("category"))
    nodes = nodes.unionByName(cats.select(F.col("cat_id").alias("id"), F.col("category").alias("label"), F.lit("category").alias("kind"), "category"))
    nodes = nodes.unionByName(in_cat.select(F.col("tool_node").alias("id"), F.col("name").alias("label"), F.lit("tool").alias("kind"), "category"))
    nodes = nodes.unionByName(subs.select(F.col("sub_node").alias("id"), F.col("sub").alias("label"), F.lit("subtool").alias("kind"), "category"))
    edges = cats.select(F.lit("root").alias("source"), F.col("cat_id").alias("target"))
    edges = edges.union(in_cat.select("cat_id", "tool_node")).union(subs.select("tool_node", "sub_node"))
    return nodes, edges


def describe(tools: DataFrame) -> DataFrame:
    """category, n, first use cases, languages, first five names, in catalog order.

    First ones are found in each of many parts of a category, then among these, so a large category is not one task's.
    """
    t = tools.filter(F.coalesce(F.col("category") != "", F.lit(False))).withColumn("part", F.pmod(F.xxhash64("ord", "name"), F.lit(32)))

    def firsts(rows: DataFrame, value: str, k: int) -> DataFrame:
        """category, the first k values by ord as an array of structs."""
        w = Window.partitionBy("category", "part").orderBy("ord")
        few = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
        return few.groupBy("category").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", value))), 1, k)[value].alias("firsts"))

    some = t.filter("use_case <> ''")
    return (
        t.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("language")).alias("languages"))
        .join(firsts(some, "use_case", 2).withColumnRenamed("firsts", "u"), "category", "left")
        .join(firsts(t, "name", 5).withColumnRenamed("firsts", "top"), "category")
        .select("category", "n", F.concat_ws("；", F.coalesce("u", F.array().cast("array<string>"))).alias("use_cases"), "languages", "top")
    )


def subgraph(nodes: DataFrame, edges: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    n = nodes.filter(F.col("category") == category)
    return n, edges.join(n.select(F.col("id").alias("target")), "target", "left_semi")


def find(nodes: DataFrame, term: str) -> DataFrame:
    """The first node, by id, whose label contains the term."""
    return nodes.filter(F.contains(F.lower("label"), F.lower(F.lit(term)))).orderBy("id").limit(1)
