"""The driver's tables as the inputs that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.calendar import week_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools from parts."""
    p = table(spark, sf_dir, "part")
    some = lambda every, value: F.when(F.col("p_size") % every == 0, value)
    return p.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("https://github.com/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("url"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"),
        F.array("p_type").alias("category"),
        F.lower("p_brand").alias("language"),
        F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))).alias("triggers"),
        F.when(F.col("p_partkey") % 10 == 0, "deprecated").when(F.col("p_partkey") % 10 == 1, "experimental").otherwise("active").alias("status"),
        F.coalesce(some(3, F.array(F.concat(F.lower("p_type"), F.lit("-kit")))), F.array().cast("array<string>")).alias("capabilities"),
        F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("rag "), "p_type")).alias("useCase"),
        F.coalesce(some(2, F.array("p_brand")), F.array().cast("array<string>")).alias("advantages"),
        F.coalesce(some(7, F.array(F.split("p_name", " ")[0])), F.array().cast("array<string>")).alias("negativeConstraints"),
        F.floor(F.col("p_retailprice") * 10).cast("long").alias("stars"),
        F.coalesce(some(4, F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.lit("sub").alias("subpath")))), F.array().cast("array<struct<name:string,description:string,subpath:string>>")).alias("subTools"),
        F.col("p_partkey").cast("long").alias("ord"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution traces from events: a tool each, errors as failures."""
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row: the number of parts
    return e.select(
        F.concat(F.lit("part-"), (F.col("event_id") % F.col("n")).cast("string")).alias("tool_id"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration"), "ts", "event_id"
    )


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search and click log from events."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "error", "abandon")
    return e.select(kind.alias("type"), k.alias("query"), F.concat_ws(":", F.col("user_id").cast("string"), k).alias("user_query"), "ts", F.col("event_id").alias("seq")).filter("type is not null")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly star counts: cumulative orders of each nation, in weeks where it has any."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    per = o.groupBy(week_of(F.col("o_orderdate")).alias("week"), F.col("n_name").alias("full_name")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("full_name").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("week", "full_name", F.sum("n").over(upto).alias("stars"))
