"""Synonym mining from terms that tools list together. Tables: links (term, synonym)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions.text import norm

COMMON, GROUP, KEPT = 5, 8, 8
# Short words that join the group of a mined one, and seeds that mining does not find.
ALIASES = {"安全": "漏洞", "測試": "自動化測試", "檔案": "檔案系統", "影片": "影片生成"}
SEEDS = {
    "翻譯": ["translate", "translation", "localization", "在地化", "本地化"],
    "translate": ["翻譯", "translation", "localization", "在地化"],
    "translation": ["翻譯", "translate", "localization"],
    "資料分析": ["data analysis", "analytics", "dashboard"],
    "data analysis": ["資料分析", "analytics", "dashboard"],
    "analytics": ["資料分析", "data analysis", "dashboard"],
    "dashboard": ["資料分析", "data analysis", "analytics"],
    "知識庫": ["knowledge base", "rag", "vector db"],
    "knowledge base": ["知識庫", "rag", "vector db"],
    "rag": ["知識庫", "knowledge base", "vector db"],
    "vector db": ["知識庫", "knowledge base", "rag"],
    "API 呼叫": ["api call", "rest", "graphql", "webhook"],
    "api call": ["API 呼叫", "rest", "graphql", "webhook"],
    "rest": ["api", "api call", "graphql", "webhook"],
    "graphql": ["api", "api call", "rest", "webhook"],
    "webhook": ["api", "api call", "rest", "graphql"],
    "自動化腳本": ["automation script", "workflow automation"],
    "automation script": ["自動化腳本", "workflow automation"],
    "workflow automation": ["自動化腳本", "automation script"],
    "程式碼生成": ["code generation", "codegen", "scaffold"],
    "code generation": ["程式碼生成", "codegen", "scaffold"],
    "codegen": ["程式碼生成", "code generation", "scaffold"],
    "scaffold": ["程式碼生成", "code generation", "codegen"],
    "文件轉換": ["document conversion", "docx", "pdf generation"],
    "document conversion": ["文件轉換", "docx", "pdf generation"],
    "pdf generation": ["文件轉換", "docx", "document conversion"],
    "網頁爬蟲": ["web scraping", "crawler", "browser automation"],
    "web scraping": ["網頁爬蟲", "crawler", "browser automation"],
    "crawler": ["網頁爬蟲", "web scraping", "browser automation"],
    "JSON": ["json", "格式轉換", "data format"],
    "json": ["JSON", "格式轉換", "data format"],
    "XML": ["xml", "格式轉換", "markup"],
    "xml": ["XML", "格式轉換", "markup"],
    "資料庫": ["database", "sql", "db"],
    "database": ["資料庫", "sql", "db"],
    "sql": ["資料庫", "database", "db"],
    "db": ["資料庫", "database", "sql"],
    "命令列": ["cli", "command line", "terminal"],
    "cli": ["命令列", "command line", "terminal"],
    "command line": ["命令列", "cli", "terminal"],
    "terminal": ["命令列", "cli", "command line"],
}


def is_chinese(term: Column) -> Column:
    return F.rlike(term, F.lit("[\\u4e00-\\u9fff]"))


def seed_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, s) for t, ss in SEEDS.items() for s in ss], "term string, synonym string")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table({"alias": list(ALIASES), "target": list(ALIASES.values())}))  # of known size, so Spark may broadcast it


def frequencies(tools: DataFrame) -> DataFrame:
    return _terms(tools).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _terms(tools: DataFrame) -> DataFrame:
    return tools.select("id", F.explode("triggers").alias("term")).withColumn("term", norm(F.col("term"))).filter("term <> ''").distinct()


def pairs(tools: DataFrame) -> DataFrame:
    """(zh, en, n): how many tools list a Chinese and another term together, neither being common."""
    t = _terms(tools).join(frequencies(tools).filter(F.col("df") <= COMMON).select("term"), "term")
    zh, en = t.filter(is_chinese(F.col("term"))).select("id", F.col("term").alias("zh")), t.filter(~is_chinese(F.col("term"))).select("id", F.col("term").alias("en"))
    return zh.join(en, "id").groupBy("zh", "en").agg(F.count(F.lit(1)).alias("n"))


def widen(links: DataFrame) -> DataFrame:
    """(term, synonym), with repetitions: links, and links among the neighbours of each term that has 2 to GROUP of them (one hop, no further)."""
    near = links.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("term"))).filter(F.col("n").between(2, GROUP))
    group = near.groupBy("term").agg(F.collect_list("synonym").alias("group")).select(F.explode("group").alias("term"), "group")
    return links.union(group.select("term", F.explode("group").alias("synonym")).filter("term <> synonym"))


def adopt(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links of each alias with its target and all of the target's neighbours, both ways."""
    both = links.join(aliases, F.col("term") == F.col("target")).select("alias", F.explode(F.array("synonym", "target")).alias("m")).distinct()
    return both.select(F.explode(F.array(F.struct(F.col("alias").alias("term"), F.col("m").alias("synonym")), F.struct(F.col("m").alias("term"), F.col("alias").alias("synonym")))).alias("l")).select("l.*")


def mine(tools: DataFrame, seeds: DataFrame | None = None, aliases: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(term, synonym, pos): at most KEPT synonyms for each term, mined ones in order of their name before seeds."""
    return mined(pairs(tools), seeds, aliases, least)


def mined(pairs_: DataFrame, seeds: DataFrame | None = None, aliases: DataFrame | None = None, least: int = 1) -> DataFrame:
    """As mine, from counted pairs (zh, en, n)."""
    both = F.array(F.struct(F.col("zh").alias("term"), F.col("en").alias("synonym")), F.struct(F.col("en").alias("term"), F.col("zh").alias("synonym")))
    links = widen(pairs_.filter(F.col("n") >= least).select(F.explode(both).alias("l")).select("l.*")).withColumn("prio", F.lit(0))
    if seeds is not None:
        links = links.union(seeds.select("term", "synonym", F.lit(1)))
    if aliases is not None:
        links = links.union(adopt(links, aliases).withColumn("prio", F.lit(2)))
    # one shuffle, by term, for the least prio of each link and for the order
    links = links.repartition("term").groupBy("term", "synonym").agg(F.min("prio").alias("prio"))
    w = Window.partitionBy("term").orderBy("prio", "synonym")
    return links.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= KEPT).select("term", "synonym", "pos")
