"""Task planning: a task is split into steps, and all steps are searched at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import bind
from skarn.operators import search as S
from skarn.operators.classify import formats

# What separates steps, what is trimmed off them, and the verbs that open them.
SEPARATOR = r"(?i)(?:然後|接著|轉成|發送|生成|產出|步驟\d+[:：]?|->|=>|；|;|\n|與此同時|，|,)+"
#: SEPARATOR as Java matches it fast: no letter in it has a case, and single characters are one class.
SPLIT = r"(?:[；;\n，,]|然後|接著|轉成|發送|生成|產出|步驟\d+[:：]?|->|=>|與此同時)+"
EDGES = r"^[\s，,。.；;：:、!！?？]+|[\s，,。.；;：:、!！?？]+$"
LEADING, TRAILING = "^(並|並且|且|與|或|接著|然後)+", "(並|並且|且|與|或)+$"
VERB = r"^(抓取|爬取|下載|解析|提取|生成|製作|發送|處理|分析|建立)\s*"
# Words that an interview answer adds to a query.
LANGUAGE_ANSWERS = {"1": "python", "2": "typescript", "3": "java"}
SCENARIO_ANSWERS = {"1": "rag llm markdown 知識庫 摘要", "2": "testing e2e test 自動化按鈕 測試", "3": "pipeline async 併發 大量", "4": "dom html 標籤"}
FEATURE_ANSWERS = {"1": "動態 渲染 javascript spa"}


def segments(task: Column) -> Column:
    clean = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, EDGES, ""), LEADING, ""), TRAILING, "")
    parts = F.filter(F.transform(F.split(task, SPLIT), clean), lambda s: s != "")
    return bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(task)))


def steps(tools: DataFrame, tasks: DataFrame, stats: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """task_id, step, action, tool, alternatives, input_format, output_format for tasks (task_id, task)."""
    seg = tasks.select("task_id", F.posexplode(segments(F.col("task"))).alias("i", "action"))
    seg = seg.select("task_id", (F.col("i") + 1).alias("step"), "action", F.concat_ws("#", F.col("task_id").cast("string"), F.col("i").cast("string")).alias("qid"))
    cleaned = F.regexp_replace("action", VERB, "")
    hits = S.search(tools, seg.select("qid", F.when(F.length(cleaned) > 0, cleaned).otherwise(F.col("action")).alias("query")), 3, stats=stats, synonyms=synonyms)
    best = hits.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("tool"), F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "id"))))["id"].alias("alternatives"))
    out = seg.join(best, "qid", "left").join(tools.select(F.col("id").alias("tool"), F.concat_ws(" ", "category").alias("cat")), "tool", "left")
    f = formats(F.col("cat"))
    return out.select("task_id", "step", "action", "tool", F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"), f["input_format"].alias("input_format"), f["output_format"].alias("output_format"))


def pipeline(steps_: DataFrame) -> DataFrame:
    """task_id, n_steps, the steps' tools as one arrow line."""
    rows = steps_.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("step", F.coalesce("tool", F.lit("?")).alias("t")))).alias("s"))
    return rows.select("task_id", F.size("s").cast("long").alias("n_steps"), F.array_join(F.col("s")["t"], " -> ").alias("pipeline"))


def interview_query(base: str, language: str = "", scenario: str = "", feature: str = "") -> str:
    """The query that the interview's answers make of a first wish."""
    parts = [base or "工具", LANGUAGE_ANSWERS.get(language, ""), SCENARIO_ANSWERS.get(scenario, ""), FEATURE_ANSWERS.get(feature, "")]
    return " ".join(p for p in parts if p)
