"""Hand-worked cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skarn.functions import calendar as C
from skarn.functions import text as X
from skarn.operators import behaviour, contract, graph, jobs, synonyms, telemetry, trending
from skarn.operators import search as S
from skarn.plans import planner

TOOL = (
    "id string, name string, url string, description string, category array<string>, language string, triggers array<string>, status string, capabilities array<string>, useCase string, "
    "advantages array<string>, negativeConstraints array<string>, stars long, subTools array<struct<name:string,description:string,subpath:string>>, ord long"
)


def tool(**k):
    base = dict(id="t", name="t", url="u", description=None, category=[], language=None, triggers=[], status="active", capabilities=[], useCase=None, advantages=[], negativeConstraints=[], stars=None, subTools=[], ord=0)
    return tuple({**base, **k}[c.split()[0]] for c in TOOL.replace("struct<name:string,description:string,subpath:string>", "x").split(", "))


def value(spark, column, **row):
    keys = list(row)
    return spark.createDataFrame([tuple(row[k] for k in keys)], ", ".join(f"{k} string" for k in keys)).select(column.alias("v")).first()["v"]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_text(spark):
    assert value(spark, X.norm(F.col("t")), t="　A  B﻿") == "a b"
    assert value(spark, X.norm(F.col("t")), t=None) == ""
    assert value(spark, X.tokens(X.norm(F.col("t"))), t="網頁爬蟲-Red, red！x") == ["網頁爬蟲", "red", "x", "網頁", "爬蟲"]
    assert value(spark, X.bigrams(X.norm(F.col("t"))), t="A b ab") == ["ab", "ba"]
    assert value(spark, X.bigrams(X.norm(F.col("t"))), t="") == [""]
    assert value(spark, X.any_word(F.col("t"), "python|py"), t="用python做") is True
    assert value(spark, X.strip_spoken(F.col("t")), t="我想要做簡報") == "要做簡報"
    assert value(spark, X.round_to(F.lit(1.005), 2), t="") == 1.0
    assert value(spark, X.fnv1a(F.col("t"), F.lit(2166136261)), t="ab") == 1294271946


@pytest.mark.parametrize("day, week", [("2026-08-05", "2026-W32"), ("2026-08-10", "2026-W33"), ("2026-08-16", "2026-W33"), ("2027-01-01", "2026-W53")])
def test_weeks(spark, day, week):
    assert value(spark, C.week_of(F.to_date("d")), d=day) == week


def test_week_inverse(spark):
    r = value(spark, C.range_of(F.col("w")), w="2026-W32")
    assert (r["monday"], r["sunday"]) == (date(2026, 8, 3), date(2026, 8, 9))
    assert value(spark, C.range_of(F.col("w")), w="no week") is None
    assert value(spark, C.previous_week(F.to_date("d")), d="2026-08-15") == "2026-W32"


def test_search_category_list(spark):
    t = spark.createDataFrame([tool(id="t1", category=["多媒體生成", "AI助手"], triggers=["ai"]), tool(id="t2", category=["多媒體生成"], triggers=["video"], ord=1), tool(id="t3", triggers=["ai"], ord=2)], TOOL)
    q = spark.createDataFrame([("0", "ai")], "qid string, query string")
    got = S.search(t, q, category="多媒體生成").collect()
    assert [(r["id"], r["score"], r["level"]) for r in got if r["level"] == "L2-keyword"] == [("t1", 0.57, "L2-keyword")]
    for rate, score in ((0.9, 0.68), (0.2, 0.06)):
        stats = spark.createDataFrame([("t1", 5, rate)], "tool_id string, total long, success_rate double")
        assert S.search(t, q, 1, category="多媒體生成", stats=stats).first()["score"] == score


def test_exact_hit_wins(spark):
    q = spark.createDataFrame([("0", "cache registry test")], "qid string, query string")
    for i in ("cache-alpha", "cache-beta"):
        got = S.search(spark.createDataFrame([tool(id=i, name="cache registry test")], TOOL), q).collect()
        assert [(r["id"], r["score"], r["level"]) for r in got] == [(i, 1.0, "L1-exact")]


def test_nonsense_finds_nothing(spark):
    t = spark.createDataFrame([tool(triggers=["ai"], description="some words")], TOOL)
    assert S.search(t, spark.createDataFrame([("0", "qqqzzzxxx")], "qid string, query string")).count() == 0


def test_contract(spark):
    full = dict(url="u", description="A long enough description", category=["c"], language="python", triggers=["a", "b"], useCase="x", advantages=["y"], negativeConstraints=["z"])
    weak = {**full, "description": "Too short", "triggers": ["m"], "useCase": "", "advantages": [], "negativeConstraints": []}
    got = contract.contract(spark.createDataFrame([tool(id="f", **full), tool(id="w", **weak)], TOOL))
    assert [(r["id"], r["quality_score"], r["grade"], len(r["errors"]), len(r["warnings"])) for r in got.orderBy("id").collect()] == [("f", 100, "A", 0, 0), ("w", 15, "F", 0, 5)]


def test_ranking(spark):
    live = spark.createDataFrame([("x", 1100, 0, date(2020, 1, 1)), ("y", 600, 1, date(2020, 1, 1)), ("z", 300, 2, date(2026, 8, 1)), ("w", 9999, 3, date(2024, 1, 1))], "full_name string, stars long, ord int, created_at date")
    base = spark.createDataFrame([("x", 1000), ("y", 100)], "full_name string, stars long")
    assert [(r["full_name"], r["delta"]) for r in trending.ranking(live, base, True, "2026-08-09").collect()] == [("z", 300), ("x", 100)]
    assert [(r["full_name"], r["delta"]) for r in trending.ranking(live, base, False).collect()] == [("x", 100)]


def test_behaviour(spark):
    ts = lambda s: datetime(2024, 1, 1, 0, 0, s)
    log = [("click", "q", ts(0), 1), ("search", "q", ts(1), 2), ("search", "q", ts(2), 3), ("search", "q", ts(3), 4), ("search", "a", ts(0), 5), ("click", "a", ts(30), 6), ("search", "r", ts(0), 7), ("click", "r", ts(31), 8)]
    log = spark.createDataFrame(log, "type string, query string, ts timestamp, seq long")
    assert rows(behaviour.unmet(log, 3), "query", "searches") == [("q", 3)]
    assert rows(behaviour.success_rate(log), "query", "rate") == [("a", 1.0), ("q", 0.0), ("r", 0.0)]


def test_synonyms(spark):
    t = spark.createDataFrame([("A", ["簡報", "ppt", "slides"]), ("B", ["簡報", "ppt"])], "id string, triggers array<string>")
    got = {}
    for r in synonyms.mine(t).collect():
        got.setdefault(r["term"], set()).add(r["synonym"])
    assert got == {"簡報": {"ppt", "slides"}, "ppt": {"簡報", "slides"}, "slides": {"簡報", "ppt"}}


def test_graph(spark):
    t = spark.createDataFrame([("a", "a", "x", 0, list("12345")), ("b", "b", "x", 1, []), ("c", "c", "y", 2, []), ("d", "d", None, 3, [])], "id string, name string, category string, ord long, subs array<string>")
    n, e = graph.nodes_and_edges(t)
    assert (n.count(), e.count()) == (9, 8)


def test_jobs(spark):
    got = [value(spark, jobs.timeout_ms(F.col("s").cast("int")), s=x) for x in (None, "30", "999")]
    assert got == [120_000, 30_000, 600_000]
    j = spark.createDataFrame([("p", "pending"), ("c", "completed")], "job_id string, status string")
    w = spark.createDataFrame([("p",), ("c",), ("m",)], "job_id string")
    assert rows(jobs.cancel(j, w), "job_id", "outcome") == [("c", "already finished"), ("m", "not found"), ("p", "ok")]


def test_telemetry(spark):
    t = spark.createDataFrame([("x", True), ("x", True), ("x", False)], "tool_id string, success boolean")
    r = telemetry.stats(t).first()
    assert (r["total"], r["success"], r["fail"], round(r["success_rate"], 4)) == (3, 2, 1, 0.6667)


def test_segments(spark):
    assert value(spark, planner.segments(F.col("t")), t="抓取動態網頁內容並轉成簡報") == ["抓取動態網頁內容", "簡報"]
    assert value(spark, planner.segments(F.col("t")), t="，") == ["，"]


def test_success_rate_in_proportion(spark):
    """One query with many rows: four times the rows take about four times as long, not sixteen."""
    import time

    from skarn.operators import behaviour

    def took(n):
        log = spark.range(n).select(F.when(F.col("id") % 3 == 0, "click").otherwise("search").alias("type"), F.lit("q").alias("query"), F.timestamp_seconds(F.col("id") * 20).alias("ts"), F.col("id").alias("seq"))
        start = time.perf_counter()
        r = behaviour.success_rate(log, 30).first()
        return time.perf_counter() - start, r

    took(1000)
    small, big = took(50_000), took(200_000)
    assert big[0] < 10 * small[0] + 2
    # of two searches in a row only the second has the next click within 30 s
    assert abs(big[1]["rate"] - 0.5) < 0.01


def test_plain_prefilter(spark):
    """The literal look before a category's pattern never hides a match."""
    from skarn.functions.text import any_word
    from skarn.operators import classify

    words = sorted({w.replace(r"\\.?", "-").replace("\\.", ".").replace(".", "x") for rule, _ in classify.REPOSITORY_RULES for w in rule.split("|")})
    texts = [f"a {w} b" for w in words] + [w.replace("-", "") for w in words] + ["data-analy", "autogpt", "language model", "cicd", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rule, _ in classify.REPOSITORY_RULES:
        assert df.filter(any_word(F.lower("t"), rule) & ~classify._may_match(F.lower("t"), rule)).count() == 0
