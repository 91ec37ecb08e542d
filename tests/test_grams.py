"""Gram joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from skarn.operators import search as S
from skarn.operators.grams import containing, similar_pairs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_containing(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abc 簡é") for _ in range(n))
    texts = [(i, word(rnd.randint(0, 25))) for i in range(120)] + [(500, None), (501, "")]
    needles = [word(rnd.randint(0, 6)) for _ in range(80)] + ["", "zz", None]
    got = containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "text_id long, text string")).collect()
    want = {(n, i) for n in needles if n for i, t in texts if t and n in t}
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("least", [0.85, 0.8])
def test_similar_pairs(spark, least):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcd") for _ in range(n)) for n in (1, 2, 3, 4, 6, 7, 8, 12, 13, 20, 27, 40) for _ in range(6)]
    texts = set(base)
    for t in base:
        for _ in range(3):
            s = list(t)
            for _ in range(rnd.randint(1, 1 + len(t) // 8)):
                i = rnd.randrange(len(s) + 1)
                s[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "b"])
            texts.add("".join(s))
    got = similar_pairs(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), least).collect()
    want = {(a, b) for a in texts for b in texts if a < b and 1 - edits(a, b) / max(len(a), len(b)) >= least}
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want) and len(want) > 50


def test_keyword_for_many(spark, monkeypatch):
    """More queries than are looked at one by one score as those do, empty and short fields included."""
    rows = [
        ("a", ["red widget", "rw"], ["Tools"], "A red widget", ["fast-io"], None, None, ["blue sky"], [("red part", "for widgets")], 1),
        ("b", ["", "x"], ["x y"], "", None, "used for x", ["cheap"], None, None, 2),
        ("c", None, [], None, None, None, None, None, [("blue", "blue part")], 3),
        ("d", ["簡報"], ["文件"], "簡報 製作", None, "ppt", [], ["a"], None, 4),
    ]
    tools = spark.createDataFrame(rows, "id string, triggers array<string>, category array<string>, description string, capabilities array<string>, useCase string, advantages array<string>, negativeConstraints array<string>, subTools array<struct<name:string,description:string>>, ord long").withColumn("name", F.col("id"))
    asked = S.asked(spark.createDataFrame([(str(i), q) for i, q in enumerate(["red widget", "blue part", "x", "rw", "做簡報", "cheap fast", "blue sky rw", "", "zzz", "used for ppt"])], "qid string, query string"))
    one_by_one = sorted(map(str, S.keyword(tools, asked).collect()))
    monkeypatch.setattr(S, "FEW", 3)
    many = S.keyword(tools, asked)
    assert sorted(map(str, many.collect())) == one_by_one and len(one_by_one) > 10


def test_equal_tools_score_once(spark):
    """Copies of a tool are one group in both tiers, and come out each with the score that it has by itself; fields are not run together."""
    kinds = [(["ab"], [], "red widget"), (["a", "b"], [], "red widget"), (["a"], ["b"], "red widget"), ([], None, "blue bolt")]
    rows = [(f"t{i}", "x", *kinds[i % 4], i) for i in range(20)]
    tools = spark.createDataFrame(rows, "id string, name string, triggers array<string>, capabilities array<string>, description string, ord long")
    for c in ("category", "advantages", "negativeConstraints"):
        tools = tools.withColumn(c, F.lit(None).cast("array<string>"))
    tools = tools.withColumn("useCase", F.lit(None).cast("string")).withColumn("subTools", F.lit(None).cast("array<struct<name:string,description:string>>"))
    assert S.alike(tools, *S.KEYWORD_FIELDS)[0].count() == 4
    asked = S.asked(spark.createDataFrame([("0", "red ab widget"), ("1", "blue")], "qid string, query string"))
    # the first query meets the three red kinds, the second the blue one and, by its trigger b, another
    assert S.keyword(tools, asked).count() == 25
    got = sorted(map(str, S.semantic_of_tools(tools, asked).collect()))
    assert got == sorted(map(str, S.semantic(S.tool_text(tools), asked).collect())) and len(got) >= 20


def test_split_as_separator():
    """The faster pattern of steps finds what the stated one finds."""
    import re

    from skarn.plans import planner

    assert "(?i)" not in planner.SPLIT
    rnd = random.Random(9)
    for _ in range(3000):
        text = "".join(rnd.choice(["然後", "接著", "步驟", "12", ":", "：", "->", "=>", "-", ">", "；", "\n", "，", ",", "與此同時", "與", "A", "b", " "]) for _ in range(12))
        assert re.split(planner.SPLIT, text) == re.split(planner.SEPARATOR, text)
