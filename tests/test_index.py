"""The kept index against the tier itself, through changes, compaction and runs that fail or race."""

import pytest
from pyspark.sql import functions as F

from skarn.operators import search as S
from skarn.operators import synonyms
from skarn.operators.index import SearchIndex

TEXTS = ["red widget for python", "blue widget", "green bolt and red bolt", "簡報 工具", "", None, "red red red", "sql database widget", "a much longer text about red bolts, blue nuts and other widgets of steel", "blue"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, ord int, text string")


def asked(spark):
    return S.asked(spark.createDataFrame([("0", "red widget"), ("1", "blue bolt unknown"), ("2", "rag sql"), ("3", ""), ("4", "簡報")], "qid string, query string"))


def rows(df):
    return sorted((r["qid"], r["id"], r["ord"], r["score"], round(r["cos"], 9), round(r["dice"], 9)) for r in df.collect())


def same(spark, index, docs):
    links = synonyms.seed_links(spark)
    full = rows(S.semantic(frame(spark, docs), asked(spark), links, threshold=1e-12))
    assert rows(index.semantic(asked(spark), links)) == [r for r in full if 0.6 * r[4] + 0.4 * r[5] >= 0.03]
    want = {}
    for q, i, o, _, cos, dice in full:
        want.setdefault(q, []).append((-(0.6 * cos + 0.4 * dice), o, i))
    got = {}
    for r in index.best(asked(spark), 3, links).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    for q in want:
        scores = sorted(round(w[0], 7) for w in want[q])[:3]
        assert [round(next(w[0] for w in want[q] if w[2] == i), 7) for i in got[q][: len(scores)]] == scores


def test_changes(spark, tmp_path):
    docs = [(f"d{i}", i, t) for i, t in enumerate(TEXTS)]
    index = SearchIndex(spark, str(tmp_path / "index")).put(frame(spark, docs[:6]))
    index = index.put(frame(spark, docs[6:]))
    changed = [(i, o, "blue bolt of sql" if o in (1, 2) else t) for i, o, t in docs]
    index = index.put(frame(spark, [d for d in changed if d[1] in (1, 2)]))
    same(spark, index, changed)
    same(spark, index.warm(), changed)
    left = [d for d in changed if d[1] not in (0, 2, 9)]
    index = index.remove(frame(spark, [d for d in changed if d[1] in (0, 2, 9)]))
    assert index.n_docs() == len(left) and len(index.segments) == 4
    index = index.put(frame(spark, [changed[0]]))
    left.insert(0, changed[0])
    whole = index.compact()
    assert len(whole.segments) == 1 and len(index.segments) == 5
    same(spark, whole, left)
    same(spark, index, left)  # a search under way keeps its version
    df = {r["term"]: r["df"] for r in whole._frequencies().collect()}
    terms = [t for _, _, x in left for t in set((x or "").replace(",", " ").split())]
    assert df == {t: terms.count(t) for t in terms}


def test_commit(spark, tmp_path):
    """A change that fails leaves the index as it was; of two at once one is told to open it again."""
    path = str(tmp_path / "index")
    empty = SearchIndex(spark, path)
    assert empty.segments == [] and empty.semantic(asked(spark)).count() == 0
    one = empty.put(frame(spark, [("a", 1, "red widget")]))
    with pytest.raises(Exception, match="(?s)."):
        one.put(frame(spark, [("b", 2, "x")]).withColumn("text", F.raise_error("no")))
    assert SearchIndex(spark, path).segments == one.segments
    two = one.put(frame(spark, [("b", 2, "blue widget")]))
    with pytest.raises(RuntimeError, match="another run"):
        one.put(frame(spark, [("c", 3, "c")]))
    assert SearchIndex(spark, path).segments == two.segments
    assert {r["id"] for r in two.docs().collect()} == {"a", "b"}


def test_search_on_index(spark, tmp_path):
    tools = spark.createDataFrame([("a", "Red Widget", 1), ("b", "blue bolt", 2)], "id string, name string, ord long")
    index = SearchIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError, match="category"):
        S.search(tools, spark.createDataFrame([("0", "x")], "qid string, query string"), category="c", index=index)
