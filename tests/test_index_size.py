"""What a change of the kept index writes: each text once, and only ids that are really taken away."""

import os

from skarn.operators.index import SearchIndex


def test_written(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = lambda *ids: spark.createDataFrame([(f"d{i}", i, f"red widget {i}") for i in ids], "id string, ord long, text string").coalesce(1)
    index = SearchIndex(spark, path).put(docs(0, 1, 2))
    assert sorted(os.listdir(f"{path}/{index.segments[0]}")) == ["df", "docs", "gone"]
    index = index.put(docs(3)).put(docs(1, 4))
    gone = [{r["id"] for r in spark.read.parquet(f"{path}/{s}/gone").collect()} for s in index.segments]
    assert gone == [set(), set(), {"d1"}] and index.n_docs() == 5
