"""Fill-in-the-middle against plain Python: units by findall, boundaries by hashlib, texts read back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skarn.llm import infill

TEXTS = ["", "\n", "\n\n", "a", "a\n", "a\nb", "\na\n\n\nb\n", "one two  three\t\n four ", " x", "x ", "ab_1--c!!d", "😀 é\n☃😀\n", "a\r\nb\rc\n", "p\n\nq\nr\n\n\ns", "\x00\x0b\x85 z\n"]


@pytest.mark.parametrize("grammar", sorted(infill.GRAMMARS))
def test_units(spark, grammar):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string").select("i", "t", infill.units(F.col("t"), grammar).alias("u")).collect()
    for r in got:
        assert r["u"] == re.findall(infill.GRAMMARS[grammar][0], r["t"]), (grammar, r["t"])
        assert "".join(r["u"]) == r["t"]


def brute(doc_id, text, rate=100, spm=50):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(u), "plain", None, None, None, t)
    return (doc_id, len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (doc_id, len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_rows(spark, odd, rate, spm):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*TEXTS, "a<P>b\nc", "<S>", "x\n<M>", "a<\nP>\n<", "<<P\n>S>", None])], "doc_id long, text string")
    docs = odd.select("doc_id", "text", F.lit(1).alias("units"), F.lit("x").alias("h1"), F.lit("y").alias("form")).unionByName(more, allowMissingColumns=True)
    out = infill.infill(docs, rate=rate, spm=spm)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((brute(r["doc_id"], r["text"], rate, spm) for r in docs.collect()), key=key)
    back = out.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=key)


def test_sentinels(spark, odd, nothing):
    assert infill.infill(nothing).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "c", "d"), ("ab", "bc", "d"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            infill.infill(odd, marks=marks)
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    out = infill.infill(odd, "words", marks=marks)
    back = {r["doc_id"]: r["t"] for r in out.filter("doc_id is not null").select("doc_id", infill.restored(F.col("output"), F.col("form"), marks).alias("t")).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in odd.filter("doc_id is not null").collect()}
    assert out.filter("form <> 'plain'").count() > 30
