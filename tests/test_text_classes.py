"""The character classes of the tokens against their plain form, and work that is dealt to all cores."""

from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import search as S

PLAIN = r"\s\x0b\xa0  -     　﻿"


def test_classes(spark):
    points = spark.range(1, 0x11000).filter("id < 55296 OR id > 57343").select(F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), "UTF-8"), "UTF-8").alias("c"))
    for now, plain in ((X.SPACE, f"[{PLAIN}]"), (X.SEPARATORS, rf"[{PLAIN},，。、；;：:!！?？\-_/\\]+")):
        is_in = points.select(F.rlike("c", F.lit(now)).alias("a"), F.rlike("c", F.lit(plain)).alias("b"))
        assert is_in.filter("a <> b").count() == 0 and is_in.filter("a").count() > 15
    squeezed = spark.createDataFrame([("A　 b\tc d \xa0e",)], "t string").select(X.bigrams(X.norm(F.col("t"))), X.terms_and_grams(F.col("t"))).first()
    assert squeezed[0] == squeezed[1]["grams"] == ["ab", "cd", "bc", "de"] and squeezed[1]["terms"] == ["a", "b", "c", "d", "e"]


def test_one_file_is_dealt(spark, tmp_path):
    """Texts in one row group are not tokenised by one task."""
    spark.range(40).selectExpr("cast(id as string) id", "id ord", "concat('red widget ', id) text").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert docs.rdd.getNumPartitions() == 1 and X.dealt(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = S.cosine(docs, S.asked(spark.createDataFrame([("0", "red widget 7")], "qid string, query string")))
    assert "RoundRobinPartitioning" in got._jdf.queryExecution().toString()
    assert got.orderBy(F.desc("cos")).first()["id"] == "7" and got.count() == 40
