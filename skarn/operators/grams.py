"""Substring and edit-distance joins by character grams: no side meets all rows of the other.

A needle of 1, 2 or more characters can only be in texts that have all of its grams of 1, 2 or 3; it is joined by the one that fewest
texts have, and what is found is verified. Texts within an edit distance of k share all but 2k of their bigrams, so of the 2k + 1 rarest
of each they have one in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _grams(text: Column, q: int) -> Column:
    """The distinct runs of q characters, in no order; none if the text is shorter."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1)))
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame, longest: int = 3) -> DataFrame:
    """needle, text_id of each distinct non-empty needle (needle) and each text (text_id, text) that contains it. An empty needle is in none."""
    n = needles.select("needle").filter("needle <> ''").distinct()
    n = n.withColumn("q", F.least(F.length("needle"), F.lit(longest)))
    sizes = [F.explode(F.concat(*[_grams(F.col("text"), q) for q in range(1, longest + 1)])).alias("gram")]
    of_needle = n.select("needle", F.explode(F.coalesce(*[F.when(F.col("q") == q, _grams(F.col("needle"), q)) for q in range(1, longest + 1)])).alias("gram"))
    postings = texts.select("text_id", *sizes).join(of_needle.select("gram").distinct(), "gram", "left_semi")
    # grams that no text has count 0, and so come first: their needles find nothing
    df = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rare = of_needle.join(df, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    found = postings.join(rare, "gram").select("text_id", "needle")
    return found.join(texts.select("text_id", "text"), "text_id").filter(F.contains("text", F.col("needle"))).select("needle", "text_id")


def similar_pairs(texts: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b, similarity of all pairs a < b of distinct texts (text) whose edit similarity, 1 - distance / longer length, is `least` or more.

    least: 0.8 or more; below, short texts need not share any bigram.
    """
    if least < 0.8:
        raise ValueError("edit similarities from 0.8 on are joined by bigrams")
    t = texts.select("text").filter(F.col("text").isNotNull()).distinct()
    # the distance that the longest partner allows
    k = F.floor(F.length("text") * (1 - least) / least + 1e-9).cast("int")
    at = F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1)))
    pairs = F.when(F.length("text") >= 2, F.transform(at, lambda i: F.substr("text", i, F.lit(2)))).otherwise(F.array("text"))
    g = t.select("text", k.alias("k"), F.posexplode(pairs).alias("i", "gram"))
    # a gram's second occurrence in a text is another gram
    turn = Window.partitionBy("text", "gram").orderBy("i")
    g = g.withColumn("turn", F.row_number().over(turn)).drop("i")
    df = g.groupBy("gram", "turn").agg(F.count(F.lit(1)).alias("df"))
    rank = Window.partitionBy("text").orderBy("df", "gram", "turn")
    prefix = g.join(df, ["gram", "turn"]).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= 2 * F.col("k") + 1).select("text", "gram", "turn")
    a, b = prefix.withColumnRenamed("text", "a"), prefix.withColumnRenamed("text", "b")
    near = (F.col("a") < F.col("b")) & (F.least(F.length("a"), F.length("b")) >= least * F.greatest(F.length("a"), F.length("b")) - 1e-9)
    met = a.join(b, ["gram", "turn"]).filter(near).select("a", "b").distinct()
    most = F.greatest(F.length("a"), F.length("b"))
    return met.withColumn("similarity", 1 - F.levenshtein("a", "b") / most).filter(F.col("similarity") >= least)
