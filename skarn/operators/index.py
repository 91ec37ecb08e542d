"""A kept search index: segments that are added to, not rewritten.

Each change of the documents is one more segment; none is ever altered. A segment has

* `docs` (id, ord, terms, grams): what each document has, tokenised once; a search reads the one or the other column. Nearly every document has
  some of a query's bigrams, so lists by bigram and by term held little back, and sorting them took most of a build,
* `df` (term, df): how many more documents have a term; removed ones count against it, so sums over segments are right,
* `gone` (id): documents of earlier segments that it takes away, among them those that it puts anew.

The manifest of a version, a one-line file that lists its segments, is written last and makes a change visible; a change that fails
before leaves nothing but an unused folder. `compact` writes all live documents as one segment.

Scores are those of the third search tier. What a document shares with the query gives bounds on its score: its length is at least that of the terms
that it shares with the query and one for each other term, at most with the largest weight for each. Only documents that can
reach the threshold (or the k best) have their terms weighed; and none where `warm` has written the lengths of all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions.text import bigrams, dealt, round_to, terms_and_grams
from skarn.operators.search import THRESHOLD, expand

DOCS = "id string, ord long, terms array<string>, grams array<string>"
#: Terms of a stated set of queries up to which they are written into the scan as literals; beyond, scans are joined only.
LITERALS = 2000
#: The most frequent terms, whose weights are sent to every task: their share of all terms of all documents is large, and is weighed in place.
FREQUENT = 20_000


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        """Opens the newest version below path; there may be none yet."""
        self.spark, self.path = spark, path
        self._n: int | None = None
        p, fs = _path(spark, f"{path}/manifest")
        found = sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []
        self.version = found[-1] if found else 0
        self.segments: list[str] = json.loads(spark.read.text(f"{path}/manifest/{self.version}", wholetext=True).first()[0]) if found else []

    def _commit(self, segments: list[str]) -> SearchIndex:
        """The next version; one that another writer has committed meanwhile is not overwritten."""
        p, fs = _path(self.spark, f"{self.path}/manifest/{self.version + 1}")
        fs.mkdirs(p.getParent())
        hidden, _ = _path(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(hidden)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(hidden, p):
            fs.delete(hidden, False)
            raise RuntimeError(f"version {self.version + 1} of {self.path} was written by another run: open the index again")
        return SearchIndex(self.spark, self.path)

    def _read(self, table: str, schema: str, segments: list[str] | None = None) -> DataFrame:
        """A table of all segments, each row with the number of its segment."""
        out = self.spark.range(0).select(F.from_json(F.lit("{}"), f"{schema}, segment int").alias("r")).select("r.*")
        for i, s in enumerate(self.segments if segments is None else segments):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{table}").withColumn("segment", F.lit(i)))
        return out

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows (id, segment, ...) without those of documents that a later segment takes away."""
        if len(self.segments) < 2:
            return rows
        gone = self._read("gone", "id string").groupBy("id").agg(F.max("segment").alias("until"))
        return rows.join(gone, "id", "left").filter(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")

    def docs(self) -> DataFrame:
        """id, ord, terms, grams of every document."""
        return self._live(self._read("docs", DOCS)).drop("segment")

    def n_docs(self) -> int:
        if self._n is None:
            self._n = self._live(self._read("docs", DOCS).select("id", "segment")).count()
        return self._n

    def put(self, docs: DataFrame) -> SearchIndex:
        """docs (id, ord, text) added, or put in place of those with the same id."""
        return self._segment(docs, docs.select("id"))

    def remove(self, ids: DataFrame) -> SearchIndex:
        return self._segment(ids.limit(0).select(F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("text")), ids.select("id"))

    def _segment(self, docs: DataFrame, gone: DataFrame) -> SearchIndex:
        name = f"segment-{self.version + 1}-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        parts = terms_and_grams(F.col("text")).alias("x")
        dealt(docs).select("id", F.col("ord").cast("long").alias("ord"), parts).select("id", "ord", "x.*").write.parquet(f"{at}/docs")
        change = self.spark.read.schema(DOCS).parquet(f"{at}/docs").select(F.explode("terms").alias("term"), F.lit(1).alias("by"))
        if self.segments:
            # only ids move until it is known which segments lose something
            live = self._live(self._read("docs", DOCS).select("id", "segment"))
            live.join(gone.select("id").distinct(), "id", "left_semi").select("id", "segment").write.parquet(f"{at}/gone")
            lost = self.spark.read.schema("id string, segment int").parquet(f"{at}/gone")
            for n in sorted(r[0] for r in lost.select("segment").distinct().collect()):
                old = self.spark.read.schema(DOCS).parquet(f"{self.path}/{self.segments[n]}/docs").join(lost.filter(F.col("segment") == n), "id", "left_semi")
                change = change.union(old.select(F.explode("terms"), F.lit(-1)))
        else:
            self._none_gone(at)
        change.groupBy("term").agg(F.sum("by").alias("df")).filter("df <> 0").write.parquet(f"{at}/df")
        return self._commit([*self.segments, name])

    def _none_gone(self, at: str) -> None:
        self.spark.range(0).select(F.lit("").alias("id")).write.parquet(f"{at}/gone")

    def compact(self) -> SearchIndex:
        """All live documents as one segment, from what is there; older folders stay for searches under way."""
        name = f"segment-{self.version + 1}-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        self.docs().write.parquet(f"{at}/docs")
        self._frequencies().write.parquet(f"{at}/df")
        self._none_gone(at)
        return self._commit([name])

    def _frequencies(self) -> DataFrame:
        return self._read("df", "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def weights(self) -> DataFrame:
        """term, idf."""
        return self._frequencies().select("term", (F.ln((self.n_docs() + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def _bounded(self, queries: DataFrame, synonyms: DataFrame | None) -> DataFrame:
        """qid, id, segment, dot, qn, dice and bounds `low` and `high` of the score. queries: qid, nq, toks."""
        terms = queries.select("qid", F.explode("toks").alias("token"))
        terms = (expand(terms, synonyms) if synonyms is not None else terms.distinct()).withColumnRenamed("token", "term")
        asked_grams = queries.select("qid", bigrams(F.col("nq")).alias("g")).select("qid", F.size("g").alias("n_asked"), F.explode("g").alias("gram"))

        def wanted(by: DataFrame) -> list[str]:
            """The values as literals, where they are few: a scan then skips row groups."""
            some = [r[0] for r in by.distinct().limit(LITERALS + 1).collect()]
            return some if len(some) <= LITERALS else []

        def narrowed(table: DataFrame, column: str, some: list[str]) -> DataFrame:
            return table.filter(F.col(column).isin(some)) if some else table

        words = wanted(terms.select("term"))
        sought = F.broadcast(terms.agg(F.collect_set("term").alias("words")).crossJoin(asked_grams.agg(F.collect_set("gram").alias("pairs"))))  # one row: a stated set of queries
        docs = self._read("docs", DOCS).crossJoin(sought)
        n = self.n_docs()
        q = terms.join(narrowed(self.weights(), "term", words), "term", "left").select("qid", "term", F.coalesce("idf", F.lit(1.0)).alias("qw"))
        qn = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
        hits = docs.select("id", "segment", F.size("terms").alias("n_terms"), F.explode(F.array_intersect("terms", "words")).alias("term")).join(q, "term")
        dot = hits.groupBy("qid", "id", "segment").agg(F.sum(F.col("qw") * F.col("qw")).alias("dot"), (F.first("n_terms") - F.count(F.lit(1))).alias("rest"))
        both = docs.select("id", "segment", F.size("grams").alias("n_grams"), F.explode(F.array_intersect("grams", "pairs")).alias("gram")).join(asked_grams, "gram")
        dice = both.groupBy("qid", "id", "segment").agg((2.0 * F.count(F.lit(1)) / (F.first("n_grams") + F.first("n_asked"))).alias("dice"))
        x = self._live(dot.join(dice, ["qid", "id", "segment"], "full")).join(qn, "qid", "left")
        x = x.withColumn("dot", F.coalesce("dot", F.lit(0.0))).withColumn("rest", F.coalesce("rest", F.lit(0))).withColumn("dice", F.coalesce("dice", F.lit(0.0)))
        most = (F.ln(F.lit((n + 1) / 2)) + 1) if n else F.lit(1.0)
        cos = lambda weight: F.coalesce(F.try_divide(F.col("dot"), F.col("qn") * F.sqrt(F.col("dot") + F.col("rest") * weight * weight)), F.lit(0.0))
        return x.withColumn("low", 0.6 * cos(most) + 0.4 * F.col("dice")).withColumn("high", 0.6 * cos(F.lit(1.0)) + 0.4 * F.col("dice"))

    def warm(self) -> SearchIndex:
        """Writes the length of every document's vector in this version, which depends on all others; searches then need no terms at all."""
        if self.segments and not self._warm():
            docs = self._live(self._read("docs", DOCS).select("id", "segment", "ord", "terms"))
            self._lengths(docs).write.mode("overwrite").parquet(f"{self.path}/lengths-{self.version}")
        return self

    def _warm(self) -> bool:
        p, fs = _path(self.spark, f"{self.path}/lengths-{self.version}/_SUCCESS")
        return fs.exists(p)

    def _lengths(self, docs: DataFrame) -> DataFrame:
        """id, segment, ord, dn of docs (id, segment, ord, terms)."""
        weights = self.weights()
        frequent = F.broadcast(weights.orderBy("idf", "term").limit(FREQUENT))
        each = docs.select("id", "segment", "ord", F.explode("terms").alias("term"))
        squared = lambda rows: rows.select("id", "segment", "ord", (F.col("idf") * F.col("idf")).alias("square"))
        rare = each.join(frequent, "term", "left_anti").join(weights, "term")
        squares = squared(each.join(frequent, "term")).union(squared(rare)).union(docs.select("id", "segment", "ord", F.lit(0.0)))
        return squares.groupBy("id", "segment", "ord").agg(F.sqrt(F.sum("square")).alias("dn"))

    def _scored(self, x: DataFrame) -> DataFrame:
        """x with the cosine and the score; if the index is not warm, from the terms of its documents only."""
        if self._warm():
            length = self.spark.read.schema("id string, segment int, ord long, dn double").parquet(f"{self.path}/lengths-{self.version}")
        else:
            length = self._lengths(self._read("docs", DOCS).select("id", "segment", "ord", "terms").join(x.select("id", "segment").distinct(), ["id", "segment"], "left_semi"))
        y = x.join(length, ["id", "segment"])
        y = y.withColumn("cos", F.coalesce(F.try_divide(F.col("dot"), F.col("qn") * F.col("dn")), F.lit(0.0)))
        return y.withColumn("c", 0.6 * F.col("cos") + 0.4 * F.col("dice"))

    def semantic(self, queries: DataFrame, synonyms: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
        """As search.semantic over the documents put: qid, id, ord, score, level, cos, dice. queries: qid, nq, toks."""
        x = self._bounded(queries, synonyms)
        y = self._scored(x.filter(F.col("high") >= threshold - 1e-9)).filter(F.col("c") >= threshold)
        return y.select("qid", "id", "ord", round_to(F.col("c"), 2).alias("score"), F.lit("L3-semantic").alias("level"), "cos", "dice")

    def best(self, queries: DataFrame, k: int, synonyms: DataFrame | None = None) -> DataFrame:
        """qid, rank, id, c of the k best documents of each query by the unrounded score, ties by ord.

        Of each query the k-th largest lower bound rules out all documents whose upper bound is below it.
        """
        x = self._bounded(queries, synonyms)
        floor = Window.partitionBy("qid").orderBy(F.desc("low"))
        kth = x.withColumn("r", F.row_number().over(floor)).filter(F.col("r") <= k).groupBy("qid").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n"))
        near = x.join(kth, "qid").filter((F.col("n") < k) | (F.col("high") >= F.col("least") - 1e-9)).drop("least", "n")
        order = Window.partitionBy("qid").orderBy(F.desc("c"), "ord")
        return self._scored(near).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", "c")


def kept(path: str, docs: DataFrame) -> SearchIndex:
    """The index below path, warm; built from docs (id, ord, text) if there is none."""
    index = SearchIndex(docs.sparkSession, path)
    return (index if index.segments else index.put(docs)).warm()
