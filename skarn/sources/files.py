"""Documents, logs and snapshots as files, read by Spark's own readers; missing files read as empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOOL = (
    "id string, name string, url string, description string, category string, language string, triggers array<string>, status string, capabilities array<string>, useCase string, "
    "advantages array<string>, negativeConstraints array<string>, stars bigint, forks bigint, addedAt timestamp, "
    "install struct<method:string,command:string,repoUrl:string,branch:string,subpath:string,requirements:array<string>>, sandbox struct<image:string,profile:string>, "
    "subTools array<struct<name:string,description:string,subpath:string>>"
)
TRACE = "timestamp timestamp, toolId string, args string, exitCode int, success boolean, duration bigint, error string"
SNAPSHOTS = "lastUpdated string, snapshots array<struct<week:string,dateRange:string,timestamp:string,repos:map<string,bigint>>>"
BEHAVIOUR = "timestamp bigint, type string, query string, toolId string, position int, resultCount int, topResultId string, duration bigint"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _read(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Tools of a registry document, with their place in it; a category may be a text or a list."""
    doc = _read(spark, path, f"version string, lastUpdated string, tools array<struct<{_struct()}>>", multiLine=True)
    t = doc.select(F.posexplode("tools").alias("ord", "t")).select("t.*", F.col("ord").cast("long").alias("ord"))
    listed = F.from_json("category", "array<string>")
    return t.withColumn("category", F.when(F.startswith(F.col("category"), F.lit("[")), listed).when(F.col("category").isNotNull(), F.array("category")).otherwise(F.array().cast("array<string>")))


def _struct() -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(TOOL))


def save_registry(tools: DataFrame, path: str, version: str = "1.0.0") -> None:
    """The document again; all tools meet in one row, as the format asks for."""
    row = F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in tools.columns if c != "ord"]).alias("t"))))
    tools.agg(F.lit(version).alias("version"), F.current_timestamp().cast("string").alias("lastUpdated"), row["t"].alias("tools")).write.mode("overwrite").json(path)


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines; blank and malformed ones are dropped."""
    return _read(spark, path, TRACE, mode="DROPMALFORMED").filter(F.col("toolId").isNotNull())


def append_traces(rows: DataFrame, path: str) -> None:
    """rows (toolId, args array, exitCode, duration, error) as lines; arguments are redacted."""
    rows.select(
        F.current_timestamp().alias("timestamp"), "toolId", F.when(F.size("args") > 0, "[REDACTED]").otherwise("").alias("args"), "exitCode", (F.col("exitCode") == 0).alias("success"), "duration", "error"
    ).write.mode("append").json(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """week, snap_idx, full_name, stars of a snapshot series; a flat map of counts reads as one week without a name."""
    series = _read(spark, path, SNAPSHOTS, multiLine=True).select(F.posexplode("snapshots").alias("snap_idx", "s"))
    return series.select(F.col("s.week").alias("week"), "snap_idx", F.explode("s.repos").alias("full_name", "stars"))


def flat_snapshot(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "full_name string, stars bigint")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("full_name", "stars"))


def save_flat_snapshot(repos: DataFrame, path: str) -> None:
    """full_name, stars as one flat map of counts, written anew; a snapshot is one document."""
    repos.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("full_name", "stars")))).alias("m")).select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def append_behaviour(rows: DataFrame, path: str) -> None:
    """Search, click and abandon events (columns of BEHAVIOUR, those given) as lines of a log."""
    known = [c.split()[0] for c in BEHAVIOUR.split(", ")]
    rows.select(*[c for c in known if c in rows.columns]).write.mode("append").json(path)


def save_synonyms(links: DataFrame, path: str) -> None:
    """term, synonym, pos as source text of a map, a line for each term in order."""
    line = F.concat(F.lit("  "), F.to_json(F.array("term")).substr(F.lit(2), F.length(F.to_json(F.array("term"))) - 2), F.lit(": "), F.to_json(F.array_sort(F.collect_list(F.struct("pos", "synonym")))["synonym"]), F.lit(","))
    links.groupBy("term").agg(line.alias("value")).orderBy("term").select("value").write.mode("overwrite").text(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as the one document that a page embeds: {"nodes": [...], "edges": [...]}."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    n.crossJoin(F.broadcast(e)).write.mode("overwrite").json(path)


def behaviour(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, BEHAVIOUR, mode="DROPMALFORMED")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, pos of a text file read whole, so that positions are those of the file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))


def skill_files(spark: SparkSession, path: str) -> DataFrame:
    """One document for each folder below path: SKILL.md before README.md."""
    from pyspark.sql import Window

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    f = f.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.decode("content", "UTF-8").alias("content"))
    f = f.filter(F.upper("file").isin("SKILL.MD", "README.MD"))
    w = Window.partitionBy("folder").orderBy(F.when(F.upper("file") == "SKILL.MD", 0).otherwise(1), "file")
    return f.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def fresh(spark: SparkSession, path: str, build, hours: float = 1.0) -> DataFrame:
    """A materialised table with generated_at, rebuilt where it is missing or too old."""
    if exists(spark, path):
        old = spark.read.parquet(path)
        if not old.filter(F.col("generated_at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(hours * 3600))).isEmpty():
            return old
    build().withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
