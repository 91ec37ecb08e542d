"""Remote sources as tables: live repositories, and what connectors make of listings.

No network is used here. The reader takes saved result files, one for each query; a connector that calls a service would
produce the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions.text import slug
from skarn.sources.files import exists

LIVE = "full_name string, name string, owner string, stars bigint, fork boolean, created_at string, pushed_at string, topics array<string>, language string, description string, html_url string, query_idx int, item_idx int"
# Signs of a folder that holds tools, repositories never split, branches in order of trial.
FOLDER_SIGNS = ["skills", "agents", "tools", "providers", "extensions", "plugins", "modules", "components"]
NEVER_SPLIT = ["gemini-cli", "claude-code", "cursor", "copilot", "continue"]
BRANCHES = ["main", "master", "dev"]
MOST_FOLDERS = 10


ITEM = "full_name string, name string, owner struct<login:string>, stargazers_count bigint, fork boolean, created_at string, pushed_at string, topics array<string>, language string, description string, html_url string"


def live_repositories(spark: SparkSession, paths: list[str]) -> DataFrame:
    """LIVE rows of saved result files, one for each query, in the order of paths; any file system that Spark reads.

    A file that is missing or no document is a query that failed: it found nothing.
    """
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], LIVE)
    fields = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(ITEM))
    docs = spark.read.schema(f"items array<struct<{fields}>>").option("multiLine", True).json(there).select(F.posexplode("items").alias("item_idx", "x"), F.col("_metadata.file_path").alias("file"))
    order = spark.createDataFrame([(i, p.rsplit("/", 1)[-1], p) for i, p in enumerate(paths)], "query_idx int, file_name string, path string")
    rows = docs.join(F.broadcast(order), F.endswith("file", F.concat(F.lit("/"), "file_name")) & F.endswith(F.url_decode("file"), "path"))
    return rows.select(
        "x.full_name", "x.name", F.col("x.owner.login").alias("owner"), F.col("x.stargazers_count").alias("stars"), F.coalesce("x.fork", F.lit(False)).alias("fork"), "x.created_at", "x.pushed_at",
        F.coalesce("x.topics", F.array().cast("array<string>")).alias("topics"), "x.language", "x.description", "x.html_url", "query_idx", "item_idx",
    )


def skills_from_code_search(found: DataFrame) -> DataFrame:
    """Skill rows (id owner/repo@name, name, source, installs 0) from code-search items (full_name, path): the folder names the skill; each once."""
    folder = F.element_at(F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/"), -1)
    name = F.coalesce(F.nullif(folder, F.lit("")), F.element_at(F.split("full_name", "/"), -1))
    x = found.select(F.concat("full_name", F.lit("@"), name).alias("id"), name.alias("name"), F.col("full_name").alias("source"), F.lit(0).cast("long").alias("installs"))
    return x.dropDuplicates(["id"])


def health(answers: DataFrame) -> DataFrame:
    """One row: healthy, failed; answers (url, status): a status from 200 to 399 is healthy, none is a failure."""
    ok = F.coalesce(F.col("status").between(200, 399), F.lit(False))
    return answers.agg(F.count_if(ok).alias("healthy"), F.count_if(~ok).alias("failed"))


def synced_stars(tools: DataFrame, polled: DataFrame) -> DataFrame:
    """tools with the polled stars (url, stars) where there are any; the others keep theirs."""
    p = polled.groupBy(F.lower("url").alias("polled_url")).agg(F.max("stars").alias("polled_stars"))
    return tools.join(p, F.lower("url") == F.col("polled_url"), "left").withColumn("stars", F.coalesce("polled_stars", "stars")).drop("polled_url", "polled_stars")


def monorepo_parts(listing: DataFrame) -> DataFrame:
    """Sub-tools of repositories whose listing (repo, path, ord, has_skill, has_readme) has at least two.

    Of the folders that look like tools the first ten count, if there are two of them; each needs a document.
    """
    sign = F.exists(F.array(*[F.lit(s) for s in FOLDER_SIGNS]), lambda s: F.contains(F.lower("path"), s))
    w = Window.partitionBy("repo")
    x = listing.filter(sign & ~F.lower("repo").isin(*NEVER_SPLIT)).withColumn("r", F.row_number().over(w.orderBy("ord"))).withColumn("n", F.count(F.lit(1)).over(w))
    x = x.filter((F.col("n") >= 2) & (F.col("r") <= MOST_FOLDERS)).withColumn("kind", F.when(F.col("has_skill"), "skill").when(F.col("has_readme"), "readme")).filter("kind is not null")
    return x.withColumn("m", F.count(F.lit(1)).over(w)).filter("m >= 2").select("repo", "path", "kind", F.regexp_replace(F.lower("path"), "[^a-z0-9]+", "-").alias("id"))


def first_branch(answers: DataFrame) -> DataFrame:
    """repo, branch, content of the first branch, in order of trial, that answered; answers: repo, branch, content (null: none)."""
    order = F.array_position(F.array(*[F.lit(b) for b in BRANCHES]), F.col("branch"))
    x = answers.filter(F.col("content").isNotNull() & (order > 0))
    return x.groupBy("repo").agg(F.min_by(F.struct("branch", "content"), order).alias("b")).select("repo", "b.branch", "b.content")


def scanned_tool(meta: DataFrame) -> DataFrame:
    """Catalog rows from repository metadata (url, owner, repo, subpath, description, language, topics)."""
    from skarn.functions.text import strip_boilerplate, title_case, trigger_list
    from skarn.operators.classify import guessed_category, install_method
    from skarn.operators.contract import PLACEHOLDER

    base = F.coalesce(F.element_at(F.split(F.nullif("subpath", F.lit("")), "/"), -1), F.col("repo"))
    said = strip_boilerplate(F.coalesce("description", F.lit("")), F.col("owner"), F.col("repo"))
    where = F.concat_ws("/", "owner", "repo", F.nullif("subpath", F.lit("")))
    said = F.when(said == "", F.concat(where, F.lit(" - " + PLACEHOLDER))).otherwise(said)
    about = F.concat(said, F.lit(" "), F.concat_ws(" ", "topics"))
    method = F.when(F.coalesce(F.col("subpath") != "", F.lit(False)), "git-clone-sparse").otherwise(install_method(F.col("language"), about, F.col("topics")))
    return meta.select(
        slug(base).alias("id"), title_case(base).alias("name"), F.regexp_replace("url", "/$", "").alias("url"), said.alias("description"), guessed_category(about).alias("category"),
        F.coalesce("language", F.lit("other")).alias("language"), trigger_list(base, F.col("topics")).alias("triggers"), method.alias("method"), F.slice("topics", 1, 5).alias("capabilities"), F.lit("experimental").alias("status"),
    )


def leaderboard_fields(doc: Column) -> Column:
    """The newer field names of a saved leaderboard, else the older ones at its top level; `ok` is false for a text that is no JSON.

    Documents changed their shape over time, so they are read as variants: no schema fixes which fields there are.
    """
    v = F.try_parse_json(doc)
    items = "array<struct<rank:int,fullName:string,delta:bigint>>"
    either = lambda path, kind: F.coalesce(F.try_variant_get(v, f"$.lastWeek.{path}", kind), F.try_variant_get(v, f"$.{path}", kind))
    return F.struct(v.isNotNull().alias("ok"), either("week", "string").alias("week"), either("items", items).alias("items"))
