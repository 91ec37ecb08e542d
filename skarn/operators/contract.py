"""Metadata contract, validation rules, taxonomy balance, text guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Required fields, and the penalties of the contract's warnings.
REQUIRED = ["id", "name", "url", "description", "category", "language", "triggers", "status"]
ARRAYS = {"category", "triggers"}
PENALTIES = {"triggers": 15, "description": 15, "useCase": 20, "negativeConstraints": 20, "advantages": 15}
RESIDUAL = ["其他", "未分類", "Uncategorized", "Other"]
PLACEHOLDER = "待補充描述"
# Command prefixes that an installation may start with, and the shape of a repository URL.
PREFIXES = ["npm install", "npm i ", "npm ci", "npx ", "pip install", "pip3 install", "composer require", "composer install", "cargo install", "cargo build", "git clone", "go install", "go get"]
REPO_URL = r"^https://github\.com/[\w.-]+/[\w.-]+(?:\.git)?$"


def has_value(field: str) -> Column:
    c = F.col(field)
    return F.coalesce(F.size(c) > 0, F.lit(False)) if field in ARRAYS else F.coalesce(F.trim(c) != "", F.lit(False))


def warned(field: str) -> Column:
    """Whether the contract warns about a field."""
    if field == "description":
        return F.coalesce(F.length(F.trim("description")) < 15, F.lit(True))
    if field == "useCase":
        return F.coalesce(F.trim("useCase") == "", F.lit(True))
    return F.coalesce(F.size(field) < (2 if field == "triggers" else 1), F.lit(True))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def contract(tools: DataFrame) -> DataFrame:
    """id, quality_score, grade, errors and warnings (field names)."""
    some = lambda pairs: F.filter(F.array(*[F.when(c, n) for n, c in pairs]), lambda x: x.isNotNull())
    errors, warnings = some([(f, ~has_value(f)) for f in REQUIRED]), some([(f, warned(f)) for f in PENALTIES])
    lost = 25 * F.size(errors) + sum((F.when(warned(f), p).otherwise(0) for f, p in PENALTIES.items()), F.lit(0))
    score = F.greatest(F.lit(0), 100 - lost)
    return tools.select("id", score.alias("quality_score"), grade(score).alias("grade"), errors.alias("errors"), warnings.alias("warnings"))


def contract_summary(tools: DataFrame, low: int = 70) -> DataFrame:
    c = contract(tools)
    mean = F.coalesce(F.floor(F.avg("quality_score") * 10 + 0.5).cast("double") / 10, F.lit(0.0))
    return c.agg(F.count(F.lit(1)).alias("tools"), mean.alias("average"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"), F.count_if(F.col("quality_score") < low).alias("low"))


def low_quality(tools: DataFrame, low: int = 70) -> DataFrame:
    return contract(tools).filter(F.col("quality_score") < low).orderBy("quality_score", "id")


def validate(tools: DataFrame) -> DataFrame:
    """One row for each issue: id, severity, rule."""
    def rule(severity: str, name: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule")))

    w = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("ord")) > 1
    t = tools.withColumn("dup_id", w("id")).withColumn("dup_url", w("url"))
    none = lambda f: F.coalesce(F.size(f) == 0, F.lit(True))
    rules = [rule("error", f"missing:{f}", F.col(f).isNull() | ((F.col(f) == "") if f not in ARRAYS else F.lit(False))) for f in REQUIRED]
    rules += [
        rule("error", "duplicate_id", F.col("dup_id")), rule("warning", "duplicate_url", F.col("dup_url")), rule("warning", "few_triggers", F.size("triggers") < 2),
        rule("warning", "short_description", (F.length("description") > 0) & (F.length("description") < 15)), rule("error", "no_use_case", F.coalesce(F.col("useCase") == "", F.lit(True))),
        rule("error", "no_negatives", none("negativeConstraints")), rule("warning", "no_advantages", none("advantages")),
    ]
    return t.select("id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("i")).select("id", "i.severity", "i.rule")


def needs_enrichment(tools: DataFrame) -> DataFrame:
    none = lambda f, n: F.coalesce(F.size(f) < n, F.lit(True))
    empty = F.coalesce(F.col("useCase") == "", F.lit(True))
    return tools.filter((F.col("status") == "experimental") | empty | none("advantages", 1) | none("negativeConstraints", 1) | F.coalesce(F.contains("description", F.lit(PLACEHOLDER)), F.lit(False)) | none("triggers", 2))


def complete(tools: DataFrame) -> Column:
    """Whether a tool's metadata lets it become active."""
    full = lambda f, n: F.coalesce(F.size(f) >= n, F.lit(False))
    said = F.coalesce((F.col("description") != "") & ~F.contains("description", F.lit(PLACEHOLDER)), F.lit(False))
    return said & F.coalesce(F.col("useCase") != "", F.lit(False)) & full("advantages", 1) & full("negativeConstraints", 1) & full("triggers", 2)


def balance(categories: DataFrame) -> DataFrame:
    """category, n, bucket of rows (category), most frequent first; residual categories are failures."""
    n = categories.groupBy(F.coalesce(F.col("category"), F.lit("未分類")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("category").isin(*RESIDUAL), "residual").when(F.col("n") <= 2, "small").when(F.col("n") >= 50, "large").otherwise("ok")
    return n.withColumn("bucket", bucket).orderBy(F.desc("n"), "category")


def enriched(tools: DataFrame, answers: DataFrame) -> DataFrame:
    """tools with the fields of an enrichment answer (id and any of description, useCase, advantages, negativeConstraints, triggers).

    A text counts if it is not empty, a list if it has an item, triggers if there are two. What is complete then is active.
    """
    fits = {
        "description": lambda c: c != "", "useCase": lambda c: c != "", "advantages": lambda c: F.size(c) > 0, "negativeConstraints": lambda c: F.size(c) > 0, "triggers": lambda c: F.size(c) >= 2,
    }
    given = [c for c in fits if c in answers.columns]
    x = tools.join(answers.select("id", *[F.col(c).alias(f"new_{c}") for c in given], F.lit(True).alias("new_answer")), "id", "left")
    for c in given:
        new = F.col(f"new_{c}")
        x = x.withColumn(c, F.when(F.coalesce(fits[c](new), F.lit(False)), new).otherwise(F.col(c)))
    done = F.coalesce(F.col("new_answer"), F.lit(False)) & complete(x) & F.coalesce((F.col("description") != "") & ~F.contains("description", F.lit(PLACEHOLDER)), F.lit(False))
    return x.withColumn("status", F.when(done, "active").otherwise(F.col("status"))).select(*tools.columns)


def taxonomy_issues(tools: DataFrame) -> DataFrame:
    """id, severity, rule: a missing id, name, url or category is an error, missing triggers a warning."""
    none = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    rules = [("error", "no_id", none("id")), ("error", "no_name", none("name")), ("error", "no_url", none("url"))]
    rules += [("error", "no_category", F.coalesce(F.size(F.filter("category", lambda c: F.trim(c) != "")) == 0, F.lit(True))), ("warning", "no_triggers", F.coalesce(F.size("triggers") == 0, F.lit(True)))]
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, hit in rules]))
    return tools.select("id", F.explode(found).alias("x")).select("id", "x.severity", "x.rule")


def duplicate_attributes(pages: DataFrame, attribute: str = "id") -> DataFrame:
    """page_id, value, n of attribute values that occur more than once in a page's html."""
    found = F.regexp_extract_all("html", F.lit(f'{attribute}="([^"]+)"'), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("value")).groupBy("page_id", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def replacement_characters(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.coalesce(F.regexp_count("text", F.lit("�")), F.lit(0)).cast("long").alias("n"))


def missing_sections(content: Column, sections: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(s) for s in sections]), lambda s: ~F.contains(content, s))


def allowed_command(command: Column, prefixes: list[str] = PREFIXES) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.trim(F.coalesce(command, F.lit(""))), p))


def safe_ref(ref: Column) -> Column:
    return F.coalesce((ref != "") & ~F.startswith(ref, F.lit("-")) & ~F.array_contains(F.split(ref, "/"), ".."), F.lit(False))


def safe_repo_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(REPO_URL)), F.lit(False))
