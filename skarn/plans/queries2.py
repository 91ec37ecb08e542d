"""Queries over quality, classification, graph, jobs and catalog changes. Registered with those of queries.py."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.functions import calendar
from skarn.operators import catalog, classify, contract, graph, jobs, reports, synonyms, telemetry, trending
from skarn.plans import sql as Q
from skarn.plans.queries import ORACLE_SQL, query, scratch, week_to_date
from skarn.sources import adapters as A
from skarn.sources import connectors

_PEN = "(CASE WHEN len(triggers) < 2 THEN 15 ELSE 0 END + CASE WHEN length(trim(description)) < 15 THEN 15 ELSE 0 END + CASE WHEN use_case IS NULL THEN 20 ELSE 0 END + CASE WHEN len(negs) = 0 THEN 20 ELSE 0 END + CASE WHEN len(advantages) = 0 THEN 15 ELSE 0 END)"
_NW = "(CASE WHEN len(triggers) < 2 THEN 1 ELSE 0 END + CASE WHEN length(trim(description)) < 15 THEN 1 ELSE 0 END + CASE WHEN use_case IS NULL THEN 1 ELSE 0 END + CASE WHEN len(negs) = 0 THEN 1 ELSE 0 END + CASE WHEN len(advantages) = 0 THEN 1 ELSE 0 END)"
_SCORE = f"sc AS (SELECT id, CAST(100 - {_PEN} AS INTEGER) AS quality_score, CAST({_NW} AS INTEGER) AS n_warnings FROM tools)"
_GRADE = "CASE WHEN quality_score >= 90 THEN 'A' WHEN quality_score >= 80 THEN 'B' WHEN quality_score >= 70 THEN 'C' WHEN quality_score >= 60 THEN 'D' ELSE 'F' END"


@query(f"WITH {Q.TOOLS}, {_SCORE} SELECT id, quality_score, {_GRADE} AS grade, n_warnings FROM sc")
def contract_scores(spark, d):
    return contract.contract(A.catalog(spark, d)).select("id", "quality_score", "grade", F.size("warnings").alias("n_warnings"))


@query(f"WITH {Q.TOOLS}, {_SCORE} SELECT count(*) AS tools, floor(avg(quality_score) * 10 + 0.5) / 10 AS average, CAST(0 AS BIGINT) AS errors, CAST(sum(n_warnings) AS BIGINT) AS warnings, count(*) FILTER (quality_score < 70) AS low FROM sc")
def contract_summary(spark, d):
    return contract.contract_summary(A.catalog(spark, d))


@query(f"WITH {Q.TOOLS}, {_SCORE} SELECT id, quality_score, {_GRADE} AS grade FROM sc WHERE quality_score < 70")
def low_quality(spark, d):
    return contract.low_quality(A.catalog(spark, d)).select("id", "quality_score", "grade")


@query(f"""WITH {Q.TOOLS}, u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS r FROM tools),
    i AS (SELECT 'warning' AS severity, 'duplicate_url' AS rule FROM u WHERE r > 1 UNION ALL SELECT 'warning', 'few_triggers' FROM tools WHERE len(triggers) < 2 UNION ALL
          SELECT 'warning', 'short_description' FROM tools WHERE length(description) BETWEEN 1 AND 14 UNION ALL SELECT 'error', 'no_use_case' FROM tools WHERE use_case IS NULL UNION ALL
          SELECT 'error', 'no_negatives' FROM tools WHERE len(negs) = 0 UNION ALL SELECT 'warning', 'no_advantages' FROM tools WHERE len(advantages) = 0)
    SELECT severity, rule, count(*) AS n FROM i GROUP BY ALL""")
def validate_rules(spark, d):
    return contract.validate(A.catalog(spark, d)).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {Q.TOOLS} SELECT id FROM tools WHERE status = 'experimental' OR use_case IS NULL OR len(advantages) = 0 OR len(negs) = 0 OR len(triggers) < 2")
def needs_enrichment(spark, d):
    return contract.needs_enrichment(A.catalog(spark, d)).select("id")


@query(f"WITH {Q.TOOLS} SELECT id, use_case IS NOT NULL AND len(advantages) > 0 AND len(negs) > 0 AND len(triggers) >= 2 AS complete FROM tools")
def promote_complete(spark, d):
    t = A.catalog(spark, d)
    return t.select("id", contract.complete(t).alias("complete"))


@query("SELECT source AS category, count(*) AS n, CASE WHEN source IN ('其他', '未分類', 'Uncategorized', 'Other') THEN 'residual' WHEN count(*) <= 2 THEN 'small' WHEN count(*) >= 50 THEN 'large' ELSE 'ok' END AS bucket FROM documents GROUP BY source")
def taxonomy_balance(spark, d):
    return contract.balance(A.table(spark, d, "documents").select(F.col("source").alias("category")))


@query("WITH v AS (SELECT page_id, unnest(regexp_extract_all(replace(html, 'href=', 'id='), 'id=\"([^\"]+)\"', 1)) AS value FROM pages) SELECT page_id, value, count(*) AS n FROM v GROUP BY ALL HAVING count(*) > 1")
def dup_html_ids(spark, d):
    p = A.table(spark, d, "pages")  # the pages have links and few ids, so links stand for ids
    return contract.duplicate_attributes(p.withColumn("html", F.replace("html", F.lit("href="), F.lit("id="))))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, '�', '')) AS BIGINT) AS n FROM documents")
def utf8_guard(spark, d):
    return contract.replacement_characters(A.table(spark, d, "documents"), "doc_id")


@query("SELECT doc_id, CAST(2 - CAST(contains(text, 'License') AS INTEGER) - CAST(contains(text, '.') AS INTEGER) AS INTEGER) AS missing FROM documents")
def doc_sections(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.size(contract.missing_sections(F.col("text"), ["License", "."])).alias("missing"))


@query("SELECT p_partkey AS id, p_partkey % 3 <> 2 AS allowed FROM part")
def command_allowlist(spark, d):
    p = A.table(spark, d, "part")
    k = F.col("p_partkey") % 3
    command = F.when(k == 0, F.concat(F.lit(" pip install "), "p_name")).when(k == 1, "npx x").otherwise("rm -rf /")
    return p.select(F.col("p_partkey").alias("id"), contract.allowed_command(command).alias("allowed"))


_REFS = "[p, '-' || p, p || '/../x', 'v/' || p, '']"
_URLS = "[url, replace(url, 'http://', 'https://'), 'https://github.com/' || p, 'https://github.com/o/r' || page_id, 'https://github.com/o/r' || page_id || '.git', 'https://github.com/o/r' || page_id || '/tree/x']"


@query(f"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS p FROM pages), r AS (SELECT page_id, unnest({_REFS}) AS v FROM u), l AS (SELECT page_id, unnest({_URLS}) AS v FROM u)
    SELECT page_id, 'ref' AS kind, v, v <> '' AND v NOT LIKE '-%' AND NOT list_contains(string_split(v, '/'), '..') AS safe FROM r UNION ALL SELECT page_id, 'repository', v, regexp_matches(v, '{contract.REPO_URL}') FROM l""")
def safe_references(spark, d):
    """Paths of pages as references and their addresses as repositories: which of them a command may be given."""
    p = A.table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("p"))
    say = lambda *parts: F.concat(*[F.lit(x) if x.startswith(("-", "/", "v/", "https", ".git")) else F.col(x).cast("string") for x in parts])
    refs = F.array(F.col("p"), say("-", "p"), say("p", "/../x"), say("v/", "p"), F.lit(""))
    base = ("https://github.com/o/r", "page_id")
    urls = F.array(F.col("url"), F.replace("url", F.lit("http://"), F.lit("https://")), say("https://github.com/", "p"), say(*base), say(*base, ".git"), say(*base, "/tree/x"))
    r = p.select("page_id", F.lit("ref").alias("kind"), F.explode(refs).alias("v")).withColumn("safe", contract.safe_ref(F.col("v")))
    return r.union(p.select("page_id", F.lit("repository").alias("kind"), F.explode(urls).alias("v")).withColumn("safe", contract.safe_repo_url(F.col("v"))))


# ---- classification

def _case(rules, default):
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + f" ELSE '{default}' END"


@query(f"SELECT doc_id, {_case([(f'''regexp_matches(lower(text || ' ' || source), '\\b({w})\\b')''', c) for w, c in classify.REPOSITORY_RULES], classify.DEFAULT)} AS category FROM documents")
def infer_category(spark, d):
    return A.table(spark, d, "documents").select("doc_id", classify.repository_category(F.concat_ws(" ", "text", "source")).alias("category"))


_KW = ["playwright tests", "an audio book", "postgres-db", "maintain it", "deploy_now", "nothing here", "a catalogue", "the quality gate", "aws lambda", "voice-over", "microsoft word"]


def _edge(words):
    hit = "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: instr(t, w) > 0 AND (instr(t, w) = 1 OR substr(t, instr(t, w) - 1, 1) IN (' ', '-', '_')) AND substr(t, instr(t, w) + length(w), 1) IN ('', ' ', '-', '_'))"
    return f"len({hit}) > 0"


_GUESS = _case([(_edge(ws), c) for c, ws in classify.PRECISE + classify.GENERAL] + [(" OR ".join(f"contains(t, '{w}')" for w in ws), c) for c, ws in classify.ANYWHERE], classify.DEFAULT)
_TEXTS = "x AS (SELECT 'p' || p_partkey AS id, lower(p_name || ' ' || p_type) AS t FROM part UNION ALL SELECT 'k' || i, lower(s) FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in _KW) + "]) AS s, unnest(range(" + str(len(_KW)) + ")) AS i))"


def _texts(spark, d):
    p = A.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return p.unionByName(spark.createDataFrame([(f"k{i}", k) for i, k in enumerate(_KW)], "id string, t string"))


@query(f"WITH {_TEXTS} SELECT id, {_GUESS} AS category FROM x")
def guess_category(spark, d):
    return _texts(spark, d).select("id", classify.guessed_category(F.col("t")).alias("category"))


@query(f"WITH {_TEXTS} SELECT id, {_edge(['quality', 'audio', 'deploy'])} AS hit FROM x")
def keyword_boundary(spark, d):
    words = F.array(*[F.lit(w) for w in ("quality", "audio", "deploy")])
    return _texts(spark, d).select("id", F.exists(words, lambda w: X.word_at_first(F.lower("t"), w)).alias("hit"))


@query(f"WITH {_TEXTS} SELECT old, new, count(*) AS n FROM (SELECT t AS old, {_GUESS} AS new FROM x) WHERE old IS DISTINCT FROM new GROUP BY ALL")
def category_diff(spark, d):
    x = _texts(spark, d)
    return catalog.category_changes(x.select(F.lower("t").alias("old"), classify.guessed_category(F.col("t")).alias("new")))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'pip' WHEN 1 THEN 'npm' WHEN 2 THEN 'composer' WHEN 3 THEN 'cargo' WHEN 4 THEN 'git-clone' ELSE 'none' END AS method,
    CASE p_partkey % 6 WHEN 0 THEN 'pip install git+https://h/o/r.git' WHEN 1 THEN 'npx r' WHEN 2 THEN 'composer require o/r' WHEN 3 THEN 'cargo install --git https://h/o/r' WHEN 4 THEN 'git clone https://h/o/r.git' ELSE 'https://h/o/r' END AS command FROM part""")
def install_method(spark, d):
    p, k = A.table(spark, d, "part"), F.col("p_partkey") % 6
    lang = F.when(k == 0, "python").when(k == 1, "typescript").when(k == 2, "php").when(k == 3, "rust").when(k == 4, "java").otherwise("python")
    text = F.when(k == 5, "A curated LIST").otherwise(F.col("p_name"))
    x = p.select(F.col("p_partkey").alias("id"), classify.install_method(lang, text).alias("method"))
    return x.select("id", "method", classify.install_command(F.col("method"), F.lit("https://h/o/r")).alias("command"))


_SIGNS = ", ".join(f"'{s}'" for s in classify.URL_SIGNS)


@query(f"SELECT page_id, CASE WHEN len(list_filter([{_SIGNS}], lambda s: contains(lower(url || ' ' || html), s))) > 0 THEN 'resource' WHEN page_id % 4 >= 2 THEN 'monorepo' ELSE 'tool' END AS kind FROM pages")
def resource_url(spark, d):
    return A.table(spark, d, "pages").select("page_id", classify.resource_kind(F.concat_ws(" ", "url", "html"), F.col("page_id") % 4).alias("kind"))


_FORMAT = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(lower(category), '{r[0]}') THEN '{r[i]}'" for r in classify.FORMATS) + f" ELSE '{classify.DEFAULT_FORMAT[i - 1]}' END"


@query(f"WITH c AS (SELECT DISTINCT [{', '.join(repr(w) for w in X.SUB_KEYWORDS)}][c_nationkey % {len(X.SUB_KEYWORDS)} + 1] || ' ' || c_mktsegment AS category FROM customer) SELECT category, {_FORMAT(1)} AS input_format, {_FORMAT(2)} AS output_format FROM c")
def io_format(spark, d):
    word = F.get(F.array(*[F.lit(w) for w in X.SUB_KEYWORDS]), F.col("c_nationkey") % len(X.SUB_KEYWORDS))
    c = A.table(spark, d, "customer").select(F.concat_ws(" ", word, "c_mktsegment").alias("category")).distinct()
    return c.select("category", classify.formats(F.col("category")).alias("f")).select("category", "f.input_format", "f.output_format")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'python:3.10-slim' WHEN 1 THEN 'node:18-alpine' ELSE 'ubuntu:22.04' END AS image, CASE p_partkey % 3 WHEN 1 THEN 'bridge' ELSE 'none' END AS network FROM part")
def runtime_profile(spark, d):
    k = F.col("p_partkey") % 3
    lang, profile = F.when(k == 0, "Python").when(k == 1, "JavaScript").otherwise("cobol"), F.when(k == 1, "networked-runtime").when(k == 2, "unknown")
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.image(lang).alias("image"), classify.network(profile).alias("network"))


# ---- scalar functions

_GH = "https://github.com/' || replace(lower(p_brand), '#', '-') || '/' || replace(p_name, ' ', '-')"


@query(f"SELECT p_partkey AS id, regexp_extract('{_GH}, 'github\\.com/([^/]+)/', 1) AS owner, regexp_extract('{_GH}, '/([^/]+)$', 1) AS repo FROM part")
def url_owner_repo(spark, d):
    owner, repo = X.owner_repo(F.concat("url", F.lit(".git")))
    return A.catalog(spark, d).select(F.col("ord").alias("id"), owner.alias("owner"), repo.alias("repo"))


@query("""SELECT p_partkey AS id, replace(lower(p_name), ' ', '-') || '-' || replace(lower(p_brand), '#', '') AS slug,
    list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title FROM part""")
def slug(spark, d):
    p = A.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), X.slug(F.concat_ws("  ", F.lit("-"), "p_name", "p_brand", F.lit("-"))).alias("slug"), X.title_case(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("title"))


@query("""SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS chars, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^\\s/]') THEN trim(url) ELSE '#' END AS url FROM pages""")
def html_escape(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.length(X.escape_html(F.col("html"))).cast("long").alias("chars"), X.safe_url(F.col("url")).alias("url"))


@query("SELECT p_partkey AS id, CASE WHEN s >= 1000 THEN printf('%.1fk', floor(s / 100.0 + 0.5) / 10.0) ELSE CAST(s AS VARCHAR) END AS stars FROM (SELECT p_partkey, p_partkey * 7 AS s FROM part)")
def star_format(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.star_count(F.col("p_partkey") * 7).alias("stars"))


@query("""WITH c AS (SELECT p_partkey, CAST(p_partkey * 7919 % 16777216 AS BIGINT) AS x, p_size FROM part)
    SELECT p_partkey, CASE WHEN p_size = 1 THEN '#fff' ELSE '#' || printf('%06x', x) END AS color,
        CASE WHEN p_size <> 1 AND (0.299 * (x // 65536) + 0.587 * (x // 256 % 256) + 0.114 * (x % 256)) / 255 > 0.6 THEN '#000000' ELSE '#ffffff' END AS text FROM c""")
def color_contrast(spark, d):
    c = A.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") == 1, "#fff").otherwise(F.format_string("#%06x", (F.col("p_partkey") * 7919 % 16777216).cast("long"))).alias("color"))
    return c.withColumn("text", X.contrast(F.col("color")))


@query("SELECT n_name AS category, 'hsl(' || CAST(floor((n_nationkey * 137.5 + 200) % 360) AS BIGINT) || ', 65%, 48%)' AS color FROM nation")
def category_color(spark, d):
    return A.table(spark, d, "nation").select(F.col("n_name").alias("category"), X.category_color({}, F.col("n_name"), F.col("n_nationkey")).alias("color"))


@query("SELECT p_partkey AS id, '''' || replace(p_name || CASE WHEN p_partkey % 2 = 0 THEN '''s' ELSE '' END, '''', '''\\''''') || '''' AS quoted FROM part")
def shell_quote(spark, d):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "'s").otherwise(""))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.shell_quote(name).alias("quoted"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a ' || source || ' tool' WHEN 1 THEN 'First plain ' || lang WHEN 2 THEN '' ELSE 'after ' || source END AS description FROM documents""")
def markdown_description(spark, d):
    k, t = F.col("doc_id") % 4, A.table(spark, d, "documents")
    front = F.concat(F.lit("---\nname: x\ndescription: 'a "), "source", F.lit(" tool'\n---\n# T\n\n"), "text")
    plain = F.concat(F.lit("# Title\n\n![img](x)\n\nFirst plain\n"), "lang", F.lit("\n\n"), "text")
    c = F.when(k == 0, front).when(k == 1, plain).when(k == 2, F.lit("# only")).otherwise(F.concat(F.lit("---\nname: x\n---\nafter "), "source", F.lit("\n\n"), "text"))
    return t.select("doc_id", X.markdown_description(c).alias("description"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Fast ' || source || '. More' WHEN 1 THEN 'plain ' || source ELSE 'Contribute to a/b ' || source END AS description FROM documents""")
def boilerplate_strip(spark, d):
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.concat(F.lit("Fast "), "source", F.lit(".Contribute to A/B development by creating an account on GitHub. More")))
    said = said.when(k == 1, F.concat(F.lit("plain "), "source")).otherwise(F.concat(F.lit("Contribute to a/b "), "source"))
    return A.table(spark, d, "documents").select("doc_id", X.strip_boilerplate(said, F.lit("a"), F.lit("b")).alias("description"))


@query("SELECT p_partkey AS id, array_to_string(list_distinct(list_concat([replace(p_name, ' ', '-')], list_filter(string_split(p_name, ' '), lambda w: length(w) > 2), [lower(p_type)])), ',') IS NOT NULL AS ok, CAST(len(list_distinct(list_concat([replace(p_name, ' ', '-')], list_filter(string_split(p_name, ' '), lambda w: length(w) > 2), [lower(p_type)]))) AS INTEGER) AS n FROM part")
def trigger_list(spark, d):
    p = A.table(spark, d, "part")
    t = X.trigger_list(F.replace("p_name", F.lit(" "), F.lit("-")), F.array(F.lower("p_type")))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(t, ",").isNotNull().alias("ok"), F.size(t).alias("n"))


# ---- catalog

@query(f"WITH {Q.TOOLS} SELECT count(*) AS tools, count(DISTINCT cat) AS categories, count(DISTINCT language) AS languages, count(*) FILTER (has_sub) AS sub_tools, CAST(sum(stars) AS BIGINT) AS stars, CAST(floor(avg(stars) + 0.5) AS BIGINT) AS mean_stars FROM tools")
def catalog_kpis(spark, d):
    return catalog.kpis(A.catalog(spark, d))


@query(f"WITH {Q.TOOLS} SELECT cat AS category, count(*) AS n, CAST(sum(stars) AS BIGINT) AS stars, min(ord) AS first_ord FROM tools GROUP BY cat")
def category_stars(spark, d):
    return catalog.by_category(A.catalog(spark, d))


@query(f"WITH {Q.TOOLS}, r AS (SELECT cat AS category, CAST(row_number() OVER (PARTITION BY cat ORDER BY stars DESC, ord) AS INTEGER) AS r, id, stars FROM tools) SELECT * FROM r WHERE r <= 3")
def category_top(spark, d):
    return catalog.top_in_category(A.catalog(spark, d))


@query(f"WITH {Q.TOOLS} SELECT language, count(*) AS n FROM tools GROUP BY language ORDER BY n DESC, language LIMIT 5")
def top_languages(spark, d):
    return catalog.languages(A.catalog(spark, d))


@query(f"WITH {Q.TOOLS} SELECT id FROM tools WHERE cat = 'PROMO' OR id = 'part-3'")
def category_membership(spark, d):
    t = A.catalog(spark, d)
    return t.filter(catalog.belongs("PROMO")).select("id").union(catalog.by_id(t, "part-3").select("id")).distinct()


@query(f"""WITH {Q.TOOLS}, n AS (SELECT 'part-1' AS id, 'https://github.com/new/one' AS url UNION ALL SELECT 'fresh', 'https://github.com/new/two' UNION ALL SELECT 'old', (SELECT url FROM tools WHERE id = 'part-5')),
    a AS (SELECT id, url, ord FROM tools UNION ALL SELECT CASE WHEN id IN (SELECT id FROM tools) THEN 'new-' || id ELSE id END, url, 1000000 FROM n WHERE url NOT IN (SELECT url FROM tools))
    SELECT id, url FROM a WHERE id <> 'part-7'""")
def catalog_dml(spark, d):
    t = A.catalog(spark, d).select("id", "url", "ord")
    old = t.filter("id = 'part-5'").select(F.lit("old").alias("id"), "url", F.lit(1000000).cast("long").alias("ord"))
    new = spark.createDataFrame([("part-1", "https://github.com/new/one", 1000000), ("fresh", "https://github.com/new/two", 1000000)], "id string, url string, ord long").union(old)
    return catalog.remove(catalog.add(t, new), "part-7").select("id", "url")


@query("SELECT c_custkey AS full_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'new' END, c_mktsegment) END AS category, 'kept' AS note FROM customer")
def pool_merge(spark, d):
    c = A.table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("full_name"), F.col("c_mktsegment").alias("category"), F.lit("kept").alias("note"))
    new = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("full_name"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("category"), F.lit("other").alias("note"))
    return catalog.merge_pool(old, new)


@query("""WITH a AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), b AS (SELECT c_custkey AS id, c_name AS name FROM customer)
    SELECT CAST(id AS VARCHAR) AS id, coalesce(CASE WHEN (SELECT count(*) FROM a) < 10 THEN b.name END, a.name) AS name FROM a FULL JOIN b USING (id) WHERE a.name IS NOT NULL OR (SELECT count(*) FROM a) < 10 ORDER BY CAST(id AS VARCHAR) LIMIT 20""")
def skill_union(spark, d):
    a = A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    b = A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return catalog.union_skills(a, b, 20)


_SKILLS = r"""t AS (SELECT c_custkey, 'found:' || chr(10) || ' ' || lower(c_mktsegment) || '/kit' || c_nationkey || '@tool-' || c_custkey || '  ' || floor(abs(c_acctbal)) :: BIGINT || ' installs' || chr(10) || 'noise@' || c_name || ' 3 installs' || chr(10) || 'o/r@' || c_name || '   1 install' AS text FROM customer)"""


@query("WITH " + _SKILLS + r""", m AS (SELECT c_custkey, unnest(regexp_extract_all(text, '(\w+/\w+)@([\w-]+)[ \t]+(\d+)[ \t]+installs?')) AS l FROM t)
    SELECT c_custkey, regexp_extract(l, '^([^ ]+)', 1) AS id, regexp_extract(l, '@([\w-]+)', 1) AS name, regexp_extract(l, '^([^@]+)@', 1) AS source, CAST(regexp_extract(l, '(\d+)\s+installs?$', 1) AS BIGINT) AS installs FROM m""")
def skill_parse(spark, d):
    """What a command-line search prints for each customer, as rows: lines of another form are noise."""
    lines = F.concat(
        F.lit("found:\n "), F.lower("c_mktsegment"), F.lit("/kit"), F.col("c_nationkey").cast("string"), F.lit("@tool-"), F.col("c_custkey").cast("string"), F.lit("  "), F.floor(F.abs("c_acctbal")).cast("string"),
        F.lit(" installs\nnoise@"), "c_name", F.lit(" 3 installs\no/r@"), "c_name", F.lit("   1 install"),
    )
    return catalog.parse_skills(A.table(spark, d, "customer").select("c_custkey", lines.alias("text")))


@query("""WITH l AS (SELECT trim(CASE WHEN page_id % 5 = 0 THEN '# ' || url WHEN page_id % 7 = 0 THEN '' ELSE url END) AS url, page_id AS pos FROM pages UNION ALL SELECT url, page_id + 100000 FROM pages)
    SELECT url, min(pos) AS pos FROM l WHERE url <> '' AND url NOT LIKE '#%' GROUP BY url""")
def url_list_dedupe(spark, d):
    p = A.table(spark, d, "pages")
    k = F.col("page_id")
    rows = p.select(F.when(k % 5 == 0, F.concat(F.lit("# "), "url")).when(k % 7 == 0, "").otherwise(F.col("url")).alias("value"), k.alias("pos")).union(p.select("url", k + 100000))
    return catalog.url_lines(rows)


@query("SELECT CASE WHEN page_id % 5 = 0 THEN 'failed' WHEN page_id % 3 = 0 THEN 'skipped' ELSE 'added' END AS status, count(*) AS n FROM pages GROUP BY 1")
def batch_counts(spark, d):
    k = F.col("page_id")
    return A.table(spark, d, "pages").groupBy(F.when(k % 5 == 0, "failed").when(k % 3 == 0, "skipped").otherwise("added").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {Q.TOOLS}, h AS (SELECT 'part-' || i AS id FROM range(1990, 2005) r(i)) SELECT h.id, coalesce(name, '?') AS name FROM h LEFT JOIN tools USING (id)")
def result_backjoin(spark, d):
    h = spark.range(1990, 2005).select(F.concat(F.lit("part-"), F.col("id").cast("string")).alias("id"))
    return h.join(A.catalog(spark, d).select("id", "name"), "id", "left").select("id", F.coalesce("name", F.lit("?")).alias("name"))


# ---- graph

_G = """t AS (SELECT c_custkey AS id, c_name AS name, n_name AS category, c_custkey AS ord, list_transform(range(0, c_custkey % 5), lambda i: c_name || '/' || i) AS subs FROM customer JOIN nation ON c_nationkey = n_nationkey),
    c AS (SELECT category, 'cat_' || (row_number() OVER (ORDER BY min(ord), category) - 1) AS cat_id FROM t GROUP BY category),
    n AS (SELECT 'root' AS id, 'catalog (' || (SELECT count(*) FROM t) || ')' AS label, 'root' AS kind, NULL AS category UNION ALL SELECT cat_id, category, 'category', category FROM c UNION ALL
          SELECT 'tool_' || id, name, 'tool', category FROM t UNION ALL SELECT 'sub_' || id || '_' || i, subs[i + 1], 'subtool', category FROM (SELECT *, unnest(range(0, least(len(subs), 3))) AS i FROM t)),
    e AS (SELECT 'root' AS source, cat_id AS target FROM c UNION ALL SELECT cat_id, 'tool_' || id FROM t JOIN c USING (category) UNION ALL
          SELECT 'tool_' || id, 'sub_' || id || '_' || i FROM (SELECT *, unnest(range(0, least(len(subs), 3))) AS i FROM t))"""


def _graph_tools(spark, d):
    c = A.table(spark, d, "customer").join(F.broadcast(A.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    subs = F.when(k % 5 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k % 5 - 1, F.lit(0))), lambda i: F.concat_ws("/", "c_name", i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return c.select(k.cast("string").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("category"), k.alias("ord"), subs.alias("subs"), F.col("c_mktsegment").alias("language"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("use_case"))


@query(f"WITH {_G} SELECT * FROM n")
def graph_nodes(spark, d):
    return graph.nodes_and_edges(_graph_tools(spark, d))[0]


@query(f"WITH {_G} SELECT * FROM e")
def graph_edges(spark, d):
    return graph.nodes_and_edges(_graph_tools(spark, d))[1]


@query(f"WITH {_G} SELECT source, target FROM e WHERE target IN (SELECT id FROM n WHERE category = 'NATION_3')")
def graph_subtree(spark, d):
    return graph.subgraph(*graph.nodes_and_edges(_graph_tools(spark, d)), "NATION_3")[1]


@query(f"WITH {_G} SELECT * FROM n WHERE contains(lower(label), 'customer#00000001') ORDER BY id LIMIT 1")
def graph_find(spark, d):
    return graph.find(graph.nodes_and_edges(_graph_tools(spark, d))[0], "customer#00000001")


@query("""WITH t AS (SELECT n_name AS category, c_custkey AS ord, c_name AS name, c_mktsegment AS language, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS use_case FROM customer JOIN nation ON c_nationkey = n_nationkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS r, CASE WHEN use_case IS NOT NULL THEN row_number() OVER (PARTITION BY category, use_case IS NULL ORDER BY ord) END AS u FROM t)
    SELECT category, count(*) AS n, coalesce(string_agg(CASE WHEN u <= 2 THEN use_case END, '；' ORDER BY ord), '') AS use_cases, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages, string_agg(CASE WHEN r <= 5 THEN name END, ',' ORDER BY ord) AS top FROM r GROUP BY category""")
def graph_categories(spark, d):
    g = graph.describe(_graph_tools(spark, d))
    return g.select("category", "n", "use_cases", F.concat_ws(",", "languages").alias("languages"), F.concat_ws(",", "top").alias("top"))


# ---- jobs

_J = "j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'pending' END AS status, o_orderdate AS created_at, o_custkey AS tool_id FROM orders)"


def _jobs(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("pending")
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), s.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("tool_id"))


@query(f"WITH {_J} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in jobs.STATES) + ", count(*) AS total FROM j")
def job_stats(spark, d):
    return jobs.counts(_jobs(spark, d))


@query(f"WITH {_J} SELECT job_id, status FROM j WHERE status = 'running' ORDER BY created_at DESC, job_id LIMIT 20")
def job_list(spark, d):
    return jobs.listed(_jobs(spark, d), "running").select("job_id", "status")


_FOLD = "l AS (SELECT o_orderkey AS job_id, unnest(['pending', 'running', CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'cancelled' ELSE 'running' END, CASE o_orderstatus WHEN 'O' THEN 'completed' END]) AS state, unnest([1, 2, 3, 4]) AS seq FROM orders)"


def _log(spark, d):
    s = F.col("o_orderstatus")
    states = F.array(F.lit("pending"), F.lit("running"), F.when(s == "F", "completed").when(s == "O", "cancelled").otherwise("running"), F.when(s == "O", "completed"))
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.posexplode(states).alias("seq", "state")).filter("state is not null")


@query(f"WITH {_FOLD} SELECT job_id, max_by(state, seq) AS state FROM l WHERE state IS NOT NULL GROUP BY job_id")
def job_state_fold(spark, d):
    return jobs.fold(_log(spark, d))


@query(f"WITH {_FOLD} SELECT job_id, coalesce(min_by(state, seq) FILTER (state IN ('completed', 'failed', 'timeout', 'cancelled')), max_by(state, seq)) AS state FROM l WHERE state IS NOT NULL GROUP BY job_id")
def job_state_final(spark, d):
    return jobs.fold(_log(spark, d), True)


@query(f"WITH {_J}, w AS (SELECT i AS job_id FROM range(0, 40000, 997) r(i)) SELECT w.job_id, CASE WHEN status IS NULL THEN 'not found' WHEN status = 'completed' THEN 'already finished' ELSE 'ok' END AS outcome FROM w LEFT JOIN j USING (job_id)")
def job_cancel(spark, d):
    return jobs.cancel(_jobs(spark, d), spark.range(0, 40000, 997).select(F.col("id").alias("job_id")))


@query("SELECT o_orderkey AS job_id, CAST(least(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 900 END * 1000, 120000), 600000) AS BIGINT) AS ms FROM orders")
def job_timeout(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 900).alias("s"))
    return o.select("job_id", jobs.timeout_ms(F.col("s")).alias("ms"))


_JOB_LOG = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, epoch_ms(o_orderdate) + (o_orderkey % 3600) * 1000 AS created FROM orders),
    j AS (SELECT k, created, CASE WHEN s <> 'P' OR k % 5 > 0 THEN created + 10000 END AS started, least(CASE WHEN k % 2 = 0 THEN c % 700 * 1000 ELSE 120000 END, 600000) AS allowed,
        CASE s WHEN 'F' THEN created + 10000 + c % 900 * 1000 WHEN 'O' THEN created + c % 250 * 1000 END AS ended, CASE WHEN s = 'O' THEN 'cancelled' WHEN k % 4 = 0 THEN 'failed' ELSE 'completed' END AS how FROM o)"""


def _job_events(spark, d):
    """A log of job events from orders: some end in time, some too late, some never, some are cancelled before they start."""
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    created = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (k % 3600) * 1000
    nothing = F.lit(None).cast("long")
    event = lambda kind, ms, allowed=nothing, code=F.lit(None).cast("int"): F.struct(F.lit(kind).alias("kind"), ms.alias("ms"), allowed.cast("long").alias("timeout_ms"), code.cast("int").alias("exit_code"))
    started = event("started", created + 10_000, jobs.timeout_ms(F.when(k % 2 == 0, c % 700)))
    ends = [F.when(s == "F", event("exited", created + 10_000 + c % 900 * 1000, code=F.when(k % 4 == 0, 1).otherwise(0))), F.when(s == "O", event("cancelled", created + c % 250 * 1000))]
    log = F.array_compact(F.array(event("created", created), F.when((s != "P") | (k % 5 > 0), started), *ends))
    return A.table(spark, d, "orders").select(k.alias("job_id"), F.explode(log).alias("e")).select("job_id", F.timestamp_millis("e.ms").alias("ts"), "e.kind", "e.timeout_ms", "e.exit_code")


@query(f"""WITH {_JOB_LOG} SELECT k AS job_id, CASE WHEN started IS NULL THEN 'pending' WHEN ended < started OR ended <= started + allowed THEN how ELSE 'timeout' END AS state,
    CAST(CASE WHEN started IS NULL THEN created WHEN ended < started OR ended <= started + allowed THEN ended ELSE started + allowed END AS BIGINT) AS at FROM j""")
def job_state_stream(spark, d):
    """Final states of jobs whose log arrives in two parts, each read by a run of the stream of its own; timers end what has no further event."""
    from skarn.streaming import jobs as J

    at = f"{scratch(spark)}/jobs-{uuid.uuid4().hex}"
    log = _job_events(spark, d)
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / 2
    log.filter("false").write.parquet(f"{at}/log")
    stream = J.transitions(spark.readStream.schema(log.schema).parquet(f"{at}/log"))
    for i in range(2):
        until = F.col("ts") < F.lit(first + step) if i == 0 else F.lit(True)
        log.filter((F.col("ts") >= F.lit(first + step * i)) & until).write.mode("append").parquet(f"{at}/log")
        J.drain(stream, at)
    # time goes on without any job: all deadlines pass
    end = log.limit(1).select(F.lit(-1).cast("long").alias("job_id"), (F.lit(last) + F.expr("interval 1 day")).alias("ts"), F.lit("created").alias("kind"), "timeout_ms", "exit_code")
    end.write.mode("append").parquet(f"{at}/log")
    J.drain(stream, at)
    return J.latest(spark, at).filter("job_id >= 0")


@query(f"""WITH RECURSIVE {Q.LOG}, b AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, user_query AS k FROM log WHERE type = 'search'),
    st AS (SELECT k, min(w) AS w FROM b GROUP BY k UNION ALL SELECT b.k, min(b.w) AS w FROM st JOIN b ON b.k = st.k AND b.w >= st.w + INTERVAL 15 DAY GROUP BY b.k, st.w)
    SELECT CAST(w AS DATE) AS week, count(*) AS asked, count(*) - count(st.k) AS hits, count(st.k) AS misses FROM b LEFT JOIN st USING (k, w) GROUP BY w""")
def cached_searches(spark, d):
    """A search log by weeks through a kept cache whose entries serve for 15 days: what it could answer in each week."""
    from skarn.operators.cache import KEY, ResultCache

    log = A.behaviour(spark, d).filter("type = 'search'").select(F.date_trunc("week", "ts").alias("week"), F.lit("v1").alias("fingerprint"), F.col("user_query").alias("query"), F.lit("").alias("filters")).distinct()
    at = f"{scratch(spark)}/cache-{uuid.uuid4().hex}"
    log.write.parquet(f"{at}/log")
    log = spark.read.parquet(f"{at}/log")
    cache, out = ResultCache(spark, f"{at}/cache", hours=15 * 24, most=1 << 40), None
    for (week,) in log.select("week").distinct().orderBy("week").collect():
        asked = log.filter(F.col("week") == F.lit(week))
        missed = cache.misses(asked, week).withColumn("results", F.concat(F.lit("results of "), "query"))
        cache = cache.put(missed, week)
        stored = spark.read.parquet(f"{at}/cache/batch-{cache.batches[-1]}").select(*KEY, F.lit(1).alias("new"))
        one = asked.join(stored, KEY, "left").groupBy("week").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("new").isNull()).alias("hits"), F.count("new").alias("misses"))
        out = one if out is None else out.union(one)
    return out.withColumn("week", F.to_date("week"))


@query("""WITH e AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, ts, event_id FROM events), k AS (SELECT w, count(*) AS n FROM e WHERE NOT (w = (SELECT min(w) FROM e) AND event_id % 7 = 0) GROUP BY w)
    SELECT 'running' AS output, CAST(w AS DATE) AS week_start, n FROM k UNION ALL SELECT 'closed', CAST(w AS DATE), n FROM k WHERE w + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def weekly_stream(spark, d):
    """Weeks of the event log read as a stream: running counts by update output, closed weeks by append output.

    Every seventh event of the first week arrives after that week is closed; both outputs leave it out.
    """
    from skarn.streaming import streams

    at = f"{scratch(spark)}/weeks-{uuid.uuid4().hex}"
    log = A.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    first = log.agg(F.min(F.date_trunc("week", "ts"))).first()[0]
    held = (F.date_trunc("week", "ts") == F.lit(first)) & (F.col("event_id") % 7 == 0)
    log.filter("false").write.parquet(f"{at}/log")
    weeks = streams.weekly(spark.readStream.schema(log.schema).parquet(f"{at}/log"))
    for part in (~held, held):
        log.filter(part).write.mode("append").parquet(f"{at}/log")
        for mode in ("update", "append"):
            streams.into_batches(weeks, f"{at}/{mode}", mode)
    said = [streams.newest(spark, f"{at}/{mode}", "week_start timestamp, n long", "week_start").withColumn("output", F.lit(name)) for mode, name in (("update", "running"), ("append", "closed"))]
    return said[0].union(said[1]).select("output", F.to_date("week_start").alias("week_start"), "n")


@query(f"""WITH {Q.SNAPS}, h AS (SELECT * FROM snaps WHERE week <> '2000-W10'), lv AS (SELECT full_name, stars + 1 AS stars FROM snaps WHERE week = '2000-W10')
    SELECT week, full_name, stars FROM h UNION ALL SELECT '2000-W10', full_name, coalesce(lv.stars, m.stars) FROM (SELECT full_name, max_by(stars, week) AS stars FROM h WHERE week < '2000-W10' GROUP BY 1) m FULL JOIN lv USING (full_name)""")
def weekly_run(spark, d):
    """All nine steps over kept snapshots, stopped before the last three and run again: the snapshots of every week afterwards."""
    from skarn.operators.weekly_run import WeeklyRun

    week, root = "2000-W10", f"{scratch(spark)}/weekly-{uuid.uuid4().hex}"
    A.snapshots(spark, d).write.partitionBy("week").parquet(f"{root}/snapshots")
    bare = F.lower(F.regexp_replace("full_name", "_", "-"))
    live = trending.of_week(spark.read.schema("full_name string, stars long, week string").parquet(f"{root}/snapshots"), week).select(
        "full_name", (F.col("stars") + 1).alias("stars"), F.lit(0).alias("query_idx"), F.regexp_extract("full_name", r"(\d+)$", 1).cast("int").alias("item_idx"), F.lit(False).alias("fork"),
        F.lit("1999-01-01").cast("date").alias("created_at"), F.concat(F.lit("https://h/"), bare).alias("url"), F.lit("owner").alias("owner"), bare.alias("bare"),
    )
    nation = A.table(spark, d, "nation").filter("n_regionkey = 0")
    registry = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("full_name"), F.concat(F.lit("https://r/"), "n_name").alias("url"))

    def stop(step):
        if step == "candidates":
            raise InterruptedError(step)

    try:
        WeeklyRun(spark, root, week).run(registry, live, "2000-W09", "2000-W08", "2000-03-12", stop)
    except InterruptedError:
        pass
    run = WeeklyRun(spark, root, week)
    run.run(registry, live, "2000-W09", "2000-W08", "2000-03-12")
    return run.snapshots().select("week", "full_name", "stars")


# ---- extensions

@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, floor(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS cos FROM embeddings, q ORDER BY cos DESC, vec_id LIMIT 20""")
def dense_cosine_topk(spark, d):
    v = A.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    q = v.filter("vec_id = 0").limit(1).select(F.col("e").alias("q"))  # one stated query
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    c = v.crossJoin(F.broadcast(q)).select("vec_id", X.round_to(dot("e", "q") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("q", "q"))), 6).alias("cos"))
    return c.orderBy(F.desc("cos"), "vec_id").limit(20)


@query(f"WITH {Q.TRACES} SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n FROM traces GROUP BY 1")
def weekly_windows(spark, d):
    w = A.table(spark, d, "events").groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.to_date("w.start").alias("week_start"), "n")


# ---- connectors and reports

@query(f"""WITH {Q.TOOLS}, t AS (SELECT 'total' AS kind, 'tools' AS label, count(*) AS value FROM tools UNION ALL SELECT 'total', 'stars', CAST(sum(stars) AS BIGINT) FROM tools UNION ALL SELECT 'total', 'mean_stars', CAST(floor(avg(stars) + 0.5) AS BIGINT) FROM tools),
    c AS (SELECT 'category', cat, count(*) FROM tools GROUP BY cat ORDER BY 3 DESC, 2 LIMIT 5), l AS (SELECT 'language', language, count(*) FROM tools GROUP BY language ORDER BY 3 DESC, 2 LIMIT 5)
    SELECT * FROM t UNION ALL SELECT * FROM c UNION ALL SELECT * FROM l""")
def statistics_page(spark, d):
    return reports.statistics(A.catalog(spark, d))


@query("SELECT p_partkey // 25 AS repo, 'tools/' || p_name || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'skill' ELSE 'readme' END AS kind FROM part WHERE p_partkey // 25 % 2 = 0 AND p_partkey % 25 < 10")
def monorepo_parts(spark, d):
    p = A.table(spark, d, "part")
    odd = F.floor(F.col("p_partkey") / 25) % 2 == 1
    listing = p.select(F.floor(F.col("p_partkey") / 25).cast("string").alias("repo"), F.concat(F.when(odd, "src/").otherwise("tools/"), "p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("ord"), (F.col("p_size") % 2 == 0).alias("has_skill"), F.lit(True).alias("has_readme"))
    return connectors.monorepo_parts(listing).select(F.col("repo").cast("long").alias("repo"), "path", "kind")


@query("""SELECT n_nationkey AS repo, CASE WHEN n_nationkey % 3 = 0 THEN 'main' WHEN n_nationkey % 3 = 1 THEN 'master' ELSE 'dev' END AS branch FROM nation""")
def first_branch(spark, d):
    k = F.col("n_nationkey")
    rows = A.table(spark, d, "nation").select(k.alias("repo"), F.explode(F.array(F.lit("dev"), F.lit("main"), F.lit("master"), F.lit("other"))).alias("branch"))
    r, b = F.col("repo") % 3, F.col("branch")
    answered = (b == "dev") | (b == "other") | (b == "main") & (r == 0) | (b == "master") & (r <= 1)
    return connectors.first_branch(rows.withColumn("content", F.when(answered, "text"))).select("repo", "branch")


@query("SELECT p_partkey AS k, replace(p_name, ' ', '-') AS id, CASE WHEN p_partkey % 2 = 0 THEN 'pip' ELSE 'git-clone-sparse' END AS method, 'experimental' AS status FROM part")
def scanned_tools(spark, d):
    k = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    meta = A.table(spark, d, "part").select(F.concat(F.lit("https://github.com/o/"), k.cast("string"), F.lit("/")).alias("url"), F.lit("o").alias("owner"), F.when(k % 2 == 0, name).otherwise("r").alias("repo"), F.when(k % 2 == 1, F.concat(F.lit("x/"), name)).alias("subpath"), F.col("p_type").alias("description"), F.lit("python").alias("language"), F.array("p_brand").alias("topics"))
    s = connectors.scanned_tool(meta)
    return s.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("k"), "id", "method", "status")


@query(f"""WITH {Q.SNAPS}, r AS (SELECT week, full_name, row_number() OVER (PARTITION BY week ORDER BY stars DESC, full_name) AS rank FROM snaps)
    SELECT week AS doc, CAST(week[8:8] AS INTEGER) < 9 AS ok, CASE WHEN CAST(week[8:8] AS INTEGER) < 9 THEN week END AS week, max(CASE WHEN CAST(week[8:8] AS INTEGER) < 9 AND rank = 1 THEN full_name END) AS first, CAST(CASE WHEN CAST(week[8:8] AS INTEGER) < 9 THEN count(*) END AS INTEGER) AS n_items FROM r GROUP BY week""")
def leaderboard_fields(spark, d):
    """Saved leaderboards of every week, in the newer form, the older one, or cut short: weeks by their last digit."""
    from pyspark.sql import Window

    s = A.snapshots(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("stars"), "full_name")))
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("full_name").alias("fullName"), F.col("stars").alias("delta"))))  # a nation each
    w = s.groupBy("week").agg(items.alias("items"))
    old, digit = F.to_json(F.struct("week", "items")), F.substring("week", 8, 1).cast("int")
    new = F.to_json(F.struct(F.struct("week", "items").alias("lastWeek"), F.lit("2000-W01").alias("week"), F.lit(3).alias("version")))
    doc = F.when(digit < 5, new).when(digit < 9, old).otherwise(F.substring(old, 1, 20))
    f = w.select(F.col("week").alias("doc"), connectors.leaderboard_fields(doc).alias("f"))
    return f.select("doc", "f.ok", "f.week", F.get("f.items", F.lit(0))["fullName"].alias("first"), F.when(F.col("f.ok"), F.size("f.items")).alias("n_items"))


_WTD = f"WITH wtd AS ({ORACLE_SQL['week_to_date']})"


@query(f"""{_WTD} SELECT rank, CASE rank WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE CAST(rank AS VARCHAR) END AS mark, full_name,
    CASE WHEN delta > 0 THEN '+' || format('{{:,}}', delta) ELSE format('{{:,}}', stars) || ' (待比對)' END AS change FROM wtd WHERE rank <= 10""")
def leaderboard_view(spark, d):
    return reports.leaderboard_view(week_to_date(spark, d))


@query(f"""{_WTD} SELECT '# 2001-W30' || chr(10) || chr(10) || '- tracked: 25' || chr(10) || '- live: 25' || chr(10) || chr(10) || '| rank | repository | stars | delta |' || chr(10) || '|---|---|---|---|' || chr(10)
    || coalesce(string_agg(printf('| %d | %s | %d | +%d |', rank, full_name, stars, delta), chr(10) ORDER BY rank), '') AS text FROM wtd WHERE rank <= 10""")
def weekly_report(spark, d):
    return reports.weekly_report(week_to_date(spark, d), "2001-W30", 25, 25)


@query(f"""{_WTD}, k AS (SELECT DISTINCT 'https://x/' || lower(n_name) AS url FROM nation WHERE n_nationkey % 2 = 0), a AS (SELECT DISTINCT 'https://x/' || n_name AS url FROM nation WHERE n_nationkey % 3 = 0),
    r AS (SELECT rank, 'https://x/' || full_name AS url FROM wtd) SELECT rank, url, lower(url) IN (SELECT url FROM k) AS in_registry, url IN (SELECT url FROM a) AS was_added FROM r""")
def leaderboard_flags(spark, d):
    n = A.table(spark, d, "nation")
    url = lambda name: F.concat(F.lit("https://x/"), name).alias("url")
    ranked = week_to_date(spark, d).select("rank", url(F.col("full_name")))
    known, added = n.filter("n_nationkey % 2 = 0").select(url(F.lower("n_name"))), n.filter("n_nationkey % 3 = 0").select(url(F.col("n_name")))
    return trending.flagged(ranked, known, added)


@query(r"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS stamp FROM events""")
def utc_stamp(spark, d):
    return A.table(spark, d, "events").select("event_id", calendar.stamp(F.col("ts")).alias("stamp"))


_URL = "'https://github.com/' || replace(lower(p_brand), '#', '-') || '/' || replace(p_name, ' ', '-')"


@query(f"""SELECT p_partkey AS k, replace(lower(p_brand), '#', '-') AS owner, replace(p_name, ' ', '-') AS repo, CASE WHEN p_partkey % 3 > 0 THEN 'main' END AS branch,
    CASE WHEN p_partkey % 3 = 2 THEN 'skills/' || lower(p_type) END AS subpath, CASE WHEN p_partkey % 3 = 2 THEN lower(p_type) ELSE replace(p_name, ' ', '-') END AS base FROM part""")
def repository_url_parts(spark, d):
    k, t = F.col("p_partkey") % 3, A.table(spark, d, "part")
    base = F.concat(F.lit("https://github.com/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))
    url = F.when(k == 0, F.concat(base, F.lit(".git"))).when(k == 1, F.concat(base, F.lit("/tree/main"))).otherwise(F.concat(base, F.lit("/blob/main/skills/"), F.lower("p_type")))
    return t.select(F.col("p_partkey").alias("k"), X.repository_url(url).alias("u")).select("k", "u.*")


@query(f"""WITH {Q.SNAPS}, n AS (SELECT CASE WHEN full_name < 'NATION_2' THEN full_name ELSE 'o/' || full_name END AS full_name, stars, week FROM snaps)
    SELECT full_name, min_by(stars, week) AS stars, false AS in_registry FROM n WHERE stars >= 50 AND full_name LIKE 'o/%' GROUP BY full_name""")
def tracked_two_parts(spark, d):
    name = F.when(F.col("full_name") < "NATION_2", F.col("full_name")).otherwise(F.concat(F.lit("o/"), "full_name"))
    nothing = spark.createDataFrame([], "full_name string")
    return trending.tracked(nothing, A.snapshots(spark, d).withColumn("full_name", name), two_parts=True)


@query(f"""WITH {Q.TOOLS} SELECT id, CASE WHEN ord % 2 = 0 THEN 'said ' || name ELSE description END AS description, CASE WHEN ord % 2 = 0 THEN ['new one', 'new two'] ELSE triggers END AS triggers,
    CASE WHEN ord % 2 = 0 AND ord % 4 = 0 THEN ['a'] ELSE advantages END AS advantages,
    CASE WHEN ord % 2 = 0 AND use_case IS NOT NULL AND len(negs) > 0 AND (ord % 4 = 0 OR len(advantages) > 0) THEN 'active' ELSE status END AS status FROM tools""")
def enrichment_merge(spark, d):
    t = A.catalog(spark, d)
    some = F.when(F.col("ord") % 4 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    answers = t.filter("ord % 2 = 0").select("id", F.concat(F.lit("said "), "name").alias("description"), F.lit("").alias("useCase"), F.array(F.lit("new one"), F.lit("new two")).alias("triggers"), some.alias("advantages"))
    return contract.enriched(t, answers).select("id", "description", "triggers", "advantages", "status")


@query(f"""WITH {Q.TOOLS} SELECT id, 'error' AS severity, 'no_name' AS rule FROM tools WHERE ord % 9 = 0 UNION ALL SELECT id, 'error', 'no_url' FROM tools WHERE ord % 10 = 0
    UNION ALL SELECT id, 'error', 'no_category' FROM tools WHERE ord % 11 = 0 UNION ALL SELECT id, 'warning', 'no_triggers' FROM tools WHERE ord % 13 = 0""")
def taxonomy_issues(spark, d):
    o = F.col("ord")
    t = A.catalog(spark, d).withColumn("name", F.when(o % 9 > 0, F.col("name"))).withColumn("url", F.when(o % 10 > 0, F.col("url")).otherwise(" "))
    t = t.withColumn("category", F.when(o % 11 > 0, F.col("category")).otherwise(F.array(F.lit("")))).withColumn("triggers", F.when(o % 13 > 0, F.col("triggers")))
    return contract.taxonomy_issues(t)


@query("SELECT count(*) FILTER (page_id % 5 > 0 AND page_id % 7 > 0) AS healthy, count(*) FILTER (page_id % 5 = 0 OR page_id % 7 = 0) AS failed FROM pages")
def health_counts(spark, d):
    k = F.col("page_id")
    return connectors.health(A.table(spark, d, "pages").select("url", F.when(k % 5 == 0, 404).when(k % 7 > 0, 200 + k % 200).alias("status")))


@query(f"WITH {Q.TOOLS}, p AS (SELECT lower(url) AS u, max(stars + 7) AS s FROM tools WHERE ord % 2 = 0 GROUP BY 1) SELECT id, coalesce(s, stars) AS stars FROM tools LEFT JOIN p ON lower(url) = u")
def synced_stars(spark, d):
    t = A.catalog(spark, d)
    return connectors.synced_stars(t, t.filter("ord % 2 = 0").select(F.upper("url").alias("url"), (F.col("stars") + 7).alias("stars"))).select("id", "stars")


@query("SELECT DISTINCT n_name || '/r@' || CASE WHEN s_suppkey % 3 = 0 THEN 'r' ELSE 's' || s_suppkey % 50 END AS id, n_name || '/r' AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def skill_rows(spark, d):
    s = A.table(spark, d, "supplier").join(F.broadcast(A.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    path = F.when(k % 3 == 0, "SKILL.md").otherwise(F.concat(F.lit("skills/s"), (k % 50).cast("string"), F.lit("/SKILL.md")))
    return connectors.skills_from_code_search(s.select(F.concat("n_name", F.lit("/r")).alias("full_name"), path.alias("path"))).select("id", "source")


@query(f"WITH {Q.TRACES}, {Q.STATS} SELECT tool_id, total, success, fail, success_rate FROM stats")
def materialized_summary(spark, d):
    """The telemetry summary as a table with an age, built where there is none; read back."""
    return telemetry.materialized(A.traces(spark, d), f"{scratch(spark)}/summary-{hashlib.sha256(d.encode()).hexdigest()[:16]}").drop("generated_at")


@query(f"WITH {Q.TRACES}, {Q.STATS} SELECT tool_id, total, success, fail FROM stats")
def trace_stream_parity(spark, d):
    """The running statistics of the trace log read as a stream, to its end."""
    from skarn.streaming.streams import drained, running_stats

    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    n = A.table(spark, d, "part").count()
    stream = e.select(F.concat(F.lit("part-"), (F.col("event_id") % n).cast("string")).alias("tool_id"), (F.col("event_type") != "error").alias("success"))
    return drained(running_stats(stream), f"{scratch(spark)}/stream")


_CTX_NONE = "greatest(0.01, " + Q.round_to("post + CASE WHEN stars > 1000 THEN least(0.05 * log10(stars), 0.20) ELSE 0 END", 2) + ")"


@query("SELECT rank, id, CAST(floor(score * 100 + 0.5) AS INTEGER) AS percent, name, url, stars, coalesce(use_case, description) AS fits FROM (" + Q.best("steel widget zinc", 5, _CTX_NONE) + ") b JOIN (WITH " + Q.TOOLS + " SELECT * FROM tools) t USING (id)")
def compare_tools(spark, d):
    from skarn.operators import search
    from skarn.plans.queries import one

    return search.compare(A.catalog(spark, d), one(spark, "steel widget zinc"), synonyms=synonyms.seed_links(spark)).select("rank", "id", "percent", "name", "url", "stars", "fits")
