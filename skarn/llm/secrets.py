"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) come from fixed patterns. Other patterns find weak parts: key identifiers
(`weak_id`), token-like strings (`weak_secret`) and endpoints (`weak_endpoint`). A scope is a paragraph: no blank line inside. Within a
scope, an interval join looks for complementary parts at most `reach` characters away: a weak identifier or
endpoint needs a secret, a weak secret needs an identifier or an endpoint; base spans count as parts (access as an
identifier, assign and hex as secrets). Weak parts without a partner, or overlapping a base span, are not reported.

The join is a sort by position in the scope and the last part before and first after that can complete a
candidate, so its cost follows the number of parts even where one scope holds a great many of them.

Defined results: a null text is empty; rows that repeat are scanned each on their own; offsets count code points
from 0, ends exclusive; a row without spans has an empty list; a very long text is one row, its parts one sort. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: none of them crosses a line.
WEAK_ID = r"(?i:(?<!secret)(?<!secret[_-])access_?key(?:_?id)?|client_?id|user_?name|account|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@+/_.-]{3,}"
#: A token that no name of an identifier or host stands before, or whatever a secret access key is set to.
_SET = r"[\"']?\x20{0,8}[:=]\x20{0,8}[\"']?"
WEAK_SECRET = (
    r"(?<![A-Za-z0-9+/_.-])(?:(?=[A-Za-z0-9+/_]{20})(?=[A-Za-z0-9+/_]*[0-9])(?=[A-Za-z0-9+/_]*[a-z])(?=[A-Za-z0-9+/_]*[A-Z])"
    rf"(?<!(?i:(?<!secret)(?<!secret[_-])access_?key(?:_?id)?|client_?id|user_?name|account|login|host|endpoint|server){_SET})[A-Za-z0-9+/_]{{20,}}={{0,2}}"
    rf"|(?=[A-Za-z0-9+/_.-]{{6}})(?<=[:=\x20\"'])(?<=(?i:secret[_-]?access_?key){_SET})[A-Za-z0-9+/_.-]{{6,}}={{0,2}})"
)
WEAK_ENDPOINT = r"(?:(?:https?|s3|jdbc:[a-z]{2,12}|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9@:._-]+|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{4,})"
BREAK = r"\n[\x20\t\r]*\n"

KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint"]


def _events(text: Column, kind: int, pattern: str, value: int | None = None) -> Column:
    """The matches of a pattern in order: gap before each (code points), its length, that of the value group."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = sizes if value is None else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value)), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("value"))
    found = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(found, lambda x: x["size"].isNotNull()))


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id and spans (array of struct<kind, start, end>, by start, then kind) for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [_events(text, 0, ASSIGN, 2), _events(text, 1, ACCESS), _events(text, 2, HEX), _events(text, 3, WEAK_ID), _events(text, 4, WEAK_SECRET), _events(text, 5, WEAK_ENDPOINT)]
    nothing = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:int>>")
    every = F.concat(*[F.coalesce(k, nothing) for k in kinds])
    # paragraph ends matter only where there are two parts to keep apart
    breaks = F.coalesce(_events(text, 6, BREAK), nothing)
    parts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", every.alias("parts"), F.when(F.size(every) > 1, breaks).otherwise(nothing).alias("breaks"))
    rows = parts.select("row", "doc_id", F.explode_outer(F.concat("parts", "breaks")).alias("e")).select("row", "doc_id", "e.*")

    in_kind = Window.partitionBy("row", "kind").orderBy("i")
    placed = rows.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_kind.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("start", F.col("end") - F.col("size")).filter(F.expr("kind is null or kind <> 0 or value >= 6"))
    # what comes next is what a window over the reverse order has seen last: each row costs the same
    in_order = Window.partitionBy("row").orderBy("start", "kind")
    in_reverse = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("scope", F.sum(F.when(F.col("kind") == 6, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    base_end = F.max(F.when(F.col("kind") <= 2, F.col("end"))).over(before)
    base_next = F.min(F.when(F.col("kind") <= 2, F.col("start"))).over(in_reverse.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("clear", F.coalesce(base_end <= F.col("start"), F.lit(True)) & F.coalesce(base_next >= F.col("end"), F.lit(True)))

    in_scope = Window.partitionBy("row", "scope").orderBy("start", "kind")
    scope_reverse = Window.partitionBy("row", "scope").orderBy(F.desc("start"), F.desc("kind"))
    part = (F.col("kind") <= 2) | F.col("clear")

    def beside(*of: int) -> Column:
        """Whether a part of these kinds lies within reach in the scope."""
        is_one = part & F.col("kind").isin(*of)
        last = F.max(F.when(is_one, F.col("end"))).over(in_scope.rowsBetween(Window.unboundedPreceding, -1))
        then = F.min(F.when(is_one, F.col("start"))).over(scope_reverse.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(then - F.col("end") <= reach, F.lit(False))

    joined = placed.withColumn("by_secret", beside(0, 2, 4)).withColumn("by_other", beside(1, 3, 5))
    told = (F.col("kind") <= 2) | F.col("clear") & (F.col("kind").isin(3, 5) & F.col("by_secret") | (F.col("kind") == 4) & F.col("by_other"))
    name = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(told, F.struct(F.col("start"), F.col("kind"), F.col("end"), name.alias("name")))
    spans = joined.withColumn("span", span).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("span")).alias("s"))
    return spans.select("doc_id", F.transform("s", lambda x: F.struct(x["name"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
