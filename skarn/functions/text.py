"""Text primitives as column expressions: no Python runs on the executors.

White space is the Unicode set, not Java's ASCII one, and word boundaries are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Single characters below 256 are one table lookup in Java, and all others but those from 256 on are ruled out by one comparison; as plain
# members of the class each range and each character would be tried in turn for every character of a text.
_LOW, _HIGH = r"\t\n\x0b\f\r \xa0", r"  -     　﻿"
SPACE = rf"[{_LOW}[Ā-￿&&[{_HIGH}]]]"
SEPARATORS = rf"[{_LOW},;:!?\-_/\\[Ā-￿&&[{_HIGH}，。、；：！？]]]+"
# Words added to the tokens of a text that contains them.
SUB_KEYWORDS = ["網頁", "爬蟲", "動態", "簡報", "股票", "語音", "影片", "圖片", "文件", "測試", "數據", "資料", "自動化", "量化", "視覺"]
# Spoken openings that are taken off a query.
SPOKEN = "^(我想|請幫我|幫我|我要|我想要|如何|要如何|可以用|我需要|要怎麼|怎麼)" + SPACE + "*"


def norm(c: Column) -> Column:
    """Lower case, white space runs as one space, trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SPACE + "+", " "))


def norm_array(c: Column) -> Column:
    return norm(F.concat_ws(" ", c))


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def tokens(normed: Column) -> Column:
    """Distinct tokens of a normalised text, in order, with the sub-keywords that they contain.

    Sub-keywords have no separator in them, so one lies in a token if it lies in the text.
    """

    def found(t: Column) -> Column:
        words = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(k)), k) for k in SUB_KEYWORDS]))
        return F.array_union(F.array_remove(F.split(t, SEPARATORS), ""), words)

    return bind(normed, found)


def bigrams(normed: Column) -> Column:
    """Distinct pairs of neighbouring characters, white space left out; a shorter text is its own."""

    def grams(z: Column) -> Column:
        pairs = lambda x: F.regexp_extract_all(x, F.lit("(?s)(..)"), F.lit(1))
        # every second pair, from the first character and from the second
        return F.when(F.length(z) < 2, F.array(z)).otherwise(F.array_distinct(F.concat(pairs(z), pairs(F.substring(z, 2, 1 << 30)))))

    return bind(F.replace(normed, F.lit(" "), F.lit("")), grams)  # the only white space that it has


def terms_and_grams(text: Column) -> Column:
    """struct of the tokens (terms) and bigrams (grams) of a text, which is normalised once for both."""
    return bind(norm(text), lambda t: F.struct(tokens(t).alias("terms"), bigrams(t).alias("grams")))


def dealt(rows: DataFrame) -> DataFrame:
    """rows in at least as many partitions as there are cores: a file of one row group would be the work of one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def strip_spoken(query: Column) -> Column:
    """The query without one spoken opening, if anything remains."""
    rest = F.regexp_replace(query, SPOKEN, "")
    return F.when(F.length(F.trim(rest)) > 0, rest).otherwise(query)


def round_to(x: Column, digits: int) -> Column:
    """Half up at the decimal, by floor: the same in every engine."""
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits


def any_word(text: Column, words: str) -> Column:
    """Whether one of the words (a|b|c) stands in the text between ASCII word boundaries."""
    return F.rlike(text, F.lit(f"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"))


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-+", "-"), "^-|-$", "")


def owner_repo(url: Column) -> tuple[Column, Column]:
    """Owner and repository of a hosting URL; null where it is none."""
    pattern = r"(?i)github\.com/([^/\s]+)/([^/\s#?]+)"
    owner, repo = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.nullif(owner, F.lit("")), F.nullif(F.regexp_replace(repo, r"\.git$", ""), F.lit(""))


def title_case(name: Column) -> Column:
    """Dashes as spaces, the first letter of each word raised, the rest as it was."""
    words = F.split(F.replace(name, F.lit("-"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), " ")


def word_at_first(text: Column, keyword: Column) -> Column:
    """Whether the first occurrence of keyword has an end, space, '-' or '_' on both sides."""
    at = F.instr(text, keyword)
    before, after = F.substr(text, at - 1, F.lit(1)), F.substr(text, at + F.length(keyword), F.lit(1))
    edge = ["", " ", "-", "_"]
    return (at > 0) & ((at == 1) | before.isin(*edge)) & after.isin(*edge)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.coalesce(c, F.lit(""))


def safe_url(url: Column) -> Column:
    return F.when(F.rlike(F.trim(F.coalesce(url, F.lit(""))), F.lit(r"(?i)^https?://[^\s/]")), F.trim(url)).otherwise("#")


def star_count(n: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", F.floor(n / 100.0 + 0.5) / 10.0), F.lit("k"))).otherwise(n.cast("string"))


def shell_quote(arg: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(arg, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def contrast(hex_color: Column) -> Column:
    """Black text on light colours, white on dark ones and on what is no colour."""
    h = F.replace(hex_color, F.lit("#"), F.lit(""))

    def part(i: int) -> Column:
        return F.conv(F.substring(h, i, 2), 16, 10).cast("double")

    light = (0.299 * part(1) + 0.587 * part(3) + 0.114 * part(5)) / 255
    return F.when((F.length(h) == 6) & (light > 0.6), "#000000").otherwise("#ffffff")


def category_color(fixed: dict[str, str], category: Column, index: Column) -> Column:
    """The fixed colour of a category, else a hue from its position."""
    hue = F.concat(F.lit("hsl("), F.floor((index * 137.5 + 200) % 360).cast("string"), F.lit(", 65%, 48%)"))
    if not fixed:
        return hue
    table = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
    return F.coalesce(table[category], hue)


def fnv1a(text: Column, start: Column) -> Column:
    """32-bit FNV-1a over code points, going on from a start value."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, start.cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619).cast("long"), F.lit(1 << 32).cast("long")))


def markdown_description(content: Column, limit: int = 200) -> Column:
    """`description:` of the front matter, else the first plain paragraph."""
    front = F.regexp_extract(content, r"(?s)^---(.*?)---", 1)
    told = F.regexp_extract(front, r"description:[\s]*([^\n]+)", 1)
    told = F.regexp_replace(F.trim(told), "^['\"]|['\"]$", "")
    body = F.trim(F.regexp_replace(content, r"(?s)^---.*?---", ""))
    plain = F.filter(F.split(body, "\n\n"), lambda p: (F.trim(p) != "") & ~F.substring(p, 1, 1).isin("#", "!", "<", "-"))
    first = F.substring(F.trim(F.replace(F.get(plain, F.lit(0)), F.lit("\n"), F.lit(" "))), 1, limit)
    return F.when(told != "", told).otherwise(F.coalesce(first, F.lit("")))


def strip_boilerplate(description: Column, owner: Column, repo: Column) -> Column:
    """Without a hosting site's "Contribute to owner/repo ... GitHub." sentence."""
    low = F.lower(description)
    opening = F.lower(F.concat(F.lit("Contribute to "), owner, F.lit("/"), repo))
    at = F.instr(low, opening)
    rest = F.substr(low, at + F.length(opening))
    site = F.instr(rest, F.lit("github"))
    end = at + F.length(opening) + site - 1 + 6
    end = F.when(F.substr(description, end, F.lit(1)) == ".", end + 1).otherwise(end)
    cut = F.trim(F.concat(F.substr(description, F.lit(1), at - 1), F.substr(description, end)))
    return F.when((at > 0) & (site > 0), cut).otherwise(description)


def trigger_list(name: Column, topics: Column, limit: int = 8) -> Column:
    parts = F.filter(F.split(F.lower(name), "-"), lambda w: F.length(w) > 2)
    return F.slice(F.array_distinct(F.concat(F.array(F.lower(name)), parts, topics)), 1, limit)


def repository_url(url: Column) -> Column:
    """struct of owner, repo, branch, subpath and id base of a repository URL, with /tree/ or /blob/, branch and path or not; null if it is none."""
    pattern = r"github\.com/([^/\s]+)/([^/\s#?]+?)(?:\.git)?(?:/(?:tree|blob)/([^/\s]+)(?:/([^\s#?]*?))?)?/?$"
    part = lambda k: F.nullif(F.regexp_extract(url, pattern, k), F.lit(""))
    base = F.coalesce(F.element_at(F.split(part(4), "/"), -1), part(2))
    return F.when(F.rlike(url, F.lit(pattern)), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("branch"), part(4).alias("subpath"), base.alias("base")))
