"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar is translated to a zero-width regex that matches between two characters where one unit ends and the next begins:
a class of characters before (lookbehind) and one after (lookahead). Spark's split at such matches takes no character away,
so the pieces are the units and joined they are the text. An empty text has no unit, where split would give one empty piece.

Of each document, two boundaries among its n units are drawn from a hash of its doc_id: prefix, middle and suffix lie
between them. The output is plain text, or the parts behind sentinels with the middle last (`psm`: prefix first, `spm`: suffix first).

Defined results: a null text is empty; a text that is empty or has a sentinel in it stays plain, as then the output could not be read
back; a null doc_id hashes as the empty string; equal rows give equal rows; a very long text is one row and one array of units.
Other columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = r"[\s\S]"
#: Unit grammars: (grammar, class before a boundary, class after it), several where units end in several ways.
GRAMMARS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "lines": (r"[^\n]*\n|[^\n]+", [(r"\n", ANY)]),
    "paragraphs": (r"(?:[^\n]|\n(?!\n))*\n{2,}|(?:[^\n]|\n(?!\n))+", [(r"\n\n", r"[^\n]")]),
    "words": (r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", [(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")]),
    "runs": (r"[0-9A-Za-z_]+|[^0-9A-Za-z_]+", [(r"[0-9A-Za-z_]", r"[^0-9A-Za-z_]"), (r"[^0-9A-Za-z_]", r"[0-9A-Za-z_]")]),
    "characters": (ANY, [(ANY, ANY)]),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundary(grammar: str) -> str:
    """The zero-width regex between two units of a grammar."""
    return "|".join(f"(?<={before})(?={after})" for before, after in GRAMMARS[grammar][1])


def units(text: Column, grammar: str = "lines") -> Column:
    """The units of a text in order, as an array; none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def check_sentinels(*marks: str) -> None:
    """Raises unless each mark can be found again wherever text without marks stands around it: none overlaps another or itself."""
    for i, a in enumerate(marks):
        if not a:
            raise ValueError("a sentinel is empty")
        for j, b in enumerate(marks):
            if i != j and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (i != j))):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")


def infill(docs: DataFrame, grammar: str = "lines", seed: str = "7:", rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain) and output of each row of docs (doc_id, text).

    rate: percent of documents that are transformed; spm: percent of these with the suffix first.
    """
    check_sentinels(*marks)
    p, s, m = marks
    draw = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring(draw, 8 * k + 1, 8), 16, 10).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select("doc_id", text.alias("text"), units(text, grammar).alias("units"), h(0).alias("h1"), h(1).alias("h2"), h(2).alias("h3"), h(3).alias("h4"))
    n = F.size("units").cast("long")
    marked = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    x = x.select("doc_id", "text", "units", n.alias("n"), form.alias("form"), F.least(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int").alias("a"), F.greatest(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int").alias("b"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    x = x.select("doc_id", "text", "n", "form", part(F.lit(1), F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), part(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"))
    psm, turned = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"), F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    return x.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(turned).alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of a form was made from."""
    # as no mark is in the text and none can overlap another, each is found once
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    one = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one(1), one(3), one(2))).otherwise(F.concat(one(2), one(3), one(1)))
