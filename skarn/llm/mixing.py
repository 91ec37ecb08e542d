"""Temperature mixing: source shares to an exponent, realised as budgeted block permutations.

A source with share p of all words gets weight p**a / sum. The exponent a is bisected: down from 1 until the
weights' entropy reaches `entropy` times its maximum, and up again as far as no source may repeat more than
`repeats` times within the budget. A source whose weight asks for e epochs gives every document floor(e) times and
a part of one more epoch. Each epoch is a permutation by hash, cut into blocks of about `block_words`; the part ends
where its words are used up: block sums find the block, and only that block is put in order to find the place.

So which rows appear is a test on each row's own hash against a number kept for its source: documents are not
shuffled, and a hot source has as many tasks as it has files. The table of sources stays distributed; it is broadcast while it
has at most `broadcast_sources` rows, and joined by shuffle beyond. The exponent is found from a histogram of source sizes
(sources in a 4096th of an octave count with their mean), so what the driver sees does not grow with the sources.

Shares are of white-space words, which stand for tokens; a script without spaces has few of them.

Defined results: a null text has no words; a source without words gives each document once; a null source is a
source of its own; rows that repeat share a hash and appear alike; no documents give no rows; where no exponent keeps `repeats`
(a budget above `repeats` times the corpus), sources keep their shares, which repeats the smallest least, and exceed it. Columns
named epoch, block, n_words and order_key are replaced if `extras` gives these, all others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import WORD, cut, fresh

TOP = (1 << 63) - 1


def weights(words: list[float], exponent: float, sources: list[float] | None = None) -> list[float]:
    """Weights of sources of these sizes. sources: how many there are of each size; a weight is then that of one."""
    top = max(words)
    raw = [(w / top) ** exponent for w in words]
    total = sum(raw) if sources is None else sum(r * n for r, n in zip(raw, sources, strict=True))
    return [r / total for r in raw]


def entropy_of(w: list[float], sources: list[float] | None = None) -> float:
    return -sum(x * math.log(x) * n for x, n in zip(w, sources or [1] * len(w), strict=True) if x > 0)


def _bisect(holds, steps: int = 60) -> float:
    """The largest exponent in [0, 1] at which holds() is true, holds being true at 0 if anywhere."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def exponent_for(words: list[float], budget: float, entropy: float | None, repeats: float | None, sources: list[float] | None = None) -> float:
    """The exponent for these source sizes (all > 0), of each of which there are `sources` (one by default)."""
    a, n = 1.0, len(words) if sources is None else sum(sources)
    if entropy is not None and n > 1:
        goal = entropy * math.log(n)
        a = _bisect(lambda x: entropy_of(weights(words, x, sources), sources) >= goal)
    if repeats is not None:

        def most(x: float) -> float:
            return max(v * budget / w for v, w in zip(weights(words, x, sources), words, strict=True))

        if most(a) > repeats:  # less flat weights repeat small sources less
            a = 1 - _bisect(lambda x: most(1 - x) <= repeats) if most(1.0) <= repeats else 1.0
    return a


def _hash(epoch: Column) -> Column:
    return F.xxhash64(F.lit(77), "doc_id", "text", epoch)


def _share(u: Column) -> Column:
    """A hash as a number in [0, 1), in the same order."""
    return F.least(u.cast("double") / float(1 << 64) + 0.5, F.lit(1 - 2.0**-53))


def mix(
    docs: DataFrame,
    entropy: float | None = 0.95,
    repeats: float | None = 4.0,
    budget: float | None = None,
    block_words: int = 1_000_000,
    broadcast_sources: int = 10_000,
    extras: bool = True,
) -> DataFrame:
    """docs (doc_id, text, source, ...), each row as often as the mixture takes it.

    budget: words in all, as many as the corpus has by default. extras adds epoch, block (its part of the epoch's
    permutation), n_words, and order_key in [0, 1): sorted by it, sources interleave at their weights all along.
    """
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    frame = docs.drop("epoch", "block", "n_words", "order_key") if extras else docs
    sizes = cut(docs.select("source", n_words.alias("n")).groupBy("source").agg(F.sum("n").cast("double").alias("words")))
    bucket = F.floor(F.log2("words") * 4096).alias("bucket")
    full = sizes.filter("words > 0")
    found = full.groupBy(bucket).agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()  # 64 octaves at most
    names = {k: fresh("mix_" + k, frame) for k in ("source", "whole", "part", "epochs", "blocks", "stop", "epoch")}
    if found:
        words, sources = [r["words"] / r["n"] for r in found], [float(r["n"]) for r in found]
        total = budget if budget is not None else sum(r["words"] for r in found)
        a = exponent_for(words, total, entropy, repeats, sources)
        top = max(words)
        norm = sum((w / top) ** a * n for w, n in zip(words, sources, strict=True))
        e = F.pow(F.col("words") / top, F.lit(a)) / norm * total / F.col("words")
    else:
        e = F.lit(1.0)
    epochs = F.when(F.col("words") > 0, e).otherwise(F.lit(1.0))
    table = sizes.select(F.col("source").alias("mix_source"), epochs.alias("epochs"), "words")
    table = table.select(
        "mix_source", F.floor("epochs").cast("int").alias("whole"), ((F.col("epochs") - F.floor("epochs")) * F.col("words")).alias("part"), "epochs",
        F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)).cast("int").alias("blocks"),
    )
    few = sizes.count() <= broadcast_sources
    small = F.broadcast if few else lambda x: x

    # the hash at which each source's part of an epoch ends
    rows = cut(
        docs.select("doc_id", "text", "source").join(small(table), F.col("source").eqNullSafe(F.col("mix_source"))).filter("part > 0").select(
            "mix_source", "part", _hash(F.col("whole")).alias("u"), F.floor(_share(_hash(F.col("whole"))) * F.col("blocks")).alias("block"), n_words.alias("n")
        )
    )
    along = Window.partitionBy("mix_source").orderBy("block")
    sums = rows.groupBy("mix_source", "part", "block").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ends = sums.filter("upto > part").groupBy("mix_source").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    ends = ends.select(F.col("mix_source").alias("end_source"), F.col("end.block").alias("end_block"), "end.before")
    inside = rows.join(small(ends), F.col("mix_source").eqNullSafe(F.col("end_source")) & (F.col("block") == F.col("end_block")))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("mix_source").orderBy("u").rangeBetween(Window.unboundedPreceding, 0)))
    stops = inside.filter("upto > part").groupBy(F.col("mix_source").alias("stop_source")).agg(F.min("u").alias("stop"))
    table = table.join(cut(stops), F.col("mix_source").eqNullSafe(F.col("stop_source")), "left").withColumn("stop", F.coalesce("stop", F.lit(TOP)))
    table = cut(table.select(F.col("mix_source").alias(names["source"]), *[F.col(k).alias(names[k]) for k in ("whole", "part", "epochs", "blocks", "stop")]))

    epoch = F.col(names["epoch"])
    taken = frame.join(small(table), frame["source"].eqNullSafe(F.col(names["source"])))
    taken = taken.withColumn(names["epoch"], F.explode(F.sequence(F.lit(0), F.col(names["whole"]))))
    taken = taken.filter((epoch < F.col(names["whole"])) | (F.col(names["part"]) > 0) & (_hash(epoch) < F.col(names["stop"])))
    if not extras:
        return taken.select(*frame.columns)
    at = _share(_hash(epoch))
    return taken.select(
        *frame.columns, epoch.alias("epoch"), F.floor(at * F.col(names["blocks"])).cast("int").alias("block"), n_words.alias("n_words"),
        ((epoch + at) / F.greatest(F.col(names["epochs"]), F.lit(1e-9))).alias("order_key"),
    )
