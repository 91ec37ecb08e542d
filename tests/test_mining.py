"""Kept counts of terms and pairs against a pass over all tools, through changes that cross the frequency limit."""

import random

from skarn.operators import synonyms
from skarn.operators.mining import MinedTerms


def test_increments(spark, tmp_path):
    rnd = random.Random(3)
    words = ["簡報", "漏洞", "影片", "測試", "Slides", "ppt", "pentest", "video", "mcp", "  "]
    tool = lambda: rnd.sample(words, 9 if turn in (1, 2) else rnd.randint(0, 2))
    schema = "id string, triggers array<string>"
    held, kept = {}, MinedTerms(spark, str(tmp_path / "m"))
    crossed = set()
    for turn in range(5):
        put = {f"t{rnd.randrange(12)}": tool() for _ in range(6)}
        gone = rnd.sample(sorted(held), min(len(held), 2))
        kept = kept.put(spark.createDataFrame(list(put.items()), schema))
        held |= put
        if turn % 2:
            kept = kept.remove(spark.createDataFrame([(g, None) for g in gone], schema))
            held = {k: v for k, v in held.items() if k not in gone}
        now = spark.createDataFrame(list(held.items()), schema)
        assert sorted(map(tuple, kept.frequencies().collect())) == sorted(map(tuple, synonyms.frequencies(now).collect()))
        assert sorted(map(tuple, kept.pairs().collect())) == sorted(map(tuple, synonyms.pairs(now).collect()))
        crossed.add(tuple(sorted(r["term"] for r in kept.frequencies().collect() if r["df"] > synonyms.COMMON)))
    assert len(crossed) > 1
    assert sorted(map(tuple, kept.mine().collect())) == sorted(map(tuple, synonyms.mine(now).collect()))


def test_pairs_are_summed_once(spark, tmp_path):
    """What is mined comes from pairs that were summed once for the state, not from the counts again at each use; a change sums anew."""
    schema = "id string, triggers array<string>"
    kept = MinedTerms(spark, str(tmp_path / "m")).put(spark.createDataFrame([("a", ["簡報", "slides"]), ("b", ["漏洞", "pentest"])], schema))
    mined = kept.mine(synonyms.seed_links(spark), synonyms.alias_table(spark))
    assert not [f for f in mined.inputFiles() if "/change-" in f or "/tools-" in f]
    plan = mined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") < 6 and "LeftOuter" not in plan
    kept = kept.remove(spark.createDataFrame([("b", None)], schema))
    assert [tuple(r) for r in kept.pairs().collect()] == [("簡報", "slides", 1)]
    assert kept.tools().collect() == [("a", ["簡報", "slides"])]
    assert MinedTerms(spark, str(tmp_path / "none")).mine().collect() == []
