"""The result cache against a plain dictionary with the same rules."""

import datetime as dt
import random

from skarn.operators.cache import ResultCache

SCHEMA = "fingerprint string, query string, filters string"


def test_log(spark, tmp_path):
    rnd = random.Random(4)
    now, held, n = dt.datetime(2026, 1, 1), {}, 0
    cache = ResultCache(spark, str(tmp_path / "c"), hours=2.5, most=12)
    for turn in range(7):
        now += dt.timedelta(hours=1)
        print_ = "f1" if turn < 5 else "f2"
        asked = {(print_, f"q{min(rnd.randrange(20), rnd.randrange(20))}", rnd.choice(["", "python"])) for _ in range(9)}
        df = spark.createDataFrame(sorted(asked), SCHEMA)
        want = {k for k in asked if k in held and now - held[k][1] < dt.timedelta(hours=2.5)}
        hits = {tuple(r)[:3]: r["results"] for r in cache.hits(df.union(df), now).collect()}
        assert hits == {k: held[k][0] for k in want}
        misses = sorted(tuple(r) for r in cache.misses(df.union(df), now).collect())
        assert misses == sorted(asked - want)
        for k in misses:
            held[k] = (f"{k}@{turn}", now, held[k][2] if k in held else n)
        n += 1
        for k in sorted(held, key=lambda k: (held[k][2], k))[: max(0, len(held) - 12)]:
            del held[k]
        results = spark.createDataFrame([(*k, f"{k}@{turn}") for k in misses], f"{SCHEMA}, results string")
        cache = cache.put(results, now)
        if turn == 3:
            cache = cache.compact()
            assert len(cache.batches) == 1
            n = cache.batches[0] + 1
        assert {tuple(r)[:3]: r["results"] for r in cache.entries().collect()} == {k: v[0] for k, v in held.items()}
    assert len(held) == 12


def test_unfinished(spark, tmp_path):
    """A batch without its mark of success is not read, and is written anew."""
    path = str(tmp_path / "c")
    one = ResultCache(spark, path).put(spark.createDataFrame([("f", "q", "", "r")], f"{SCHEMA}, results string"), dt.datetime(2026, 1, 1))
    (tmp_path / "c" / "batch-1").mkdir()
    (tmp_path / "c" / "batch-1" / "part-0.parquet").write_bytes(b"half")
    again = ResultCache(spark, path)
    assert again.batches == one.batches == [0]
    two = again.put(spark.createDataFrame([("f", "q2", "", "r2")], f"{SCHEMA}, results string"), dt.datetime(2026, 1, 1))
    assert sorted(r["query"] for r in two.entries().collect()) == ["q", "q2"]
