"""The nine steps: a run stopped after any of them and run again ends as one that was never stopped."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skarn.operators.weekly_run import STEPS, WeeklyRun

WEEK, PREVIOUS, BEFORE = "2026-W33", "2026-W32", "2026-W31"


def inputs(spark):
    registry = spark.createDataFrame([("alpha", "o/alpha", "https://h/o/alpha")], "id string, full_name string, url string")
    rows = [(f"o/r{i}", 1000 + 17 * i, i % 2, i, False, dt.date(2026, 8, 1), f"https://h/o/r{i}", "owner", f"r{i % 3}") for i in range(6)]
    rows += [rows[0][:2] + (3, 9) + rows[0][4:], ("o/fork", 5000, 0, 7, True, dt.date(2026, 8, 1), "https://h/o/fork", "owner", "fork"), ("o/new", 800, 1, 8, False, dt.date(2026, 8, 10), "https://h/o/new", "owner", "new")]
    live = spark.createDataFrame(rows, "full_name string, stars long, query_idx int, item_idx int, fork boolean, created_at date, url string, owner string, bare string")
    return registry, live


def prepare(spark, root):
    old = [(f"o/r{i}", 900 + 10 * i, BEFORE) for i in range(5)] + [(f"o/r{i}", 950 + 14 * i, PREVIOUS) for i in range(6)] + [("o/gone", 70, PREVIOUS)]
    spark.createDataFrame(old, "full_name string, stars long, week string").write.partitionBy("week").parquet(f"{root}/snapshots")
    return WeeklyRun(spark, root, WEEK)


def state(run):
    out = {"snapshots": sorted(map(tuple, run.snapshots().select("week", "full_name", "stars").collect())), "additions": sorted(map(tuple, run.additions().select("week", "rank", "id", "url", "delta").collect())), "done": run.done()}
    return out


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("whole"))
    run = prepare(spark, root)
    tables = run.run(*inputs(spark), PREVIOUS, BEFORE, "2026-08-16")
    return state(run), {k: sorted(map(tuple, t.collect())) for k, t in tables.items()}


def test_result(whole):
    s, t = whole
    # the week before against the one before that: by growth, only what both have
    assert t["last_week"] == [(k + 1, f"o/r{i}", 950 + 14 * i, 50 + 4 * i) for k, i in enumerate([4, 3, 2, 1, 0])]
    assert [(r[1], r[3]) for r in t["week_to_date"]] == [("o/new", 800)] + [(f"o/r{i}", 50 + 3 * i) for i in (5, 4, 3, 2, 1, 0)]
    assert {r[1] for r in t["additions"]} == {"r1", "r0", "r2", "r1-owner", "r0-owner"}
    now = {n: c for w, n, c in s["snapshots"] if w == WEEK}
    assert now == {**{f"o/r{i}": 1000 + 17 * i for i in range(6)}, "o/new": 800, "o/gone": 70}
    assert s["done"] and sum(w != WEEK for w, _, _ in s["snapshots"]) == 12 and len(s["additions"]) == 5
    assert {r[0] for r in t["pool"]} == {"o/alpha", "o/gone", *(f"o/r{i}" for i in range(6))}


@pytest.mark.parametrize("stop", STEPS)
def test_stopped(spark, tmp_path, whole, stop):
    """Stopped after a step, the last runs on; other weeks' partitions are as they were and the manifest comes last."""
    run = prepare(spark, str(tmp_path / "root"))

    def fail(step):
        if step == stop:
            raise InterruptedError(step)

    with pytest.raises(InterruptedError):
        run.run(*inputs(spark), PREVIOUS, BEFORE, "2026-08-16", fail)
    half = state(run)
    assert half["done"] == (stop == "manifest")
    assert [x for x in half["snapshots"] if x[0] != WEEK] == [x for x in whole[0]["snapshots"] if x[0] != WEEK]
    # what is seen live changes before the second run: steps that are done keep what they saw
    registry, live = inputs(spark)
    if STEPS.index(stop) >= STEPS.index("live"):
        live = live.withColumn("stars", F.col("stars") + 1)
    run = WeeklyRun(spark, run.root, WEEK)
    run.run(registry, live, PREVIOUS, BEFORE, "2026-08-16")
    assert state(run) == whole[0]
