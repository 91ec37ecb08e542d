"""Job states by the stream: timers without events, late ends, restarts, replayed batches."""

import datetime as dt

from pyspark.sql import functions as F

from skarn.streaming import jobs as J

SCHEMA = "job_id long, ts timestamp, kind string, timeout_ms long, exit_code int"
START = dt.datetime(2026, 1, 1)


def test_states(spark, tmp_path):
    at = str(tmp_path)
    sec = lambda s: START + dt.timedelta(seconds=s)

    def arrive(rows):
        spark.createDataFrame([(j, sec(s), k, t, c) for j, s, k, t, c in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/log")
        J.drain(stream, at)
        return {r["job_id"]: (r["state"], r["at"] // 1000 - int(START.replace(tzinfo=dt.timezone.utc).timestamp())) for r in J.latest(spark, at).collect()}

    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/log")
    stream = J.transitions(spark.readStream.schema(SCHEMA).parquet(f"{at}/log"))
    now = arrive([(1, 0, "created", None, None), (1, 1, "started", 60_000, None), (2, 0, "created", None, None), (3, 0, "created", None, None), (3, 2, "started", 60_000, None), (4, 5, "started", 1000, None), (4, 20, "exited", None, 0), (6, 3, "cancelled", None, None)])
    assert now == {1: ("running", 1), 2: ("pending", 0), 3: ("running", 2), 4: ("timeout", 6), 6: ("cancelled", 3)}
    # 3 ends in time, 6 was cancelled before it starts, 5 fails
    now = arrive([(3, 40, "exited", None, 0), (6, 30, "started", 1000, None), (5, 30, "started", 60_000, None), (5, 31, "exited", None, 2)])
    assert now == {1: ("running", 1), 2: ("pending", 0), 3: ("completed", 40), 4: ("timeout", 6), 5: ("failed", 31), 6: ("cancelled", 3)}
    # only another job's event, two minutes on: 1 has no further event and times out at its deadline
    now = arrive([(7, 180, "created", None, None)])
    assert now[1] == ("timeout", 61) and now[7] == ("pending", 180) and now[2] == ("pending", 0)
    # what comes after an end changes nothing
    now = arrive([(1, 200, "exited", None, 0), (3, 201, "cancelled", None, None), (2, 202, "cancelled", None, None)])
    assert now[1] == ("timeout", 61) and now[3] == ("completed", 40) and now[2] == ("cancelled", 202)
    # nothing new: a further run gives no rows
    before = J.latest(spark, at).count()
    J.drain(stream, at)
    assert J.latest(spark, at).count() == before


def test_many_jobs(spark, tmp_path):
    """Jobs of a batch share its cost: 150,000 of them, which one call of Python for each did not finish in 70 s. Late events and replays change nothing."""
    import time

    at, n = str(tmp_path), 150_000
    ts = lambda ms: F.timestamp_millis(F.lit(1_767_225_600_000) + ms)
    job = lambda kind, ms, timeout=None, code=None: spark.range(n).select(F.col("id").alias("job_id"), ts(ms).alias("ts"), F.lit(kind).alias("kind"), F.lit(timeout).cast("long").alias("timeout_ms"), F.lit(code).cast("int").alias("exit_code"))
    job("created", F.col("id") * 0).union(job("started", F.col("id") * 0 + 1000, 10_000)).write.parquet(f"{at}/log")
    stream = J.transitions(spark.readStream.schema(SCHEMA).parquet(f"{at}/log"))
    begun = time.monotonic()
    J.drain(stream, at)
    assert {tuple(r) for r in J.latest(spark, at).groupBy("state").count().collect()} == {("running", n)}
    # every second ends in time; an event at the watermark is late; the rest time out
    job("exited", F.col("id") * 0 + 5000, code=0).filter("job_id % 2 = 0").union(job("cancelled", F.col("id") * 0 + 1000).filter("job_id % 2 = 1")).union(job("created", F.col("id") * 0 + 60_000).filter("job_id = 0")).write.mode("append").parquet(f"{at}/log")
    J.drain(stream, at)
    got = J.latest(spark, at).groupBy("state", F.col("job_id") % 2, F.col("at") - 1_767_225_600_000).count().collect()
    assert {tuple(r) for r in got} == {("completed", 0, 5000, n // 2), ("timeout", 1, 11_000, n // 2)}
    assert time.monotonic() - begun < 70
