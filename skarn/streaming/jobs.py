"""The life of jobs as a stream: states by job, with timers that end what runs too long without any further event.

Each batch is one job of expressions, whatever the number of jobs in it: its events and the states before it meet by job and are folded in
order of time; then all deadlines that the watermark has passed are over. States lie below `state/number=N`, which batch N + 1 reads,
and changes of state below `batches/number=N`, so a batch that is run again replaces what it gave before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import bind
from skarn.operators.jobs import FINAL

#: Event time for which an ended job is remembered, so that late events of it are known as such; its state goes then.
REMEMBERED_MS = 3_600_000
OUT = "job_id long, state string, at long"
KEPT = "job_id long, state string, until long, changes array<struct<state string, at long>>"


def transitions(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The stream that drain folds. events: job_id, ts, kind (created, started, exited, cancelled), timeout_ms, exit_code.

    The watermark is the latest time seen in earlier batches less `late`; what is not after it comes too late. A running job times out when the
    watermark passes its deadline, or by an event after it.
    """
    turn = F.when(F.col("kind") == "created", 0).when(F.col("kind") == "started", 1).when(F.col("kind") == "exited", 2).otherwise(3)
    mark = F.unix_millis(F.col("ts") - F.expr(f"interval {late}"))
    e = F.struct(F.unix_millis("ts").alias("ms"), turn.alias("turn"), "kind", F.coalesce("timeout_ms", F.lit(0).cast("long")).alias("timeout_ms"), F.coalesce("exit_code", F.lit(0)).alias("exit_code"))
    return events.select("job_id", "ts", mark.alias("mark"), e.alias("e"))


def _after(job: Column, e: Column) -> Column:
    """A job's state, until and changes after one more event. The first final state stays."""

    def told(j: Column, to: Column) -> Column:
        until = F.when(to == "running", e["ms"] + e["timeout_ms"]).when(to.isin(*FINAL), e["ms"] + REMEMBERED_MS).otherwise(j["until"])
        return F.when(to.isNull(), j).otherwise(F.struct(to.alias("state"), until.alias("until"), F.concat(j["changes"], F.array(F.struct(to.alias("state"), e["ms"].alias("at")))).alias("changes")))

    def moved(j: Column) -> Column:
        to = F.when(j["state"].isin(*FINAL), F.lit(None)).when(e["kind"] == "created", F.when(j["state"] == "", "pending")).when(e["kind"] == "started", F.when(j["state"].isin("", "pending"), "running"))
        return bind(to.when(e["kind"] == "cancelled", "cancelled").when(e["kind"] == "exited", F.when(e["exit_code"] == 0, "completed").otherwise("failed")), lambda to: told(j, to))

    return bind(_timed(job, (job["state"] == "running") & (e["ms"] > job["until"])), moved)  # its time was over before this event


def _timed(job: Column, over: Column) -> Column:
    ended = F.concat(job["changes"], F.array(F.struct(F.lit("timeout").alias("state"), job["until"].alias("at"))))
    return F.when(over, F.struct(F.lit("timeout").alias("state"), (job["until"] + REMEMBERED_MS).alias("until"), ended.alias("changes"))).otherwise(job)


def folded(batch: DataFrame, before: DataFrame, mark: int) -> DataFrame:
    """KEPT after a batch of transitions() and the states before it, at a watermark that includes the batch. Ended jobs go when they are no longer remembered, once their changes are told."""
    known = before.select("job_id", F.struct("state", "until").alias("was"), F.lit(None).cast(batch.schema["e"].dataType).alias("e"))
    rows = known.unionByName(batch.select("job_id", F.lit(None).cast("struct<state:string,until:bigint>").alias("was"), "e"))
    jobs = rows.groupBy("job_id").agg(F.max("was").alias("was"), F.array_sort(F.collect_list("e")).alias("events"))  # of one job: a handful
    start = F.struct(F.coalesce("was.state", F.lit("")).alias("state"), F.coalesce("was.until", F.lit(0).cast("long")).alias("until"), F.array().cast("array<struct<state:string,at:bigint>>").alias("changes"))
    last = lambda j: _timed(j, (j["state"] == "running") & (j["until"] < mark))
    x = jobs.select("job_id", F.aggregate("events", start, _after, last).alias("j")).select("job_id", "j.*").filter("state <> ''")
    return x.filter(~F.col("state").isin(*FINAL) | (F.col("until") >= mark) | (F.size("changes") > 0))


def drain(stream: DataFrame, at: str) -> None:
    """Runs a stream of transitions over all input there is."""

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = spark.read.schema("mark long").parquet(f"{at}/marks/number={number - 1}").first()[0] if number else None
        if last is not None:
            batch = batch.filter(F.col("ts") > F.timestamp_millis(F.lit(last)))
        seen = batch.agg(F.max("mark")).first()[0]
        mark = max((m for m in (last, seen) if m is not None), default=None)
        before = spark.read.schema(KEPT).parquet(f"{at}/state/number={number - 1}") if number else spark.range(0).select(F.from_json(F.lit("{}"), KEPT).alias("k")).select("k.*")
        folded(batch, before, -(1 << 62) if mark is None else mark).write.mode("overwrite").parquet(f"{at}/state/number={number}")
        now = spark.read.schema(KEPT).parquet(f"{at}/state/number={number}")
        now.select("job_id", F.explode("changes").alias("c")).select("job_id", "c.state", "c.at").write.mode("overwrite").parquet(f"{at}/batches/number={number}")
        spark.range(0, 1, 1, 1).select(F.lit(mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{at}/marks/number={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/state/number={number - 2}")  # the last batch may be run again, the one before not
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    stream.writeStream.outputMode("append").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def latest(spark, at: str) -> DataFrame:
    """job_id, state, at of each job after the batches so far."""
    every = spark.read.schema(OUT).parquet(f"{at}/batches")
    rank = F.when(F.col("state") == "pending", 0).when(F.col("state") == "running", 1).otherwise(2)
    return every.groupBy("job_id").agg(F.max_by("state", F.struct("at", rank)).alias("state"), F.max("at").alias("at"))
