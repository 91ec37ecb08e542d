"""File round trips and streams."""

import json

from pyspark.sql import functions as F

from skarn.sources import files
from skarn.streaming import streams


def test_registry(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"version": "1.0.0", "tools": [{"id": "a", "category": "x", "triggers": ["t"]}, {"id": "b", "category": ["y", "z"]}]}))
    t = files.registry(spark, str(p))
    assert [(r["id"], r["category"], r["ord"]) for r in t.orderBy("ord").collect()] == [("a", ["x"], 0), ("b", ["y", "z"], 1)]
    files.save_registry(t, str(tmp_path / "out"))
    assert files.registry(spark, str(tmp_path / "out")).count() == 2
    assert files.registry(spark, str(tmp_path / "missing.json")).count() == 0


def test_traces(spark, tmp_path):
    p = tmp_path / "t"
    runs = spark.createDataFrame([("x", [], 0, 5, None), ("x", ["secret"], 1, 5, "e")], "toolId string, args array<string>, exitCode int, duration long, error string")
    files.append_traces(runs, str(p))
    (p / "bad.json").write_text("\n{broken\n")
    got = files.traces(spark, str(p))
    assert sorted((r["args"], r["success"]) for r in got.collect()) == [("", True), ("[REDACTED]", False)]


def test_snapshots(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"snapshots": [{"week": "2026-W01", "repos": {"a/b": 1}}, {"week": "2026-W02", "repos": {"a/b": 2, "c/d": 3}}]}))
    (tmp_path / "f.json").write_text(json.dumps({"a/b": 7}))
    assert files.snapshots(spark, str(tmp_path / "s.json")).count() == 3
    assert [tuple(r) for r in files.flat_snapshot(spark, str(tmp_path / "f.json")).collect()] == [("a/b", 7)]


def test_skill_files_and_lines(spark, tmp_path):
    for folder, name in (("a", "SKILL.md"), ("a", "README.md"), ("b", "README.md")):
        (tmp_path / "m" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / folder / name).write_text(name)
    assert sorted(r["content"] for r in files.skill_files(spark, str(tmp_path / "m")).collect()) == ["README.md", "SKILL.md"]
    (tmp_path / "l.txt").write_text("one\ntwo")
    assert [tuple(r) for r in files.lines(spark, str(tmp_path / "l.txt")).orderBy("pos").collect()] == [(0, "one"), (1, "two")]


def test_fresh(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.fresh(spark, str(tmp_path / "x"), build).count() == 3
    assert len(built) == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "tool_id string, success boolean")
    rows.write.parquet(str(tmp_path / "in"))
    s = streams.running_stats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, streams.running_stats(rows).collect()))


def test_stream_join(spark, tmp_path):
    e = spark.createDataFrame([("search", "q", "2024-01-01 00:00:00", 1), ("click", "q", "2024-01-01 00:00:30", 2), ("click", "q", "2024-01-01 00:00:31", 3)], "type string, query string, ts string, seq long").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    s = streams.successful_searches(read().filter("type = 'search'"), read().filter("type = 'click'"))
    q = s.writeStream.format("memory").queryName("joined").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("joined").count() == 1


def test_live_repositories(spark, tmp_path):
    from skarn.operators.trending import first_seen
    from skarn.sources.connectors import live_repositories

    item = lambda n, stars, fork=False: {"full_name": n, "name": n.split("/")[1], "owner": {"login": n.split("/")[0]}, "stargazers_count": stars, "fork": fork, "topics": ["t"]}
    (tmp_path / "a.json").write_text(json.dumps({"items": [item("a/b", 5), item("f/f", 1, True)]}))
    (tmp_path / "b.json").write_text(json.dumps({"items": [item("a/b", 9), item("c/d", 2)]}))
    (tmp_path / "c.json").write_text("{broken")
    live = live_repositories(spark, [str(tmp_path / f"{x}.json") for x in "abcx"])
    assert sorted((r["full_name"], r["stars"]) for r in first_seen(live).collect()) == [("a/b", 5), ("c/d", 2)]


def test_writers(spark, tmp_path):
    repos = spark.createDataFrame([("a/b", 5), ("c/d", 7)], "full_name string, stars long")
    files.save_flat_snapshot(repos, str(tmp_path / "snap"))
    assert sorted(map(tuple, files.flat_snapshot(spark, str(tmp_path / "snap")).collect())) == [("a/b", 5), ("c/d", 7)]
    events = spark.createDataFrame([(1, "search", "q"), (2, "click", "q")], "timestamp long, type string, query string")
    files.append_behaviour(events, str(tmp_path / "log"))
    files.append_behaviour(events, str(tmp_path / "log"))
    assert files.behaviour(spark, str(tmp_path / "log")).count() == 4
    links = spark.createDataFrame([("sql", "db", 2), ("sql", "資料庫", 1), ('q"x', "y", 1)], "term string, synonym string, pos int")
    files.save_synonyms(links, str(tmp_path / "syn"))
    said = "".join(r["value"] for r in spark.read.text(str(tmp_path / "syn")).collect())
    assert json.loads("{" + said.rstrip(",") + "}") == {"sql": ["資料庫", "db"], 'q"x': ["y"]}
    files.save_graph(spark.createDataFrame([("root",)], "id string"), spark.createDataFrame([("root", "x")], "source string, target string"), str(tmp_path / "g"))
    (doc,) = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert doc == {"nodes": [{"id": "root"}], "edges": [{"source": "root", "target": "x"}]}


def test_snapshot_of_week(spark, tmp_path):
    from skarn.operators import trending

    p = tmp_path / "s.json"
    p.write_text(json.dumps({"snapshots": [{"week": "2026-W01", "repos": {"a/b": 1}}, {"week": "2026-W01", "repos": {"a/b": 9, "c/d": 2}}]}))
    s = files.snapshots(spark, str(p))
    assert [tuple(r) for r in trending.of_week(s, "2026-W01").collect()] == [("a/b", 1)]  # the first one of the week
    (tmp_path / "bad.json").write_text("{not json")
    assert files.snapshots(spark, str(tmp_path / "bad.json")).count() == 0
    assert files.registry(spark, str(tmp_path / "bad.json")).count() == 0


def test_windows_and_bursts(spark):
    """The streaming forms on tables: ISO weeks, bursts, ages."""
    t = lambda s: F.to_timestamp(F.lit(s))
    e = spark.createDataFrame([(0, "a"), (1, "ab"), (5, "abc")], "s int, query string").select(F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), F.lit("u").alias("user"), "query")
    assert sorted((r["query"], r["n"]) for r in streams.debounced(e, "2 seconds").collect()) == [("ab", 2), ("abc", 1)]
    days = spark.createDataFrame([("2026-08-02",), ("2026-08-03",), ("2026-08-09",)], "d string").select(F.to_timestamp("d").alias("ts"))
    assert sorted((str(r["week_start"])[:10], r["n"]) for r in streams.weekly(days).collect()) == [("2026-07-27", 1), ("2026-08-03", 2)]
    old = spark.createDataFrame([(1,), (2,)], "k int").select("k", F.when(F.col("k") == 1, t("2026-01-01 00:00:00")).otherwise(t("2026-01-01 00:10:00")).alias("timestamp"))
    assert [r["k"] for r in streams.unexpired(old, "2026-01-01 00:10:30", 60).collect()] == [2]


def test_weekly_stream(spark, tmp_path):
    """Running and closed weeks; a late event of a closed week is dropped; a batch that is run again changes nothing."""
    import datetime as dt
    import os

    from skarn.streaming import streams

    at = str(tmp_path)
    day = lambda n, k=1: [(dt.datetime(2026, 1, 5) + dt.timedelta(days=n, hours=i),) for i in range(k)]
    spark.createDataFrame([], "ts timestamp").write.parquet(f"{at}/log")
    weeks = streams.weekly(spark.readStream.schema("ts timestamp").parquet(f"{at}/log"))

    def arrive(rows):
        spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.mode("append").parquet(f"{at}/log")
        return said()

    def said():
        out = []
        for mode in ("update", "append"):
            streams.into_batches(weeks, f"{at}/{mode}", mode)
            n = streams.newest(spark, f"{at}/{mode}", "week_start timestamp, n long", "week_start")
            out.append({(r["week_start"] - dt.datetime(2026, 1, 5)).days // 7: r["n"] for r in n.collect()})
        return out

    assert arrive(day(0, 3) + day(6, 2)) == [{0: 5}, {}]
    assert arrive(day(7, 4)) == [{0: 5, 1: 4}, {}]  # the week is over, but a day of grace is not
    assert arrive(day(2, 1) + day(9, 1)) == [{0: 6, 1: 5}, {0: 6}]
    assert arrive(day(3, 5) + day(10, 1)) == [{0: 6, 1: 6}, {0: 6}]  # too late
    for mode in ("update", "append"):
        done = f"{at}/{mode}/progress/commits"
        last = max(int(f) for f in os.listdir(done) if f.isdigit())
        os.remove(f"{done}/{last}")
        os.remove(f"{done}/.{last}.crc")
    assert said() == [{0: 6, 1: 6}, {0: 6}]
