"""Plumbing shared by the training-data operators.

Everything that crosses a job boundary goes through :func:`cut`, which writes a table into the folder
named by ``spark.checkpoint.dir``; a lost executor then costs the tasks it ran and nothing else.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word rule shared by the operators: maximal runs of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Words remembered by one Python worker before it starts over; bounds what an idle worker holds.
MEMO = 200_000
MASK = (1 << 64) - 1

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="skarn-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: later jobs start from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skarn-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.__dict__["cut_path"] = path
    return again


def drop(df: DataFrame) -> None:
    """Deletes the table of a frame that cut() gave, once nothing is derived from it any more."""
    path = df.__dict__.get("cut_path")
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts stay small: at most so many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes, '' for null; Python gets it without decoding."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def word_memo() -> WordHash:
    """One memory for a Python worker: what a task has hashed serves the worker's next task."""
    return WordHash()


def hash_words(lists: list[list[bytes]], memo: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes, one after the other, and the place where each list begins (and the end)."""
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = np.fromiter(map(memo.__getitem__, itertools.chain.from_iterable(lists)), np.uint64, int(ends[-1]))
    return flat, ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers drawn from a seed."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hash(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive word hashes; none if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = multipliers(width, seed)
    out = words[:n] * m[0]
    for k in range(1, width):
        out += words[k : k + n] * m[k]
    return mix64(out)


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Groups of rows with one value of the (never null) long column `key`, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for s, e in itertools.pairwise(at):
            if held and k[s] == now:
                held.append(b.slice(s, e - s))
            else:
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now = [b.slice(s, e - s)], int(k[s])
    if held:
        yield now, pa.Table.from_batches(held)


def by_key(df: DataFrame, key: str, fn, schema: str, *then: str) -> DataFrame:
    """fn(iterator of batches sorted by `key` and `then`, a key's rows never in two tasks) -> batches.

    Cheaper than one Python call for each group where most groups are tiny.
    """
    return df.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key, *then).mapInArrow(fn, schema)


def in_blocks(rows: DataFrame, size: int, weight: str | None = None, need: str | None = None) -> DataFrame:
    """Deals rows (key, id, ...) into comparison tasks of at most about 2 * size rows.

    A key with more than `size` rows is split by a hash of id into blocks, and every pair of blocks (and each
    block alone) becomes a task of its own, so no task holds a whole hot key. Adds `task` (long), `left` and
    `right` (the two block numbers), `block` and `whole` (the key is not split). Where rows hold several things each, as many as the column
    `weight` says, size counts those. need: a boolean column; keys with one row, or with none where it is true, go.

    Keys are counted by partial sums; only the hot ones, at most rows / size, are joined back, and by a broadcast
    where their written table is small enough for Spark's own threshold. So rows move once, to their tasks. Rows that have a
    column n_key, the weight of their key (anything up to `size` if it is not split), are not counted.
    """
    if "n_key" in rows.columns:
        return _in_tasks(rows.withColumn("n_blocks", F.expr(f"cast(greatest(1L, (n_key + {size - 1}) div {size}) as int)")).drop("n_key"))
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_key") if weight is None else F.sum(weight).alias("n_key"), *([F.max(need).alias("ok_key")] if need else []))
    if need:
        rows = rows.join(n.filter("n_key > 1 and ok_key").select("key"), "key", "left_semi")
    hot = cut(n.filter(F.col("n_key") > size).select("key", F.expr(f"cast((n_key + {size - 1}) div {size} as int)").alias("n_blocks")))
    return _in_tasks(rows.join(hot, "key", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))))


def _in_tasks(rows: DataFrame) -> DataFrame:
    """in_blocks for rows that know the number of their key's blocks."""
    dealt = rows.withColumn("block", F.expr("cast(pmod(xxhash64(id, 17L), n_blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
    return (
        dealt.withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
        .withColumn("task", F.xxhash64("key", "left", "right"))
        .withColumn("whole", F.col("n_blocks") == 1)
        .drop("n_blocks", "other")
    )


def spread_join(rows: DataFrame, one: DataFrame, key: str, size: int = 5000, how: str = "inner") -> DataFrame:
    """rows joined with `one` (a row for each value of `key`, which is never null), hot values dealt over several tasks.

    Values with more than `size` rows, counted by partial sums, get a salt for each `size` rows; `one` repeats its row for
    each salt of such a value.
    """
    hot = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_salts")).filter(F.col("n_salts") > size).select(key, F.expr(f"cast((n_salts + {size - 1}) div {size} as int)").alias("n_salts")))
    salted = rows.join(hot, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("n_salts")).cast("int"), F.lit(0))).drop("n_salts")
    every = one.join(hot, key, "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(n_salts, 1) - 1)"))).drop("n_salts")
    return salted.join(every, [key, "salt"], how).drop("salt")


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _local_forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task, as the stars of their components."""
    parts = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, where = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = where.reshape(2, -1)
    up = linked_up(np.arange(len(nodes)), a, b)
    out = np.flatnonzero(up != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[up[out]])], names=["a", "b"])


def linked_up(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's group, after links a-b join the groups that `up` says."""
    while len(a):
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while (up[up] != up).any():
            up = up[up]
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    return up


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id in edges (a, b), root being the smallest id that links reach.

    Edges of a task first shrink to stars. Then alternating large-star and small-star steps; minima are combined before
    the shuffle, and each round is cut, so the plan stays short however long the chains are. Self edges only add their id.
    Raises if it has not settled after `rounds`.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_local_forests, "a long, b long").distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        near = star.join(low, "a")
        last, e = e, cut(near.select("a", F.col("m").alias("b")).union(near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        drop(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
