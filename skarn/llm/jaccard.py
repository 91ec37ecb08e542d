"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of `words` consecutive words (all its words if it has fewer). Documents with the
same set form one class and are compared once. Each set has a signature of `coords` min-hashed shingles. A run
starts at a root; a node passes a set on to the children named by one or two sampled coordinates and the
shingle that the set has there, 1/threshold of them on average, so that sets share a child with a chance of about
their similarity. A node with at most `small` sets is compared by brute force; a larger one splits again, up to
`depth` times, and is then compared in blocks. Runs are independent; their number follows from the recall
asked for at the threshold.

Comparison has two steps: signatures rule out most pairs of a node (`slack` standard deviations below the
threshold); only sets that then still have a partner there fetch their text for the exact similarity. A pair is
judged only in the smallest node it shares, so link counts add up without listing pairs.

Defined results: null, empty and white-space texts have no shingles and link with nothing; rows that repeat, or
differ in white space only, are copies and link with each other; documents with a null doc_id take part and count
as links; a class of documents without any doc_id has a null class_id; a very long text is a set like any other, held by the tasks
that compare it. Other columns are ignored. Distinct sets are told apart by a 64-bit sum of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import MASK, Forest, WordHash, by_key, components, cut, fresh, hash_words, in_blocks, mix64, multipliers, runs, small_batches, spread_join, text_bytes, window_hash

SET = "row long, doc_id long, sid long, size long, sig binary"


def shingles(texts: list[bytes], words: int, memo: WordHash) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    lists = [t.split() for t in texts]
    flat, ends = hash_words(lists, memo)
    every = window_hash(flat, words, 303)
    out = []
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if e - s >= words:
            out.append(np.unique(every[s : e - words + 1]))
        else:
            out.append(window_hash(flat[s:e], e - s, 404 + e - s) if e > s else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """One row of `coords` 32-bit min-hashes for each (non-empty) set."""
    if not sets:
        return np.zeros((0, coords), np.uint32)
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    mul, add = multipliers(coords, 11), multipliers(coords, 12)
    low = np.empty((coords, len(sets)), np.uint64)
    for c in range(coords):
        low[c] = np.minimum.reduceat(flat * mul[c] + add[c], begin)
    return (low.T >> np.uint64(32)).astype(np.uint32)


def _child(path: np.ndarray, sig: np.ndarray, which: int, coords: int) -> np.ndarray:
    """The child node of each (path, signature) by its first or second sampled coordinate."""
    c = (mix64(path + np.uint64(which * 7919)) % np.uint64(coords)).astype(np.int64)
    v = sig[np.arange(len(sig)), c].astype(np.uint64)
    return mix64(path * np.uint64(0x9E3779B97F4A7C15) + v + (c.astype(np.uint64) << np.uint64(32)))


def _children(path: np.ndarray, sig: np.ndarray, coords: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, nodes): each path samples one coordinate, and a second with the chance 1/threshold - 1."""
    second = np.flatnonzero((mix64(path ^ np.uint64(0x5DEECE66D)) >> np.uint64(11)).astype(float) / 2**53 < 1 / threshold - 1)
    return [(np.arange(len(path)), _child(path, sig, 0, coords)), (second, _child(path[second], sig[second], 1, coords))]


def runs_for(threshold: float, recall: float, depth: int) -> int:
    """How many runs reach the recall for a pair at the threshold whose nodes all split `depth` times."""
    one = threshold * (2 - 1 / threshold) + (1 - (1 - threshold) ** 2) * (1 / threshold - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one**depth)))


def _sigs(column: pa.ChunkedArray, coords: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coords)


def _owned(keys: list[list[int]], here: int) -> dict[int, np.ndarray]:
    """Nodes before this one -> the members that also lie there."""
    by: dict[int, list[int]] = {}
    for i, ks in enumerate(keys):
        for k in ks:
            if k >= here:
                break
            by.setdefault(k, []).append(i)
    return {k: np.array(v) for k, v in by.items()}


def members(
    docs: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    recall: float = 0.99,
    coords: int = 64,
    small: int = 128,
    depth: int = 3,
    slack: float = 4.5,
    block: int = 768,
) -> DataFrame:
    """For each row of docs: doc_id, row (a hash of doc_id and text), root (names its class; null without words), class_id, n_links."""
    spark = docs.sparkSession
    small_batches(spark)
    row = F.xxhash64("doc_id", "text").alias("row")
    need = threshold * coords - slack * math.sqrt(coords * threshold * (1 - threshold))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in batches:
            found = shingles(b.column("text").to_pylist(), words, memo)
            full = [s for s in found if len(s)]
            sig = iter(signatures(full, coords))
            sid = [int(mix64(s).sum(dtype=np.uint64) ^ np.uint64(len(s) * 0x9E3779B97F4A7C15 & MASK)) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"),
                    b.column("doc_id"),
                    pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in sid], pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([next(sig).tobytes() if len(s) else None for s in found], pa.binary()),
                ],
                names=["row", "doc_id", "sid", "size", "sig"],
            )

    every = cut(docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(sets, SET))
    # one row for each distinct set: copies add to its weight
    reps = cut(
        every.filter("sid is not null")
        .groupBy("sid")
        .agg(F.min("row").alias("row"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.first("sig").alias("sig"))
        .withColumnRenamed("sid", "id")
    )

    n_runs = runs_for(threshold, recall, depth)

    def roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _sigs(b.column("sig"), coords)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for r in range(n_runs):
                path = np.full(len(ids), mix64(np.array([r + 1], np.uint64))[0], np.uint64)
                for at, node in _children(path, sig, coords, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[at])], names=["key", "id"])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, ids = _sigs(b.column("sig"), coords), b.column("id").to_numpy(zero_copy_only=False)
            for at, node in _children(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64), sig, coords, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[at])], names=["key", "id"])

    level = reps.select("id", "sig").mapInArrow(roots, "key long, id long")
    leaves = None
    for d in range(1, depth + 1):
        n = level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        level = cut(level.join(n, "key"))
        done = level.filter(F.col("n") <= small) if d < depth else level
        leaves = done.select("key", "id") if leaves is None else leaves.union(done.select("key", "id"))
        if d == depth or level.filter(F.col("n") > small).isEmpty():
            break
        level = level.filter(F.col("n") > small).join(reps.select("id", "sig"), "id").select("key", "id", "sig").mapInArrow(split, "key long, id long").distinct()

    # each set with all its nodes: a pair belongs to the smallest node that both have
    nodes = leaves.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    placed = nodes.join(reps.select("id", "sig"), "id").select(F.explode("keys").alias("key"), "id", "keys", "sig")

    def plausible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a task that have a partner there which their signatures don't rule out."""
        for _, t in runs(batches, "task"):
            key, ids, part = t.column("key")[0].as_py(), t.column("id").to_numpy(), t.column("block").to_numpy()
            left, right = t.column("left")[0].as_py(), t.column("right")[0].as_py()
            sig = _sigs(t.column("sig"), coords)
            before = _owned(t.column("keys").to_pylist(), key)
            mine: list[list[np.ndarray]] = [[] for _ in ids]
            for g in before.values():
                for i in g.tolist():
                    mine[i].append(g)
            cols = np.ascontiguousarray(sig.T)
            good = np.zeros(len(ids), bool)
            for i in np.flatnonzero(part == left).tolist():
                same = np.zeros(len(ids), np.uint8)
                for c in range(coords):
                    same += cols[c] == sig[i, c]
                ok = same >= need
                if left != right:
                    ok &= part == right
                ok[i] = False
                for g in mine[i]:
                    ok[g] = False
                if ok.any():
                    good[i] = True
                    good |= ok
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(good.sum(), key), pa.int64()), pa.array(ids[good]), t.column("keys").combine_chunks().filter(pa.array(good))], names=["key", "id", "keys"])

    some = by_key(in_blocks(placed, 2048).select("task", "key", "left", "right", "block", "id", "keys", "sig"), "task", plausible, "key long, id long, keys array<long>")
    some = cut(some.dropDuplicates(["key", "id"]))

    # what is left fetches its text, once for each of its nodes
    texts = docs.select(row, text_bytes().alias("text")).join(some.select("id").distinct().join(reps.select("id", "row"), "id"), "row").dropDuplicates(["id"]).select("id", "text")
    heavy = in_blocks(some, block).join(texts, "id").join(reps.select("id", "weight"), "id").select("task", "key", "left", "right", "block", "id", "keys", "weight", "text")

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each member: a member it is linked with through the task's links, and the documents it links with there."""
        memo = WordHash()
        for _, t in runs(batches, "task"):
            key, ids, part, weight = t.column("key")[0].as_py(), t.column("id").to_numpy(), t.column("block").to_numpy(), t.column("weight").to_numpy()
            left, right = t.column("left")[0].as_py(), t.column("right")[0].as_py()
            found = shingles(t.column("text").to_pylist(), words, memo)
            size = np.array([len(s) for s in found])
            m = len(ids)
            owner = np.repeat(np.arange(m), size)
            token, where = np.unique(np.concatenate(found), return_inverse=True)
            order = np.argsort(where, kind="stable")
            posts, begin = owner[order], np.zeros(len(token) + 1, np.int64)
            np.cumsum(np.bincount(where, minlength=len(token)), out=begin[1:])
            at = np.concatenate([[0], np.cumsum(size)])
            before = _owned(t.column("keys").to_pylist(), key)
            mine: list[list[np.ndarray]] = [[] for _ in ids]
            for g in before.values():
                for i in g.tolist():
                    mine[i].append(g)
            forest, count, linked = Forest(m), np.zeros(m, np.int64), np.zeros(m, bool)
            for i in np.flatnonzero(part == left).tolist():
                mask = np.arange(m) > i if left == right else part == right
                for g in mine[i]:
                    mask[g] = False
                mask &= np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i])
                if not mask.any():
                    continue
                w = where[at[i] : at[i + 1]]
                w = w[begin[w + 1] - begin[w] > 1]
                both = np.bincount(np.concatenate([posts[begin[x] : begin[x + 1]] for x in w.tolist()]), minlength=m) if len(w) else np.zeros(m, np.int64)
                hit = np.flatnonzero(mask & (both >= threshold * (size + size[i] - both)))
                if len(hit):
                    linked[i] = linked[hit] = True
                    count[i] += weight[hit].sum()
                    count[hit] += weight[i]
                    for j in hit.tolist():
                        forest.join(i, j)
            if linked.any():
                got = np.flatnonzero(linked)
                low: dict[int, int] = {}
                for i in got.tolist():
                    r = forest.root(i)
                    low[r] = min(low.get(r, int(ids[i])), int(ids[i]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array([low[forest.root(i)] for i in got.tolist()], pa.int64()), pa.array(count[got])], names=["a", "b", "n"])

    found = cut(by_key(heavy, "task", judge, "a long, b long, n long"))
    root = components(found.select("a", "b"))
    more = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    classes = reps.select("id", "first_id", "weight").join(root, "id", "left").join(more, "id", "left").select("id", "first_id", "weight", F.coalesce("root", "id").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    first = classes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    of = cut(spread_join(classes, first, "root").select(F.col("id").alias("sid"), "root", "class_id", (F.col("n") + F.col("weight") - 1).alias("n_links")))
    linked = spread_join(every.filter("sid is not null").select("doc_id", "row", "sid"), of, "sid").select("doc_id", "row", "root", "class_id", "n_links")
    alone = every.filter("sid is null").select("doc_id", "row", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.union(alone)


def links(docs: DataFrame, **how) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, class_id (smallest doc_id that links reach), n_links (other
    documents with similarity >= threshold) and is_kept (the first document of its class). Parameters as for members."""
    return members(docs, **how).select("doc_id", "class_id", "n_links").withColumn("is_kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class: its smallest doc_id (null last), then hash of the text. Rows that repeat stay once; texts without words stay."""
    got = members(docs, **how)
    best = got.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best"))
    kept = best.select(F.col("best.row").alias("row")).union(got.filter("root is null").select("row")).distinct()
    row = fresh("kept_row", docs)
    return docs.withColumn(row, F.xxhash64("doc_id", "text")).join(kept.withColumnRenamed("row", row), row, "left_semi").dropDuplicates([row]).drop(row)
