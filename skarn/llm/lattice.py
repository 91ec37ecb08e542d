"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to 8 dimensions, scaled, and decoded to the nearest point of the E8 lattice, in
several tables. A vector is stored in its own cell and also probes the `probes` neighbouring cells nearest to it, of the
240 around. Vectors that meet, one of them at home, are compared by cosine in double precision; labels must be
equal. How many projections make a key (`stages`) follows from the number of vectors for each label, so cells stay small; the
tables grow with them, so that recall stays the same. Where `stages` is given, `tables` are as given. Cells hold
sketches of 128 bits; only vectors with a likely partner travel to the comparison.

A pair is judged only where it meets first, so link counts add up without listing pairs. Equal vectors of one label are one
row with a weight. Cells that hold many vectors are compared in blocks.

Defined results: a vector links with nothing if it, or its label, is null, or it is zero, empty, or has a null or non-finite
component; vectors of different lengths never link; copies under several ids link with each other; ids that repeat are
separate rows, each counting the other if their vectors link. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import Forest, by_key, components, cut, in_blocks, mix64, runs, spread_join

#: Cells that a table of one projection spreads vectors over, about.
CELLS = 2000
#: Times as many tables for each further projection in a key: a pair at the threshold meets as surely as with one.
MORE = 4


#: Bits in which the 128-bit sketches of linked vectors may differ. At cosine 0.93 these are 15.4 on average, with a deviation of 3.7: all but about one in a hundred million stay within. Unlike vectors differ in 64.
APART = 36


def sketches(unit: np.ndarray) -> np.ndarray:
    """128 signs of random projections of each unit vector, as two words."""
    plane = np.random.default_rng(41).standard_normal((unit.shape[1], 128))
    return np.packbits(unit @ plane >= 0, axis=1).view(np.uint64)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates and an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row: even-sum integers, or those shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1, -1):
                for t in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for k in range(256):
        signs = np.array([1 - 2 * (k >> i & 1) for i in range(8)])
        if signs.prod() == 1:
            out.append(signs / 2)
    return np.array(out)


def keys(unit: np.ndarray, label: np.ndarray, tables: int, stages: int, probes: int, scale: float, seed: int = 23) -> np.ndarray:
    """For each vector and table: its own cell's key, then those of the probed cells. Shape (n, tables, 1 + probes)."""
    n, dim = unit.shape
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    near = roots()
    for t in range(tables):
        own = mix64(label.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t + 1) + np.uint64(dim << 20))
        cells, steps, gain = [], [], []
        for _ in range(stages):
            x = unit @ rng.standard_normal((dim, 8)) * scale
            cell = e8(x)
            lean = (x - cell) @ near.T - 1  # half the loss of distance by stepping to a neighbour
            best = np.argpartition(-lean, probes, 1)[:, :probes] if probes else np.zeros((n, 0), int)
            cells.append(cell)
            steps.append(near[best])
            gain.append(np.take_along_axis(lean, best, 1))
        coded = [_code(c) for c in cells]
        key = own.copy()
        for c in coded:
            key = mix64(key * np.uint64(31) + c)
        out[:, t, 0] = key
        if probes:
            # of all single steps in any stage, the cheapest
            every = np.concatenate(gain, 1)
            pick = np.argsort(-every, 1, kind="stable")[:, :probes]
            for p in range(probes):
                stage, which = pick[:, p] // probes, pick[:, p] % probes
                key = own.copy()
                for s in range(stages):
                    moved = _code(cells[s] + steps[s][np.arange(n), which])
                    key = mix64(key * np.uint64(31) + np.where(stage == s, moved, coded[s]))
                out[:, t, 1 + p] = key
    return out


def _code(cell: np.ndarray) -> np.ndarray:
    whole = np.rint(cell * 2).astype(np.int64).view(np.uint64)
    out = np.zeros(len(cell), np.uint64)
    for i in range(8):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + whole[:, i])
    return out


def links(vectors: DataFrame, least: float = 0.93, tables: int = 8, probes: int = 6, scale: float = 0.55, block: int = 1024, stages: int | None = None) -> DataFrame:
    """For each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id (smallest vec_id that links reach), kept."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    valid = F.col("label").isNotNull() & F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))
    every = cut(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(valid, F.xxhash64("label", value)).alias("id"), F.when(valid, value).alias("v")
        )
    )
    reps = cut(every.filter("id is not null").groupBy("id").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id")))
    n, labels = reps.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if stages is None:
        stages = max(1, math.ceil(math.log(max(n / max(labels, 1) / 64, 1)) / math.log(CELLS)))
        tables *= MORE ** (stages - 1)

    def matrix(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: the rows that have it, and their unit vectors."""
        whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat, at = whole.values.to_numpy(), whole.offsets.to_numpy()
        size, out = np.diff(at), []
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            x = flat[at[rows][:, None] + np.arange(d)]
            x = x / np.abs(x).max(1, keepdims=True)  # large components would overflow when squared
            out.append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
        return out

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, label, v = b.column("id").to_numpy(), b.column("label").to_numpy(), b.column("v")
            for rows, u in matrix(v):
                k = keys(u, label[rows], tables, stages, probes, scale).view(np.int64)
                own = np.zeros(k.shape, bool)
                own[:, :, 0] = True
                each, sketch = tables * (1 + probes), sketches(u).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.reshape(-1)), pa.array(np.repeat(ids[rows], each)), pa.array(own.reshape(-1)), pa.array(np.repeat(sketch[:, 0], each)), pa.array(np.repeat(sketch[:, 1], each))],
                    names=["key", "id", "home", "s1", "s2"],
                )

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, "task"):
            label, column = t.column("label").to_numpy(), t.column("v").combine_chunks()
            # two cells may have one key by accident of hashing: labels and lengths part them
            for value in np.unique(label).tolist():
                mine = np.flatnonzero(label == value)
                for rows, u in matrix(column.take(pa.array(mine))):
                    if len(rows) > 1:
                        yield from judged(t, mine[rows], u)

    def judged(t: pa.Table, rows: np.ndarray, u: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links among these rows of a task; u: their unit vectors."""
        here, left, right = np.uint64(t.column("key")[0].as_py() & ((1 << 64) - 1)), t.column("left")[0].as_py(), t.column("right")[0].as_py()
        ids, part, weight, label, home = (t.column(c).to_numpy()[rows] for c in ("id", "block", "weight", "label", "home"))
        fits = {}
        for i in np.flatnonzero(part == left).tolist():
            ok = (u @ u[i] >= least) & (home | home[i])
            ok[: i + 1 if left == right else 0] = False
            if left != right:
                ok &= part == right
            if ok.any():
                fits[i] = np.flatnonzero(ok)
        if not fits:
            return
        k = keys(u, label, tables, stages, probes, scale)
        found = np.flatnonzero((k == here).any(axis=(0, 2)))
        if not len(found):
            return
        table = int(found[0])
        forest, count, linked = Forest(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for i, near in fits.items():
            # met before: in an earlier table, or in this one in the smaller of two cells
            met = (k[near, :table, :1] == k[i, None, :table, :]).any(axis=(1, 2)) | (k[near, :table, :] == k[i, None, :table, :1]).any(axis=(1, 2))
            a, b = k[near, table], k[i, table]
            other = np.where(home[near], b[0], a[:, 0])  # the cell where they could meet as well
            both = np.where(home[near], (a[:, 1:] == b[0]).any(1), (b[None, 1:] == a[:, :1]).any(1))
            met |= ~(home[near] & home[i]) & both & (other < here)
            near = near[~met]
            if len(near):
                linked[i] = linked[near] = True
                count[i] += weight[near].sum()
                count[near] += weight[i]
                for j in near.tolist():
                    forest.join(i, j)
        if linked.any():
            got = np.flatnonzero(linked)
            low: dict[int, int] = {}
            for i in got.tolist():
                r = forest.root(i)
                low[r] = min(low.get(r, int(ids[i])), int(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array([low[forest.root(i)] for i in got.tolist()], pa.int64()), pa.array(count[got])], names=["a", "b", "n"])

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a partner in their task, one of the two at home, that their sketches don't rule out; all tasks of a batch at once."""
        held: list[pa.RecordBatch] = []
        size = 0

        def told() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            task, home, side = (t.column(c).to_numpy() for c in ("task", "home", "block"))
            split = t.column("left").to_numpy() != t.column("right").to_numpy()
            x = np.stack([t.column("s1").to_numpy(), t.column("s2").to_numpy()], axis=1).view(np.uint64)
            edge = np.append(np.flatnonzero(np.diff(task)) + 1, len(task))
            end = np.repeat(edge, np.diff(np.append(0, edge)))
            good, i, step = np.zeros(len(task), bool), np.arange(len(task)), 1
            while True:
                i = i[i + step < end[i]]
                if not len(i):
                    break
                a = i[home[i] | home[i + step]]
                a = a[~split[a] | (side[a] != side[a + step])]
                a = a[~(good[a] & good[a + step])]
                ok = a[np.bitwise_count(x[a] ^ x[a + step]).sum(1) <= APART]
                good[ok] = good[ok + step] = True
                step += 1
            return t.filter(pa.array(good)).select(["task", "key", "left", "right", "block", "id", "home"]).to_batches()

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column("task").to_numpy()
            if size > 50_000 and k[0] != last:
                yield from told()
                held, size = [], 0
            elif size > 50_000 and k[0] != k[-1]:  # the task that goes on ends within this batch
                at = int(np.flatnonzero(k != k[0])[0])
                held.append(b.slice(0, at))
                yield from told()
                b, held, size = b.slice(at), [], 0
            held.append(b)
            size, last = size + b.num_rows, k[-1]
        if held:
            yield from told()

    dealt = in_blocks(reps.select("id", "label", "v").mapInArrow(cells, "key long, id long, home boolean, s1 long, s2 long"), block, need="home")
    some = cut(by_key(dealt.select("task", "key", "left", "right", "block", "id", "home", "s1", "s2"), "task", likely, "task long, key long, left int, right int, block int, id long, home boolean"))
    met = some.join(reps.select("id", "label", "v", "weight"), "id").select("task", "key", "left", "right", "block", "id", "home", "label", "v", "weight")
    found = cut(by_key(met, "task", judge, "a long, b long, n long"))
    root = components(found.select("a", "b"))
    more = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    classes = reps.select("id", "first_id", "weight").join(root, "id", "left").join(more, "id", "left").select("id", "first_id", "weight", F.coalesce("root", "id").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    first = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = cut(spread_join(classes, first, "root").select("id", "component_id", (F.col("n") + F.col("weight") - 1).alias("n_links")))
    out = spread_join(every.filter("id is not null").select("vec_id", "id"), of, "id").select("vec_id", "n_links", "component_id")
    out = out.union(every.filter("id is null").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
