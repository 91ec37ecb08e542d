"""Hard-negative mining by a vantage-point tree over norm-augmented vectors.

Components are scaled and floored to integers; a row's score for an anchor is their inner product. Each row gets one component more,
sqrt(M^2 - |x|^2) with M the largest length of any row; an anchor gets 0 there. Then |q - x|^2 = |q|^2 + M^2 - 2 score: the highest scores
are the nearest rows, and a window of scores is an annulus around the anchor. A vantage-point tree bounds the distance of
each of its leaves to an anchor from the distances to the vantage points on the way, and leaves are visited nearest first: for
positives from the anchor on, for negatives from the inner edge of the annulus, until the k-th row found is
nearer than all leaves left.

The upper tree is built from a bounded sample (`sample` rows for each of at most `leaves` leaves); every row is put into it, and the
bounds of a leaf come from all of its rows. Leaves are dealt out in blocks of about `block` rows; a task builds the lower tree of a
block when its rows arrive and then answers one batch of queries after another, so it never holds more than a block and a batch. Rounds
visit 1, 16, 256, ... further leaves; a query goes only to leaves that its rows so far don't rule out. Distances only rule
out, with a margin for rounding; scores are integers, so results are exact.

Equal vectors of one label are one row of the index with their smallest ids: more can't be among the first. Equal anchors ask once.

Defined results: a row takes no part if its vec_id, label or vector is null, the vector is empty or has a null or non-finite component,
or the sum of its squared integer components is 2^62 or more (scores would leave 64 bits); vectors of different lengths never meet; a row
that repeats (id, vector and label) counts once; another row under the anchor's id is a row like others; an anchor without positives,
and a positive without a row in its window, return nothing (so windows of negative scores, which are empty). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import cut, drop, partitions, spread_join

#: Rows of a leaf of the lower trees, about.
LEAF = 128
#: Scores beyond any that can occur.
FAR = 1 << 62
#: Leaves visited more in each round than in the one before.
WIDER = 16


class Tree:
    """Vantage points and radii of a complete binary tree; node 1 is the top, leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, depth: int):
        """x: augmented rows, in an order that has nothing to do with where they lie."""
        self.depth = depth
        self.vantage, self.radius = np.zeros((1 << depth, x.shape[1])), np.zeros(1 << depth)
        at = np.ones(len(x), np.int64)
        for node in range(1, 1 << depth):
            own = np.flatnonzero(at == node)
            if len(own):
                self.vantage[node] = x[own[0]]
                far = np.sqrt(((x[own] - x[own[0]]) ** 2).sum(1))
                self.radius[node] = np.median(far)
                at[own] = 2 * node + (far >= self.radius[node])

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances to the vantage points on the way there."""
        at, path = np.ones(len(x), np.int64), np.empty((len(x), self.depth))
        for level in range(self.depth):
            path[:, level] = np.sqrt(((x - self.vantage[at]) ** 2).sum(1))
            at = 2 * at + (path[:, level] >= self.radius[at])
        return at - (1 << self.depth), path

    def spans(self, leaf: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of each leaf's rows to each vantage point above it."""
        low, high = np.full((1 << self.depth, self.depth), np.inf), np.full((1 << self.depth, self.depth), -np.inf)
        np.minimum.at(low, leaf, path)
        np.maximum.at(high, leaf, path)
        return low, high

    def bounds(self, q: np.ndarray, top: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that a row of each leaf can have to each query; top: the squared length of augmented rows."""
        far = np.sqrt(np.maximum((q * q).sum(1)[:, None] + top - 2 * (q @ self.vantage[:, :-1].T), 0))
        least, most = np.zeros((len(q), len(low))), np.full((len(q), len(low)), np.inf)
        for level in range(self.depth):
            d = far[:, (np.arange(len(low)) + len(low)) >> (self.depth - level)]
            least = np.maximum(least, np.maximum(d - high[:, level], low[:, level] - d))
            most = np.minimum(most, d + high[:, level])
        return least, most


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def _matrix(b: pa.RecordBatch, at: np.ndarray, dim: int) -> np.ndarray:
    return b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(float)


def _long(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = _long(b, "dim")
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


def _annulus(q: np.ndarray, top: float, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner and outer distance of rows with scores from lo to hi, a little wider than they are."""
    norm = (q * q).sum(1)
    margin = 1e-6 * (np.sqrt(norm) + math.sqrt(top)) + 1e-9
    at = lambda score: np.sqrt(np.maximum(norm + top - 2 * score.astype(float), 0))
    return at(hi) - margin, at(lo) + margin


class Block:
    """Some rows of the index with a tree of their own."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, top: float):
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.top, self.ids = top, t.column("ids")
        x = _matrix(t, np.arange(t.num_rows), dim)
        tree = self.tree = Tree(augmented(x, top), max(0, math.ceil(math.log2(len(x) / LEAF))))
        leaf, path = tree.descend(augmented(x, top))
        self.low, self.high = tree.spans(leaf, path)
        self.order = np.argsort(leaf, kind="stable")
        self.edges = np.searchsorted(leaf[self.order], np.arange((1 << tree.depth) + 1))
        self.x, self.label, self.first = x[self.order], _long(t, "label")[self.order], _long(t, "first_id")[self.order]
        self.norm = (self.x.astype(np.int64) ** 2).sum(1)

    def search(self, b: pa.RecordBatch, dim: int, k: int, same: bool) -> pa.RecordBatch:
        """The k best rows of each query of b (item, label, v, lo, hi): score, whether the row is the anchor's own vector and label, ids."""
        q = _matrix(b, np.arange(b.num_rows), dim)
        label, lo, hi = _long(b, "label"), _long(b, "lo").copy(), _long(b, "hi")
        least, most = self.tree.bounds(q, self.top, self.low, self.high)
        inner, outer = _annulus(q, self.top, lo, hi)
        least = np.where((most >= inner[:, None]) & (least <= outer[:, None]), least, np.inf)
        turn = np.argsort(least, 1, kind="stable")
        exact = max(self.top, float((q * q).sum(1).max(initial=0))) < 1 << 52  # else products need 64-bit integers
        kind = float if exact else np.int64
        x, q = self.x.astype(kind), q.astype(kind)
        none = np.int64(-FAR)
        score, first, where = np.full((len(q), k), none), np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -1)
        for t in range(turn.shape[1]):
            leaf = turn[:, t]
            go = np.flatnonzero(least[np.arange(len(q)), leaf] <= outer)
            if not len(go):
                break
            for now in np.unique(leaf[go]).tolist():
                at, s, e = go[leaf[go] == now], self.edges[now], self.edges[now + 1]
                new = (q[at] @ x[s:e].T).astype(np.int64)
                fits = ((self.label[s:e] == label[at][:, None]) == same) & (new >= lo[at][:, None]) & (new <= hi[at][:, None])
                scores = np.concatenate([score[at], np.where(fits, new, none)], 1)
                firsts = np.concatenate([first[at], np.broadcast_to(self.first[s:e], new.shape)], 1)
                places = np.concatenate([where[at], np.where(fits, np.arange(s, e), -1)], 1)
                best = np.lexsort((firsts, -scores), axis=1)[:, :k]
                score[at], first[at], where[at] = (np.take_along_axis(a, best, 1) for a in (scores, firsts, places))
            full = where[go, k - 1] >= 0
            lo[go[full]] = score[go[full], k - 1]
            outer = _annulus(q.astype(float), self.top, lo, hi)[1]
        i, j = np.nonzero(where >= 0)
        found = where[i, j]
        norm = (q.astype(np.int64) ** 2).sum(1)
        own = (score[i, j] == norm[i]) & (self.norm[found] == norm[i]) & (self.label[found] == label[i])
        return pa.RecordBatch.from_arrays(
            [b.column("item").take(pa.array(i)), pa.array(score[i, j]), pa.array(own), pa.array(first[i, j]), self.ids.take(pa.array(self.order[found]))], names=["item", "score", "own", "first_id", "ids"]
        )


class Forest:
    """The index: rows in the leaves of one upper tree for each length of vectors, and the searches in it."""

    def __init__(self, rows: DataFrame, block: int, leaves: int, sample: int):
        """rows: label, v, dim, ids, first_id."""
        self.block = block
        sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)).alias("top")).collect()  # a row for each length
        self.top = {r["dim"]: float(r["top"]) for r in sizes}
        self.trees: dict[int, Tree] = {}
        for r in sizes:
            depth = max(0, math.ceil(math.log2(min(leaves, r["n"] / block))))
            some = rows.filter(F.col("dim") == r["dim"]).select("v", F.xxhash64("v", "label").alias("h")).orderBy("h", "v").limit(sample << depth).collect() if depth else []
            self.trees[r["dim"]] = Tree(augmented(np.array([x["v"] for x in some], float).reshape(len(some), r["dim"]), self.top[r["dim"]]), depth)
        deepest = max([t.depth for t in self.trees.values()], default=0)
        trees, top = self.trees, self.top

        def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, at in _by_dim(b):
                    leaf, path = trees[d].descend(augmented(_matrix(b, at, d), top[d]))
                    some = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*(b.column(n).take(some) for n in ("label", "v", "dim", "ids", "first_id")), pa.array(leaf.astype(np.int32)), pa.array(list(path), pa.list_(pa.float64()))], names=["label", "v", "dim", "ids", "first_id", "leaf", "path"])

        placed = cut(rows.select("label", "v", "dim", "ids", "first_id").mapInArrow(place, "label long, v array<int>, dim int, ids array<long>, first_id long, leaf int, path array<double>"))
        each = [f(F.get("path", F.lit(t))).alias(f"{name}{t}") for t in range(deepest) for name, f in (("low", F.min), ("high", F.max))]
        about = placed.groupBy("dim", "leaf").agg(F.expr(f"cast((count(*) + {block - 1}) div {block} as int)").alias("blocks"), *each)
        known = about.collect()  # at most `leaves` rows for each length
        self.spans, self.blocks = {}, {}
        for d, tree in trees.items():
            low, high, blocks = np.full((1 << tree.depth, tree.depth), np.inf), np.full((1 << tree.depth, tree.depth), -np.inf), np.zeros(1 << tree.depth, np.int64)
            for r in known:
                if r["dim"] == d:
                    low[r["leaf"]], high[r["leaf"]], blocks[r["leaf"]] = [r[f"low{t}"] for t in range(tree.depth)], [r[f"high{t}"] for t in range(tree.depth)], r["blocks"]
            self.spans[d], self.blocks[d] = (low, high), blocks
        spread = F.pmod(F.xxhash64("first_id", "label"), F.coalesce("blocks", F.lit(1)))
        # place: one number for length, leaf and block
        at = (F.col("dim").cast("long") * (1 << 44) + F.col("leaf").cast("long") * (1 << 32) + spread).alias("place")
        with_blocks = placed.join(F.broadcast(about.select("dim", "leaf", "blocks")), ["dim", "leaf"])  # bounded as `known`
        self.index = cut(with_blocks.select(at, "dim", "label", "v", "ids", "first_id"))
        drop(placed)

    def nearest(self, items: DataFrame, k: int, same: bool) -> DataFrame:
        """item, score, own, first_id, ids: of each item (item, label, v, dim, lo, hi) the k best rows of the index, of the same label or of others."""
        trees, spans, blocks, top = self.trees, self.spans, self.blocks, self.top

        def route(start: int, stop: int):
            def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for d, at in _by_dim(b):
                        if d not in trees:
                            continue
                        step = max(1, 1_000_000 // len(blocks[d]))
                        for j in range(0, len(at), step):
                            some = at[j : j + step]
                            q = _matrix(b, some, d)
                            least, most = trees[d].bounds(q, top[d], *spans[d])
                            inner, outer = _annulus(q, top[d], _long(b, "lo")[some], _long(b, "hi")[some])
                            # turns count leaves that the query could need at first, so each has its turn in one round only
                            least = np.where(blocks[d] > 0, least, np.inf)
                            turn = np.argsort(least, 1, kind="stable")[:, start:stop]
                            near = np.take_along_axis(least, turn, 1)
                            i, t = np.nonzero((near <= outer[:, None]) & (np.take_along_axis(most, turn, 1) >= inner[:, None]))
                            leaf = turn[i, t]
                            times = blocks[d][leaf]
                            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                            place = np.repeat(d * (1 << 44) + leaf * (1 << 32), times) + part
                            who = pa.array(some[np.repeat(i, times)])
                            yield pa.RecordBatch.from_arrays([pa.array(place), *(b.column(n).take(who) for n in ("dim", "label", "v", "item", "lo", "hi"))], names=["place", "dim", "label", "v", "item", "lo", "hi"])

            return rows

        def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            of, tree = None, None
            for b in batches:
                if not b.num_rows:
                    continue
                place, asks = _long(b, "place"), _long(b, "asks")
                edges = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(place)]
                for s, e in zip(edges, edges[1:]):
                    if place[s] != of:
                        of, held, tree = place[s], [], None
                    if not asks[s]:
                        held.append(b.slice(s, e - s))
                    elif held:
                        d = int(of >> 44)
                        tree = tree or Block(held, d, top[d])
                        for j in range(s, e, 2000):
                            yield tree.search(b.slice(j, min(2000, e - j)), d, k, same)

        columns = ["place", "asks", "dim", "label", "v", "ids", "first_id", "item", "lo", "hi"]
        stored = self.index.withColumn("asks", F.lit(False))
        n = partitions(items.sparkSession)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "first_id")
        found, start, stop = None, 0, 1
        most = max([len(b) for b in blocks.values()], default=1)
        while start < most or found is None:
            now = items
            if found is not None:
                kth = found.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
                now = items.join(kth, "item", "left").withColumn("lo", F.coalesce("kth", "lo")).drop("n", "kth")
            asked = now.mapInArrow(route(start, stop), "place long, dim int, label long, v array<int>, item long, lo long, hi long").withColumn("asks", F.lit(True))
            both = stored.unionByName(asked, allowMissingColumns=True).select(*columns)
            new = both.repartition(n, "place").sortWithinPartitions("place", "asks", "item").mapInArrow(answer, "item long, score long, own boolean, first_id long, ids array<long>")
            last, found = found, cut((new if found is None else found.unionByName(new)).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r"))
            if last is not None:
                drop(last)
            start, stop = stop, stop + stop * WIDER
        return found


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (integers) of the rows that take part, each once."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.coalesce(F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))) & (F.size("embedding") > 0), F.lit(False))
    whole = F.transform(x, lambda e: F.floor(e * scale).cast("double"))
    norm = F.aggregate(F.transform(x, lambda e: F.floor(e * scale).cast("double")), F.lit(0.0), lambda a, e: a + e * e)
    known = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.when(finite, norm < 2.0**62).otherwise(False))
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(whole, lambda e: e.cast("int")).alias("v")).distinct()


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = 2048, leaves: int = 1024, sample: int = 16) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors, anchors: vec_id, embedding, label. Of each anchor the first `positives` other rows of its label are its positives; of each of
    these the first k rows of other labels with scores from low to high percent of the positive's are returned.
    """
    keep = max(positives + 1, k)
    part = Window.partitionBy("label", "v", "part").orderBy("vec_id")
    few = prepared(vectors, scale).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= keep)
    rows = few.groupBy("label", "v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"))
    forest = Forest(cut(rows.select("label", "v", F.size("v").alias("dim"), "ids", F.get("ids", F.lit(0)).alias("first_id"))), block, leaves, sample)

    key = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256)
    asked = cut(prepared(anchors, scale).withColumn("key", key))
    wide = {"lo": F.lit(-FAR).cast("long"), "hi": F.lit(FAR).cast("long")}
    asks = cut(asked.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v")).withColumn("item", F.monotonically_increasing_id()))
    near = forest.nearest(asks.withColumn("dim", F.size("v")).withColumns(wide), positives + 1, True)
    turn = Window.partitionBy("item").orderBy(F.desc("score"), "vec_id")
    first = near.select("item", "score", "own", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(turn)).filter(F.col("r") <= positives + 1)
    pos = cut(first)

    # low * score / 100 rounded up and high * score / 100 rounded down, in whole numbers that stay within 64 bits
    hundreds, rest = F.expr("(score - pmod(score, 100)) div 100"), F.expr("pmod(score, 100)")
    lo, hi = low * hundreds + F.expr(f"({low} * pmod(score, 100) + 99) div 100"), high * hundreds + F.expr(f"({high} * pmod(score, 100)) div 100")
    windows = pos.select(F.col("item").alias("q"), "score").distinct().select("q", "score", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).filter("lo <= hi")
    items = cut(windows.join(asks.select(F.col("item").alias("q"), "label", "v", F.size("v").alias("dim")), "q").withColumn("item", F.monotonically_increasing_id()))
    far = forest.nearest(items.select("item", "label", "v", "dim", "lo", "hi"), k, False)
    worst = far.select("item", "score", F.explode("ids").alias("vec_id")).withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)
    negs = worst.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("negs"))
    negs = items.select("item", F.col("q"), "score").join(negs, "item").select(F.col("q").alias("item"), "score", "negs")

    full = pos.join(negs, ["item", "score"], "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("r", "score", "vec_id", "own", "negs"))).alias("pos"))
    answers = asks.select("item", "key").join(full, "item").select("key", "pos")
    each = spread_join(asked.select("vec_id", "key"), answers, "key")
    others = F.slice(F.filter("pos", lambda p: ~(p["own"] & (p["vec_id"] == F.col("vec_id")))), 1, positives)
    out = each.select(F.col("vec_id").alias("anchor_id"), F.explode(others).alias("p")).select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode("p.negs").alias("n"))
    return out.select("anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), "n.negative_id", "positive_score", "n.negative_score")
