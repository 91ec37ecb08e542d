"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit for the sign of each component. Codes are cut into m segments of about log2(number of codes)
bits, and one index lists the codes by segment and value there, spread over the cluster by these. A query looks up, in every
segment, all values within radius 0, then 1, and so on, and verifies the codes found. After radius r every code
within distance m * (r + 1) - 1 has been seen, so a query stops once its k-th verified distance is no larger. Each radius is
one join of the probes of the queries still open with the index; what a query has found so far is its k best rows.

A radius that has more probes than there are codes is not worth a lookup: the queries still open then, a stated set, meet
all codes in packed blocks. Equal codes are kept as one, with their k smallest ids: more can't be in a best k, as ties go to the
smaller id.

Defined results: a vector that is null, or has a null, NaN or no component, has no code, is not found and finds nothing;
a zero counts as not negative; vectors of different lengths never meet; a query finds itself unless it is left out
(same id); rows that repeat count once each; fewer than k others give fewer rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import by_key, cut, drop, mix64, runs


def segments(bits: int, n: int) -> list[tuple[int, int]]:
    """Cuts a code of `bits` bits into segments for n codes."""
    width = min(max(int(math.log2(max(n, 2))), 4), 24, bits)
    m = -(-bits // width)
    edges = [round(i * bits / m) for i in range(m + 1)]
    return list(zip(edges, edges[1:], strict=False))


def value_of(codes: np.ndarray, s: int, e: int) -> np.ndarray:
    """Bits s..e of each code (rows of 64-bit words)."""
    word, low = divmod(s, 64)
    out = codes[:, word] >> np.uint64(low)
    if low + e - s > 64:
        out = out | codes[:, word + 1] << np.uint64(64 - low)
    return (out & np.uint64((1 << (e - s)) - 1)).astype(np.int64)


def flips(width: int, r: int) -> np.ndarray:
    """All masks of r of `width` bits."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), r)], np.int64)


def _place(bits: int, segment: int, value: np.ndarray) -> np.ndarray:
    """One number for a segment and its value."""
    return mix64(value.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((bits << 8) + segment)).view(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, leave_out_self: bool = True, block: int = 8192, query_block: int = 512) -> DataFrame:
    """query_id, vec_id, distance, rank (1 to k; ties by vec_id) of each row of queries among vectors (vec_id, embedding)."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, codes, sizes = [], [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                if i is not None and v and None not in v:
                    x = np.array(v, float)
                    if not np.isnan(x).any():
                        packed = np.packbits(x < 0, bitorder="little").tobytes()
                        ids.append(i)
                        codes.append(packed + bytes(-len(packed) % 8))
                        sizes.append(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary()), pa.array(sizes, pa.int32())], names=["id", "code", "bits"])

    def coded(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(encode, "id long, code binary, bits int")

    spare = k + 1 if leave_out_self else k
    # equal codes: their number and smallest ids; ids are first cut to a few in each of many parts of a hot code
    ranked = coded(vectors).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = Window.partitionBy("code", "bits", "part").orderBy("id")
    few = ranked.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= spare)
    codes = cut(few.groupBy("code", "bits").agg(F.slice(F.sort_array(F.collect_list("id")), 1, spare).alias("ids")))
    # rows that repeat ask once, and their answers go to each of them
    asked = cut(coded(queries).groupBy("id", "code", "bits").agg(F.count(F.lit(1)).alias("times")).withColumn("q", F.xxhash64("id", "code", "bits")).withColumn("bound", F.lit(1 << 30)))
    sizes = {r["bits"]: r["n"] for r in codes.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length of vectors

    def words(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each code length: the rows that have it and their codes."""
        bits, raw = b.column("bits").to_numpy(zero_copy_only=False), b.column("code").to_pylist()
        for size in np.unique(bits).tolist():
            at = np.flatnonzero(bits == size)
            yield size, at, np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint64).reshape(len(at), -1)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, at, c in words(b):
                for i, (s, e) in enumerate(segments(size, sizes[size])):
                    yield pa.RecordBatch.from_arrays([pa.array(_place(size, i, value_of(c, s, e))), b.column("code").take(pa.array(at)), b.column("bits").take(pa.array(at)), b.column("ids").take(pa.array(at))], names=["place", "code", "bits", "ids"])

    index = cut(codes.mapInArrow(post, "place long, code binary, bits int, ids array<long>"))

    def probe(r: int):
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for size, at, c in words(b):
                    for i, (s, e) in enumerate(segments(size, sizes.get(size, 1))):
                        if r <= e - s:
                            mask = flips(e - s, r)
                            step = max(1, 200_000 // len(mask))
                            for j in range(0, len(at), step):
                                some = pa.array(np.repeat(at[j : j + step], len(mask)))
                                values = (value_of(c[j : j + step], s, e)[:, None] ^ mask).reshape(-1)
                                yield pa.RecordBatch.from_arrays([pa.array(_place(size, i, values)), pa.array(np.full(len(values), i), pa.int32()), *(b.column(n).take(some) for n in ("q", "id", "code", "bits", "bound"))], names=["place", "segment", "q", "id", "q_code", "q_bits", "bound"])

        return rows

    def measured(r: int):
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Distances of the codes met, each told by the first of its nearest segments only, and only if no smaller radius has told it.

            Codes further away than the k-th row that the query has already are of no use.
            """
            for b in batches:
                bits, of, bound = (b.column(n).to_numpy(zero_copy_only=False) for n in ("q_bits", "segment", "bound"))
                a, c = b.column("q_code").to_pylist(), b.column("code").to_pylist()
                for size in np.unique(bits).tolist():
                    at = np.flatnonzero(bits == size)
                    x = np.frombuffer(b"".join(a[i] for i in at.tolist()), np.uint64) ^ np.frombuffer(b"".join(c[i] for i in at.tolist()), np.uint64)
                    x = x.reshape(len(at), -1)
                    apart = np.stack([np.bitwise_count(value_of(x, s, e)) for s, e in segments(size, sizes.get(size, 1))], axis=1)
                    first = apart.argmin(1)
                    far = np.bitwise_count(x).sum(1).astype(np.int32)
                    new = (first == of[at]) & (apart[np.arange(len(at)), first] == r) & (far <= bound[at])
                    some = pa.array(at[new])
                    yield pa.RecordBatch.from_arrays([*(b.column(n).take(some) for n in ("q", "id", "code", "ids")), pa.array(far[new])], names=["q", "id", "code", "ids", "distance"])

        return rows

    def nearest(hits: DataFrame) -> DataFrame:
        """Of each query the k codes whose first row comes first: no other code has a row among the k best."""
        others = F.filter("ids", lambda i: i != F.col("id")) if leave_out_self else F.col("ids")
        x = hits.withColumn("ids", others).filter(F.size("ids") > 0)
        w = Window.partitionBy("q").orderBy("distance", F.array_min("ids"))
        return x.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "id", "code", "ids", "distance")

    def rows_of(hits: DataFrame) -> DataFrame:
        x = hits.select("q", "distance", F.explode("ids").alias("vec_id"))
        return x.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))).filter(F.col("rank") <= k)

    still, done, seen, r = asked, [], None, 0
    while True:
        left = {x["bits"]: segments(x["bits"], sizes.get(x["bits"], 1)) for x in still.select("bits").distinct().collect()}
        if not left:
            break
        if any(sum(math.comb(e - s, r) for s, e in segs) > sizes.get(b, 0) for b, segs in left.items()):
            done.append(nearest(_meet_all(still, codes, k, block, query_block)))  # these have met no code that counts yet
            break
        # many more rows than queries, which Spark can't know: no broadcast
        probes = still.select("q", "id", "code", "bits", "bound").mapInArrow(probe(r), "place long, segment int, q long, id long, q_code binary, q_bits int, bound int").hint("merge")
        met = probes.join(index, "place").filter("bits = q_bits")
        new = met.select("q", "id", "segment", "q_code", "q_bits", "bound", "code", "ids").mapInArrow(measured(r), "q long, id long, code binary, ids array<long>, distance int")
        found = cut(nearest(new if seen is None else seen.unionByName(new)))
        state = rows_of(found).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth"))
        m = F.create_map(*[F.lit(x) for b, segs in left.items() for x in (b, len(segs))])
        reach = m[F.col("bits")] * (r + 1) - 1
        # where the radius reaches over the whole code every code has been seen, be there k of them or not
        covered = F.coalesce((F.col("n") >= k) & (F.col("kth") <= reach), F.lit(False)) | (reach >= F.col("bits"))
        checked = cut(still.join(state, "q", "left").withColumn("covered", covered))
        done.append(cut(found.join(checked.filter("covered").select("q"), "q", "left_semi")))
        still = checked.filter("not covered").select("id", "code", "bits", "times", "q", F.when(F.col("n") >= k, F.col("kth")).otherwise(1 << 30).cast("int").alias("bound"))
        seen, r = cut(found.join(still.select("q"), "q", "left_semi")), r + 1
        drop(found)
    hits = done[0] if done else codes.select(F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("id"), "code", "ids", F.lit(0).alias("distance")).filter("false")
    for d in done[1:]:
        hits = hits.unionByName(d)
    out = rows_of(hits).join(asked.select("q", F.col("id").alias("query_id"), "times"), "q").withColumn("copy", F.explode(F.expr("sequence(1, cast(times as int))")))
    return out.select("query_id", "vec_id", "distance", F.col("rank").cast("int").alias("rank"))


def _meet_all(queries: DataFrame, codes: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    """q, id, code, ids, distance: of each block of codes the k nearest of each query. Both come packed, so no task holds all of either."""
    blocks = max(1, -(-codes.count() // block))
    asks = max(1, -(-queries.count() // query_block))

    def pack(names: list[str]):
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, t in runs(batches, "b"):
                yield pa.RecordBatch.from_arrays([pa.array([key]), *(pa.array([t.column(n).to_pylist()], kind) for n, kind in zip(names, (pa.list_(pa.binary()), pa.list_(pa.int64()) if names[1] == "q" else pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()))[: len(names)], strict=True))], names=["b", *names])

        return rows

    spread = lambda n, by: (F.pmod(F.xxhash64(by), F.lit(n)) + F.col("bits").cast("long") * (1 << 40)).alias("b")
    stored = by_key(codes.select(spread(blocks, "code"), "code", "ids"), "b", pack(["code", "ids"]), "b long, code array<binary>, ids array<array<long>>")
    sent = by_key(queries.select(spread(asks, "q"), "code", "q", "id"), "b", pack(["code", "q", "id"]), "b long, code array<binary>, q array<long>, id array<long>")
    sent = sent.select(F.col("code").alias("q_code"), "q", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("at"), (F.col("b") - F.pmod("b", F.lit(1 << 40))).alias("base"))
    sent = sent.select("q_code", "q", "id", (F.col("base") + F.col("at")).alias("b"))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                words = len(x["code"][0]) // 8
                every = np.frombuffer(b"".join(x["code"]), np.uint64).reshape(-1, words)
                first = np.array([min(i) for i in x["ids"]])
                out = []
                for q, i, c in zip(x["q"], x["id"], x["q_code"], strict=True):
                    d = np.bitwise_count(every ^ np.frombuffer(c, np.uint64)).sum(1)
                    near = np.lexsort((first, d))[: k + 1]  # one of them may be the query's own
                    out += [(q, i, x["code"][j], x["ids"][j], int(d[j])) for j in near.tolist()]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["q", "id", "code", "ids", "distance"])

    return sent.join(stored, "b").mapInArrow(search, "q long, id long, code binary, ids array<long>, distance int")
