"""Lexical retrieval packing: windows of one length, each filled by a seed document and its BM25 neighbours.

Texts become token ids once. Document frequencies and the mean length are those of the whole corpus: one number for
each token of the vocabulary. Documents are then dealt to index shards of about `shard_tokens` ids by content: two min-hashed terms,
rare ones the likelier, name a document's group, so documents that share rare terms meet in one shard wherever they come
from. A group larger than half a shard is split by its second term, and what is still too large, such as copies, by hash.

A shard builds a BM25 inverted index over its token ids. The first unused document seeds a window; the index returns the
unused documents most like it, which fill the window greedily; one whose doc_id the window has already is passed over as long as
there is another. A document that does not fit is cut where the window ends, and what is left of it seeds the next one. So
only the last window of a shard is padded.

Defined results: a null text is empty and gives one piece, the end token; rows that repeat are packed each on
their own; a null doc_id is packed and stays null; ties in score go to the smaller position in the shard
(doc_id, then hash of the text, ascending, nulls first); a very long text fills windows of its own and is held by one task;
no documents give no pieces. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import cut, mix64, partitions, runs, small_batches
from skarn.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Bm25:
    """Inverted index over the token ids of one shard; postings hold BM25 impacts."""

    def __init__(self, docs: list[np.ndarray], query_terms: int, idf: np.ndarray | None = None, mean: float | None = None, k1: float = 1.2, b: float = 0.75):
        """idf by term and the mean length: those of the shard, if not given."""
        n = len(docs)
        size = np.array([len(d) for d in docs], np.int64)
        # by term, then document: a posting is a run of equal keys
        key = np.concatenate(docs).astype(np.int64) * n + np.repeat(np.arange(n), size)
        key.sort()
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        tf = np.diff(begin, append=len(key)).astype(np.float32)
        term, self.doc = np.divmod(key[begin], n)
        df = np.bincount(term)
        idf = idf_of(n, df) if idf is None else idf
        mean = size.mean() if mean is None else mean
        # what a document's length adds to the count of a term
        self.slope = slope = (np.float32(k1 * (1 - b)) + np.float32(k1 * b / max(mean, 1)) * size).astype(np.float32)
        self.idf = idf.astype(np.float32)
        self.impact = self.idf[term] * tf * np.float32(k1 + 1) / (tf + slope[self.doc])
        self.begin = np.zeros(len(df) + 1, np.int64)
        np.cumsum(df, out=self.begin[1:])
        self.docs, self.n, self.query_terms = docs, n, query_terms

    def scores(self, seed: int) -> np.ndarray:
        terms, tf = np.unique(self.docs[seed], return_counts=True)
        if len(terms) > self.query_terms:  # those with the highest impact in the seed
            own = self.idf[terms] * tf / (tf + self.slope[seed])
            terms = terms[np.argsort(-own, kind="stable")[: self.query_terms]]
        parts = [slice(s, e) for s, e in zip(self.begin[terms].tolist(), self.begin[terms.astype(np.int64) + 1].tolist(), strict=True)]
        if not parts:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.impact[p] for p in parts]), self.n)


def idf_of(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def reading_order(docs: list[np.ndarray], window: int, query_terms: int, idf: np.ndarray | None = None, mean: float | None = None, names: list[int | None] | None = None) -> list[int]:
    """The documents of one shard in the order in which their windows take them. names: doc_ids, so that copies part."""
    n, index = len(docs), Bm25(docs, query_terms, idf, mean)
    free = np.ones(n, bool)
    name = np.arange(n) if names is None else np.unique([-k - 1 if x is None else x for k, x in enumerate(names)], return_inverse=True)[1]
    order: list[int] = []
    filled, first, seed = 0, 0, -1
    inside: set[int] = set()

    def take(d: int) -> bool:
        """Whether the window ended within or right after d."""
        nonlocal filled
        free[d] = False
        order.append(d)
        before, filled = filled // window, filled + len(docs[d])
        if filled // window > before:
            inside.clear()
        inside.add(int(name[d]))
        return filled // window > before

    while len(order) < n:
        if seed < 0:
            while not free[first]:
                first += 1
            seed = first
            if int(name[seed]) in inside:  # another one, if there is any
                other = np.flatnonzero(free & ~np.isin(name, list(inside)))
                seed = int(other[0]) if len(other) else first
            if take(seed) and filled % window == 0:
                seed = -1
                continue
        s = index.scores(seed)
        left = np.flatnonzero(free & (s > 0) & ~np.isin(name, list(inside)))
        near = left
        if len(near) > 64:  # the nearest first; the rest only if these don't fill the window
            top = near[np.argpartition(-s[near], 63)]
            near = top[s[top] >= s[top[:64]].min()]
        near = near[np.lexsort((near, -s[near]))]
        if not len(near):
            seed = -1
            continue
        for d in near.tolist():
            if int(name[d]) in inside:
                continue
            if take(d):
                seed = d if filled % window else -1
                break
    return order


def _pieces(order: list[int], docs: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of each piece, in reading order."""
    at = 0
    for d in order:
        start, size = 0, len(docs[d])
        while start < size:
            room = window - at % window
            take = min(room, size - start)
            yield d, start, take, at // window, at % window
            start, at = start + take, at + take


def term_draws(idf: np.ndarray) -> list[np.ndarray]:
    """For each of two draws: a number for each term. The largest in a document names the term drawn, with a chance in proportion to its idf, alike in documents alike."""
    out = []
    for seed in (17, 29):
        u = ((mix64(np.arange(len(idf), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5) / 2**53
        out.append(np.log(u) / idf)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_tokens: int = 2_500_000, query_terms: int = 24) -> DataFrame:
    """All texts of docs (doc_id, text) as pieces of windows.

    Returns doc_id, start (ids of the document before the piece), length, ids (little-endian unsigned 32-bit),
    doc_tokens (ids of the document with its end token), sequence_id, offset (in the sequence, gapless from 0).
    tokenizer: path of the vocabulary file, the same on every executor. A shard has about shard_tokens ids, which bounds
    what one task holds; a text longer than that is one task's by itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = encoder(tokenizer).narrow() if end_id < 1 << 16 else "<u4"  # ids travel in 16 bits if that is enough
    wide = np.dtype(kind).itemsize

    def tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known, end = encoder(tokenizer), np.array([end_id], kind).tobytes()
        for b in batches:
            raw = [i + end for i in known.ids(b.column("text").to_pylist(), kind)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array([len(x) // wide for x in raw], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "h", "n", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = cut(texts.mapInArrow(tokenise, "doc_id long, h long, n long, ids binary"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that have each id; at -1 all, at -2 the ids in them."""
        df, n, size = np.zeros(1, np.int64), 0, 0
        for b in batches:
            for x in b.column("ids").to_pylist():
                ids = np.sort(np.frombuffer(x, kind))
                ids = ids[np.append(True, ids[1:] != ids[:-1])]
                if ids[-1] >= len(df):
                    df = np.pad(df, (0, int(ids[-1]) + 1 - len(df)))
                df[ids] += 1
                n, size = n + 1, size + len(x) // wide
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, size]))], names=["term", "df"])

    # a row for each token of the vocabulary at most
    told = {r["term"]: r["df"] for r in tokens.select("ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    n, size = told.pop(-1, 0), told.pop(-2, 0)
    df = np.zeros(max(told, default=0) + 1, np.int64)
    df[list(told)] = list(told.values())
    idf, mean = idf_of(n, df), size / max(n, 1)
    shards = max(1, -(-int(size) // shard_tokens))
    heavy = max(1, shard_tokens // 2)

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, draws = 0, term_draws(idf)
        for b in batches:
            ids = [np.frombuffer(x, kind) for x in b.column("ids").to_pylist()]
            drawn = [pa.array([x[np.argmax(d[x])] for x in ids], pa.int32()) for d in draws]
            yield pa.RecordBatch.from_arrays([*b.columns, *drawn, pa.array(np.arange(place, place + b.num_rows))], names=[*b.schema.names, "one", "two", "place"])
            place += b.num_rows

    schema = "doc_id long, h long, n long, ids binary, one int, two int, place long"
    if shards > 1:
        rows = tokens.mapInArrow(grouped, schema)
        # only groups larger than half a shard are kept, so there are few; Spark broadcasts the tables if they are small
        pairs = cut(rows.groupBy("one", "two").agg(F.sum("n").alias("size")))
        wide = cut(pairs.groupBy("one").agg(F.sum("size").alias("size")).filter(F.col("size") > heavy).select("one", F.expr(f"2 * (size div {heavy} + 1)").alias("parts")))
        deep = pairs.join(wide, "one").groupBy("one", F.pmod(F.xxhash64("two"), F.col("parts")).alias("part")).agg(F.sum("size").alias("size"))
        deep = cut(deep.filter(F.col("size") > heavy).select("one", "part", F.expr(f"size div {heavy} + 1").alias("salts")))
        rows = rows.join(wide, "one", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("two"), F.col("parts")), F.lit(0)))
        rows = rows.join(deep, ["one", "part"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("h", "place"), F.col("salts")), F.lit(0)))
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("one", "part", "salt"), F.lit(shards)))
    else:
        rows = tokens.withColumn("shard", F.lit(0).cast("long"))
    dealt = rows.select("shard", "doc_id", "h", "ids").repartition(max(partitions(spark), shards), "shard").sortWithinPartitions("shard", "doc_id", "h")

    def shard_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, t in runs(batches, "shard"):
            names = t.column("doc_id").to_pylist()
            ids = [np.frombuffer(x, kind).astype("<u4") for x in t.column("ids").to_pylist()]
            got = list(_pieces(reading_order(ids, window, query_terms, idf, mean, names), ids, window))
            for i in range(0, len(got), 2000):
                part = got[i : i + 2000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d, *_ in part], pa.int64()),
                        pa.array([s for _, s, *_ in part], pa.int64()),
                        pa.array([n for _, _, n, *_ in part], pa.int64()),
                        pa.array([ids[d][s : s + n].tobytes() for d, s, n, *_ in part], pa.binary()),
                        pa.array([len(ids[d]) for d, *_ in part], pa.int64()),
                        pa.array([(shard << 32) + w for *_, w, _ in part], pa.int64()),
                        pa.array([o for *_, o in part], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return dealt.mapInArrow(shard_pieces, SCHEMA)
