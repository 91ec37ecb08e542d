"""Substring dedup behind a count-min prefilter.

A window is `width` consecutive words of one document. Every word is dropped that lies in a window whose word
sequence also starts in a document with a smaller doc_id.

Documents are dealt by hash into blocks of about `block_chars` characters. First pass: each block counts its
windows in a count-min sketch of `depth` rows. The sketch is as wide as the corpus has characters, so no block
holds all of it: a block sends only the columns it hits, in shards of columns, and one task for each shard adds
the blocks' sketches up and answers each block with one bit for each column that the block sent: counted more
than once or not. A window counts as repeated if its column is, in every row; counts are never too small, so no
repeated window is lost. Second pass: only windows estimated repeated are sent (hash, smallest doc_id in the
block), one task for each range of hashes groups them exactly and answers with one bit: some other block has the
window in an earlier document. What a block sends and gets grows with the block, not with the corpus.

Defined results: a null or empty text has no words; a text shorter than a window loses nothing; a null doc_id
counts as later than all others; rows that share a doc_id never drop each other's words; repeats inside one
document alone are kept; a very long text is one row of one block. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import by_key, hash_words, multipliers, partitions, runs, small_batches, text_bytes, window_hash, word_memo

LAST = np.iinfo(np.int64).max
SKETCH = "shard long, block long, columns binary, twice binary"
CLAIM = "shard long, block long, h1 binary, h2 binary, first binary"
ANSWER = "block long, shard long, pass int, bits binary"


def squeeze(x: np.ndarray) -> bytes:
    """Integers by byte plane, deflated: planes of zeros cost nothing."""
    x = np.ascontiguousarray(x)
    return len(x).to_bytes(4, "little") + bytes([x.itemsize]) + zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unsqueeze(b: bytes) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), b[4]
    planes = np.frombuffer(zlib.decompress(b[5:]), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n)


def bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def unbits(b: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b[4:], np.uint8), count=int.from_bytes(b[:4], "little")).astype(bool)


class Block:
    """The windows of one block's documents, sorted by their first hash."""

    def __init__(self, table: pa.Table, width: int):
        self.ids = table.column("d").to_numpy()
        self.words = [t.split() for t in table.column("text").to_pylist()]
        self.width = width
        self.flat, self.ends = hash_words(self.words, word_memo())
        n = np.diff(self.ends)
        at = np.flatnonzero(np.arange(len(self.flat)) + width <= np.repeat(self.ends[1:], n))
        h1 = window_hash(self.flat, width, 101)[at]
        order = np.argsort(h1)
        self.h1, self.at = h1[order], at[order]
        self.doc = np.repeat(self.ids, n)[self.at]

    def columns(self, row: int, log_width: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """The windows' sketch columns in a row, sorted; the order that sorts them; where each column begins."""
        if row == 0:
            col, order = self.h1 >> np.uint64(64 - log_width), None
        else:
            col = (self.h1 * multipliers(8, 7)[row]) >> np.uint64(64 - log_width)
            order = np.argsort(col)
            col = col[order]
        return col, order, np.flatnonzero(np.diff(col, prepend=np.uint64(1 << 63)))

    def likely(self, answers: dict[int, np.ndarray], depth: int, log_width: int, log_shards: int) -> np.ndarray:
        """Which windows have only repeated columns."""
        yes = np.ones(len(self.h1), bool)
        for row in range(depth):
            col, order, begin = self.columns(row, log_width)
            parts = [answers[s] for s in sorted(answers) if s >> log_shards == row]
            if parts:
                told = np.repeat(np.concatenate(parts), np.diff(begin, append=len(col)))
                if order is None:
                    yes &= told
                else:
                    yes[order] &= told
        return yes

    def claims(self, yes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the likely windows: places; h1, h2 and first doc_id of each distinct one, by h1, then h2; its number for each place."""
        at, doc, a = self.at[yes], self.doc[yes], self.h1[yes]
        b = (window_hash(self.flat, self.width, 202)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        same = a[1:] == a[:-1]
        if (same & (b[1:] != b[:-1])).any():  # unlike windows with one first hash
            order = np.lexsort((b, a))
            at, doc, a, b = at[order], doc[order], a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begin = np.flatnonzero(new)
        first = np.minimum.reduceat(doc, begin) if len(begin) else np.zeros(0, np.int64)
        return at, doc, a[begin], b[begin], first, np.cumsum(new) - 1


def drop_repeated(docs: DataFrame, width: int = 13, depth: int = 2, block_chars: int = 6_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    chars = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    blocks = max(1, -(-chars // block_chars))
    log_shards = (blocks - 1).bit_length()
    log_width = max(16, (chars - 1).bit_length(), log_shards + 8)
    n = max(partitions(spark), blocks)
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("d"), text_bytes().alias("text")
    ).repartition(n, "block")  # the same exchange feeds all three passes

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in runs(batches, "block"):
            b, out = Block(table, width), []
            for row in range(depth):
                every, _, begin = b.columns(row, log_width)
                col, count = every[begin], np.diff(begin, append=len(every))
                cuts = np.searchsorted(col, np.arange(1, 1 << log_shards, dtype=np.uint64) << np.uint64(log_width - log_shards))
                for s, (c, k) in enumerate(zip(np.split(col, cuts), np.split(count, cuts), strict=True)):
                    if len(c):
                        out.append(((row << log_shards) + s, block, squeeze(np.diff(c, prepend=np.uint64(0)) if log_width > 32 else np.diff(c.astype(np.uint32), prepend=np.uint32(0))), bits(k > 1)))
            yield _batch(out, SKETCH)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in runs(batches, "shard"):
            to = table.column("block").to_pylist()
            cols = [np.cumsum(unsqueeze(x), dtype=np.uint64) for x in table.column("columns").to_pylist()]
            twice = [unbits(x) for x in table.column("twice").to_pylist()]
            every = np.concatenate(cols)
            known, count = np.unique(np.concatenate([every, every[np.concatenate(twice)]]), return_counts=True)
            known = known[count > 1]
            found = np.searchsorted(known, every)
            yes = np.split(known[np.minimum(found, len(known) - 1)] == every if len(known) else np.zeros(len(every), bool), np.cumsum([len(c) for c in cols])[:-1])
            yield _batch([(block, shard, 1, bits(y)) for block, y in zip(to, yes, strict=True)], ANSWER)

    def answers(table: pa.Table, of: int) -> dict[int, np.ndarray]:
        t = table.filter(pa.compute.equal(table.column("pass"), of))
        return dict(zip(t.column("shard").to_pylist(), map(unbits, t.column("bits").to_pylist()), strict=True))

    def claim(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            b = Block(left, width)
            yes = b.likely(answers(right, 1), depth, log_width, log_shards)
            _, _, h1, h2, first, _ = b.claims(yes)
            cuts = np.searchsorted(h1, np.arange(1, 1 << log_shards, dtype=np.uint64) << np.uint64(64 - log_shards)) if log_shards else []
            block = left.column("block")[0].as_py()
            out = [(s, block, x.tobytes(), y.tobytes(), squeeze(z)) for s, (x, y, z) in enumerate(zip(np.split(h1, cuts), np.split(h2, cuts), np.split(first, cuts), strict=True)) if len(x)]
            out.append((-1 - block, block, bits(yes), b"", b""))  # comes back to the block for the last pass
        return pa.Table.from_batches([_batch(out, CLAIM)])

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in runs(batches, "shard"):
            if shard < 0:
                yield _batch([(-1 - shard, 0, 1, table.column("h1")[0].as_py())], ANSWER)
                continue
            h1 = [np.frombuffer(x, np.uint64) for x in table.column("h1").to_pylist()]
            sizes = np.cumsum([len(x) for x in h1])[:-1]
            a, b = np.concatenate(h1), np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("h2").to_pylist()])
            first = np.concatenate([unsqueeze(x) for x in table.column("first").to_pylist()]).view(np.int64)
            order = np.lexsort((b, a))
            x, y = a[order], b[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            low = np.minimum.reduceat(first[order], np.flatnonzero(new))
            earlier = np.zeros(len(x), bool)
            earlier[order] = low[np.cumsum(new) - 1] < first[order]
            yield _batch([(block, shard, 2, bits(e)) for block, e in zip(table.column("block").to_pylist(), np.split(earlier, sizes), strict=True)], ANSWER)

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        if not left.num_rows:
            return schema.empty_table()
        b = Block(left, width)
        at, doc, h1, _, first, group = b.claims(answers(right, 1)[0])
        got = answers(right, 2)
        earlier = np.concatenate([got[s] for s in sorted(got)]) if got else np.zeros(0, bool)
        assert len(earlier) == len(h1)
        gone = at[earlier[group] | (doc > first[group])] if len(at) else at
        edge = np.zeros(len(b.flat) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + width, -1)
        stay = np.cumsum(edge[:-1]) == 0
        removed = [int(np.count_nonzero(~stay[s:e])) for s, e in zip(b.ends[:-1], b.ends[1:], strict=True)]
        kept = [b" ".join(w if not r else itertools.compress(w, stay[s : s + len(w)].tolist())) for w, r, s in zip(b.words, removed, b.ends[:-1].tolist(), strict=True)]
        return pa.table([[None if i == LAST else int(i) for i in b.ids], [len(w) for w in b.words], removed, [k.decode() for k in kept]], schema=schema)

    sketches = rows.sortWithinPartitions("block").mapInArrow(sketch, SKETCH)
    first = by_key(sketches, "shard", merge, ANSWER)
    claims = rows.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(claim, CLAIM)
    second = by_key(claims, "shard", settle, ANSWER)
    return rows.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(out: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = zip(*out, strict=True) if out else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])
