"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: for each turn OPEN role SAYS text DONE. The tokenizer encodes the rendering once and tells
each token's character offsets. The spans of the assistant's texts are sorted, as are the tokens, so binary search gives the tokens
that each span meets; a token over the edge of a span is cut to it. The mask marks these tokens, and their cut
offsets spell the assistant's texts exactly.

Control strings inside roles and texts are escaped: an invisible ESCAPE goes in after the first character, one more
than stand there already; unescaping takes one out. So no control string survives inside a text, and every text
comes back as it was.

Defined results: rows go by turn, then role, then text, nulls first; a null role or text is empty; a null conv_id is a
conversation of its own; rows that repeat are turns of their own; no rows give no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm.common import by_key, runs, small_batches

OPEN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
#: What may not stand in a text as it is: the template's own strings, and those of common templates and vocabularies.
CONTROL = [OPEN, SAYS, DONE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]"]
ESCAPE = "⁣"
_FIND = re.compile("|".join(f"{re.escape(c[0])}{ESCAPE}*{re.escape(c[1:])}" for c in CONTROL))
_BACK = re.compile("|".join(f"{re.escape(c[0])}{ESCAPE}+{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(SAYS)}(.*?){re.escape(DONE)}", re.DOTALL)
SCHEMA = "conv_id long, formatted string, ids binary, loss binary, loss_start binary, loss_end binary, loss_turn binary"
NOBODY = -(1 << 63)


def escape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[0][0] + m[0][2:], text)


def render(turns: list[tuple[str, str]], loss_role: str) -> tuple[str, list[tuple[int, int]]]:
    """The rendering, and the span of each text under the loss."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SAYS}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, DONE]
        at += len(head) + len(body) + len(DONE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def align(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """For each token: under the loss or not, its part of a span, the span's number."""
    n = len(offsets)
    start, end = np.array(offsets, np.int32).reshape(-1, 2).T
    loss, low, high, turn = np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    if n and spans:
        a, b = np.array(spans, np.int32).T
        first, last = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
        for k in range(len(spans)):
            s = slice(first[k], last[k])
            if a[k] == b[k] or first[k] >= last[k]:
                continue
            loss[s], turn[s] = 1, k
            # tokens that share one character have the same offsets: the first of them spells it
            reach = np.maximum(np.concatenate([[a[k]], end[s][:-1]]), a[k])
            low[s], high[s] = np.maximum(start[s], reach), np.minimum(end[s], b[k])
    return loss, low, np.maximum(low, high), turn


def loss_texts(formatted: str, loss: bytes, low: bytes, high: bytes, turn: bytes) -> list[str]:
    """The texts that the mask covers, read back from the rendering and the masked tokens."""
    out: dict[int, list[str]] = {}
    for m, a, b, k in zip(loss, np.frombuffer(low, np.int32).tolist(), np.frombuffer(high, np.int32).tolist(), np.frombuffer(turn, np.int32).tolist(), strict=True):
        if m:
            out.setdefault(k, []).append(formatted[a:b])
    return [unescape("".join(v)) for _, v in sorted(out.items())]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def format_chats(rows: DataFrame, tokenizer: str, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text).

    formatted; and for each token, packed: ids (unsigned 32-bit), loss (one byte), loss_start and loss_end (32-bit,
    its part of a text under the loss, code points of formatted), loss_turn (32-bit, which of these texts).
    """
    small_batches(rows.sparkSession)

    def batch(held: list[tuple[int, list[tuple[str, str]]]]) -> pa.RecordBatch:
        done = [render(turns, loss_role) for _, turns in held]
        out = []
        for (conv, _), (text, spans), e in zip(held, done, _tokenizer(tokenizer).encode_batch([t for t, _ in done], add_special_tokens=False), strict=True):
            loss, low, high, turn = align(e.offsets, spans)
            out.append((None if conv == NOBODY else conv, text, np.array(e.ids, "<u4").tobytes(), loss.tobytes(), low.tobytes(), high.tobytes(), turn.tobytes()))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), *[pa.binary()] * 5], strict=True)], names=names)

    def chats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for conv, t in runs(batches, "key"):
            held.append((conv, [(r or "", x or "") for r, x in zip(t.column("role").to_pylist(), t.column("text").to_pylist(), strict=True)]))
            size += sum(len(x) for _, x in held[-1][1])
            if size > 1_000_000 or len(held) >= 500:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    keyed = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NOBODY)).alias("key"), "turn", "role", "text")
    return by_key(keyed, "key", chats, SCHEMA, "turn", "role", "text")


def digests(chats: DataFrame) -> DataFrame:
    """What each rendering and mask say, read back from them and digested."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                turns = parse(r["formatted"])
                loss = "".join(loss_texts(r["formatted"], r["loss"], r["loss_start"], r["loss_end"], r["loss_turn"]))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((r["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"])))
            if out:
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return chats.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
