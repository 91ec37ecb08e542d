"""Token ids of whole texts, exactly as the `tokenizers` library gives them.

A byte-level BPE file of the library is also read as a table of ranks by a faster encoder with the same rule, where the
file is of that kind (merges in the order of ids). Texts made of printable ASCII, ASCII white space and Latin letters,
for which both split alike, go there; any other text, and any with a special token in it, goes to the library.
Both ways give the same ids (tests/llm/test_documents.py).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# The letters and the piece pattern of this family of byte-level BPE files, on the plain alphabet.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
PLAIN = rf"[\t\n\x0b\x0c\r\x20-\x7e{LETTERS}]*"
#: Longer texts go to the library: the other encoder looks at all of a run of white space from each of its places.
LONGEST = 1_000_000


def _byte_of() -> dict[str, int]:
    """The bytes that stand behind the printable characters of a byte-level file: visible ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """bytes of each token -> id, if merges come in the order of ids."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before, byte = told["model"], told.get("pre_tokenizer") or {}, _byte_of()
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or told.get("normalizer") or model.get("ignore_merges"):
        return None
    special = {t["content"] for t in told.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    order = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in order or order != sorted(order) or any(c not in byte for t in vocab for c in t):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """ids(texts): the ids of each text as bytes, little-endian, unsigned, of 32 bits or those of another type."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain, ranks = re.compile(PLAIN), _ranks(path)
        self.fast = tiktoken.Encoding("plain", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def narrow(self) -> str:
        """The smallest type that holds all ids."""
        return "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def _whole(self, texts: list[str], kind: str = "<u4") -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str], kind: str = "<u4") -> list[bytes]:
        plain = [self.fast is not None and len(t) <= LONGEST and bool(self.plain.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        other = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p], kind))
        return [np.array(self.fast.encode_ordinary(t), kind).tobytes() if p else next(other) for t, p in zip(texts, plain, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a Python worker."""
    return Encoder(path)
