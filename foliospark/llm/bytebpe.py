"""Exact byte-level BPE over large corpora: the tokenizers library behind a memo of text units.

A text is cut where a run of ASCII white space begins. No alternative of the byte-level pre-tokenizer's pattern
spans from a non-space into white space, so a pre-token always ends there and the units' ids joined are the text's
ids. The cut is made only in texts whose white space is all of space, tab, newline and carriage return; other texts,
and special tokens inside texts, go to the library as they are.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space in any reading but the four above, and the separators that only some engines hold for white space.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    　﻿]")


class UnitCoder:
    """Ids of whole texts. The memo has two generations of at most memo_size units: a full one becomes the old one."""

    def __init__(self, spec: str, memo_size: int = 450_000):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # a byte-level token's string has one character for each of its bytes
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(1 + max(vocabulary.values(), default=0), np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memo_size = memo_size

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def turn(self) -> None:
        if len(self.memo) > self.memo_size:
            self.old, self.memo = self.memo, {}

    def recall(self, units: set[str]) -> None:
        """Move what the old generation knows of units into the memo, and out of units."""
        known = [u for u in units if u in self.old]
        self.memo.update(zip(known, map(self.old.__getitem__, known), strict=True))
        units.difference_update(known)

    def learn(self, units: list[str]) -> None:
        """Put the library's ids of units into the memo.

        Units that begin with white space and hold more are encoded side by side in one call: each begins a pre-token
        there as well, and the tokens' byte lengths tell where its ids end.
        """
        inner = [u for u in units if u[0] in " \t\n\r" and u[-1] not in " \t\n\r"]
        for at in range(0, len(inner), 4096):
            part = inner[at : at + 4096]
            ids = np.asarray(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(u.encode()) for u in part])) + 1
            raw, begin = ids.tobytes(), 0
            for unit, end in zip(part, (4 * ends).tolist(), strict=True):
                self.memo[unit] = raw[begin:end]
                begin = end
        if len(inner) < len(units):
            rest = [u for u in units if u[0] not in " \t\n\r" or u[-1] in " \t\n\r"]
            for unit, coded in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.memo[unit] = np.asarray(coded.ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        return not ODD_SPACE.search(text) and not any(s in text for s in self.specials)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; none for null."""
        cut = [UNIT.findall(t) if t and self.plain(t) else None for t in texts]
        self.turn()
        if new := set(chain.from_iterable(filter(None, cut))).difference(self.memo):
            self.recall(new)
            self.learn(list(new))
        get = self.memo.__getitem__
        return [b"" if not t else self.whole(t) if units is None else b"".join(map(get, units)) for t, units in zip(texts, cut, strict=True)]


_CODERS: dict[tuple, object] = {}


def worker_coder(kind: type, spec: str):
    """One coder for each Python worker and tokenizer."""
    key = (kind, hash(spec))
    if key not in _CODERS:
        _CODERS[key] = kind(spec)
    return _CODERS[key]


def tokenizer_spec(path: str) -> str:
    """The tokenizer's file as text; its size is fixed (a vocabulary), so it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError(f"{path} is no vocabulary file: {len(spec)} characters")
    return spec
