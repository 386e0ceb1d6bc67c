"""Operator 7, token counts by the whole-token shortcut.

Offline, each vocabulary string is tried alone: those that the library encodes as their own single token form the
whole-token table. Online, texts are cut into pre-tokens; one found in the table counts 1 with no merging, and only
the rest is merged by the library. Counts of text units (see bytebpe) are kept in a bounded memo per worker.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.bytebpe import UNIT, UnitCoder, tokenizer_spec, worker_coder
from foliospark.llm.common import arrow_batch, slices

#: The byte-level pre-tokenizer's pattern for ASCII text.
ASCII_PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

SCHEMA = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def whole_tokens(spec: str) -> dict[str, int]:
    """The vocabulary strings that are one pre-token and that the library encodes alone as that one token, each with 1."""
    library = UnitCoder(spec).library
    strings = {library.decode([i], skip_special_tokens=False): i for i in json.loads(spec)["model"]["vocab"].values()}
    ascii_only = [s for s in strings if s and s.isascii() and ASCII_PIECES.findall(s) == [s]]
    coded = library.encode_batch_fast(ascii_only, add_special_tokens=False)
    return {s: 1 for s, c in zip(ascii_only, coded, strict=True) if c.ids == [strings[s]]}


class UnitCounter(UnitCoder):
    """Token counts of units instead of their ids."""

    def __init__(self, spec: str):
        super().__init__(spec, memo_size=500_000)
        self.wholes = whole_tokens(spec)

    def learn(self, units: list[str]) -> None:
        pieces = [ASCII_PIECES.findall(u) if u.isascii() else [u] for u in units]
        rest = list({p for ps in pieces for p in ps if p not in self.wholes})
        merged = {p: len(c.ids) for p, c in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        for unit, ps in zip(units, pieces, strict=True):
            self.memo[unit] = sum(self.wholes.get(p) or merged[p] for p in ps)

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [UNIT.findall(t) if t and self.plain(t) else None for t in texts]
        self.turn()
        memo = self.memo
        if new := set(chain.from_iterable(filter(None, cut))).difference(memo):
            self.recall(new)
            self.learn(list(new))
        return [0 if not t else len(self.whole(t)) // 4 if units is None else sum(map(memo.__getitem__, units)) for t, units in zip(texts, cut, strict=True)]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: id_col, n_bytes (UTF-8), n_tokens (as the library gives them), over_limit (n_tokens > limit).

    tokenizer: path of a byte-level tokenizers .json file, read on the driver alone. Null text counts as empty (0 bytes,
    0 tokens); rows that repeat stay repeated; columns other than the two named are neither read nor returned, so their
    names cannot clash; an empty table gives no rows. A narrow map: no shuffle, memory bounded by a slice of rows.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(tokenizer))
    kind = docs.schema[id_col].dataType

    def run(batches):
        coder = worker_coder(UnitCounter, spec.value)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            counts = arrow_batch(SCHEMA, n_bytes=sizes, n_tokens=coder.count(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts.columns], names=["id", "n_bytes", "n_tokens"])

    counted = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return counted.selectExpr(f"id as `{id_col}`", "n_bytes", "n_tokens", f"n_tokens > {int(limit)} as over_limit")
