"""Operator 3, repeated passages by a sorted sparse suffix array.

Of all suffixes of the corpus only those at minimiser positions are kept: of every window of `least` words the suffix at
its least-hashed group of GRAM words, so equal windows keep the same one, wherever they stand. The kept suffixes are sorted
by their words (a range partition by the whole sort key, so that no phrase, however frequent, has to fit one task), and every
suffix is compared with its neighbours, those beyond a partition's ends included. Suffixes whose first GRAM words no neighbour
shares are dropped there. Neighbours that agree on all words of the windows that chose them match in full. Where neighbours
begin alike and differ later on, the match ends inside, to the left or to the right: there one suffix of each kind is
extended in both directions through its text, window by window, and a window is repeated if another kind has it too. The
matched windows of a document, merged, are its repeated passages.

Equality: the first GRAM words are compared as words; the rest of a stretch by a 64-bit digest among suffixes that begin
alike; extended windows by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import delete_stored, slices, stored

LEAST, GRAM = 50, 10
#: Bits of a stretch's length and of its minimiser's place in the packed column at.
BITS = 10
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASES = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


class Digests:
    """Digests of any stretch of a text's words, from sums of powers of a base modulo 2^64."""

    def __init__(self, words: list[bytes], base: int = _BASES[0], seed: int = 0):
        n = self.n = len(words)
        codes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words) if seed else map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        powers = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, base, np.uint64), out=powers[1:])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers[:-1], out=self.sums[1:])
        self.unshift = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64), out=self.unshift[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.unshift[begin] + (end - begin).astype(np.uint64))


def kept_suffixes(d: Digests, least: int) -> tuple[np.ndarray, ...]:
    """(first, last, place): for each kept suffix the windows of `least` words that chose it (by their starts) and its own place."""
    n_windows = d.n - least + 1
    starts = np.arange(d.n - GRAM + 1)
    grams = d.of(starts, starts + GRAM)
    choice = np.empty(n_windows, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, least - GRAM + 1)
    for at in range(0, n_windows, 4096):
        choice[at : at + 4096] = views[at : at + 4096].argmin(axis=1)
    choice += np.arange(n_windows)
    first = np.flatnonzero(np.append(True, choice[1:] != choice[:-1]))
    last = np.append(first[1:], n_windows) - 1
    return first, last, choice[first]


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash that tells rows of one id (or of null ids) with different texts apart."""
    return F.xxhash64(docs[id_col], docs[text_col].cast("string"))


def suffix_table(base: DataFrame, least: int) -> DataFrame:
    """(head, rest, id, r, at) of the kept suffixes of base (id, r, text): the first GRAM words, a digest of the stretch, the row, the packed place."""

    def run(batches):
        for batch in slices(batches, 256):
            rows, cols, heads = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                words = split_words(text)
                if len(words) < least:
                    continue
                d = Digests(words)
                first, last, place = kept_suffixes(d, least)
                heads += [b" ".join(words[p : p + GRAM]) for p in place.tolist()]
                cols.append((d.of(first, last + least) + (place - first).astype(np.uint64), (first << 2 * BITS) | ((last - first) << BITS) | (place - first)))
                rows.append(np.full(len(first), k))
            if rows:
                rest, at = (np.concatenate(c) for c in zip(*cols, strict=True))
                of = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(rest.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(at)], names=SUFFIX)

    return base.mapInArrow(run, f"head binary, rest long, id {base.schema['id'].dataType.simpleString()}, r long, at long")


SUFFIX = ["head", "rest", "id", "r", "at"]


def compared(suffixes: DataFrame) -> DataFrame:
    """(id, r, at, many, tip) of the suffixes that a neighbour of the sorted array touches.

    many: a neighbour agrees on the whole stretch. tip: the first or last suffix of its kind beside one of another kind with the same
    first words; at most two a kind. A partition's first and last suffix wait for the neighbours beyond, which are found among
    these ends alone: two rows a partition. Rows that repeat id and text are one: they are equal in all columns and adjacent.
    """
    kind = suffixes.schema["id"].dataType.simpleString()
    ordered = suffixes.repartitionByRange(*SUFFIX).sortWithinPartitions(*SUFFIX)

    def run(batches):
        part = TaskContext.get().partitionId()
        held = None  # the rows not yet judged: the last one, with its left neighbour's tests
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held[0], pa.Table.from_batches([batch])])
            rows = rows.combine_chunks()
            equal = lambda name: pc.equal(rows[name][1:], rows[name][:-1]).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            new = np.append(True, ~(equal("at") & equal("r") & equal("rest") & equal("head")))
            rows = rows.filter(pa.array(new))
            head = pc.equal(rows["head"][1:], rows["head"][:-1]).to_numpy(zero_copy_only=False).astype(bool)
            whole = head & pc.equal(rows["rest"][1:], rows["rest"][:-1]).to_numpy(zero_copy_only=False).astype(bool)
            left = (True, False, False) if held is None else held[1]  # whether a partition's first; same head and same stretch before
            yield from out(rows.slice(0, rows.num_rows - 1), left, head, whole, part, False)
            n = rows.num_rows
            held = rows.slice(n - 1), left if n == 1 else (False, bool(head[-1]), bool(whole[-1]))
        if held is not None:
            yield from out(held[0], held[1], np.zeros(1, bool), np.zeros(1, bool), part, True)

    def out(rows, left, head, whole, part, last):
        n = rows.num_rows
        if not n:
            return
        head_before, whole_before = np.append(left[1], head[: n - 1]), np.append(left[2], whole[: n - 1])
        many = whole_before | whole[:n]
        tip = (head_before & ~whole_before) | (head[:n] & ~whole[:n])
        first = np.zeros(n, bool)
        first[0] = left[0]
        end = first | last
        kept = np.flatnonzero(many | tip | end)
        if not len(kept):
            return
        of, edge = pa.array(kept), end[kept]
        cols = [rows[c].take(of).combine_chunks() for c in ("id", "r", "at")]
        blank = pa.array(~edge)
        edges = [pc.if_else(blank, pa.scalar(None, t), rows[c].take(of).combine_chunks()) for c, t in (("head", pa.binary()), ("rest", pa.int64()))]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in [*cols, pa.array(many[kept]), pa.array(tip[kept]), *edges]]
        cols += [pa.array(np.full(len(kept), part, np.int32)), pa.array(first[kept]), pa.array(np.full(len(kept), last))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "r", "at", "many", "tip", "head", "rest", "part", "first", "last"])

    fields = f"id {kind}, r long, at long, many boolean, tip boolean, head binary, rest long, part int, first boolean, last boolean"
    judged = stored(ordered.mapInArrow(run, fields), "compared")
    whole = Window.partitionBy(F.lit(0)).orderBy("part", F.col("last"), "at")  # two rows a partition
    ends = judged.where("first or last")
    for way, before in (("p", F.lag), ("n", F.lead)):
        ends = ends.withColumn(way + "_same", F.coalesce((before("part").over(whole) != F.col("part")) & before("head").over(whole).eqNullSafe(F.col("head")), F.lit(False)))
        ends = ends.withColumn(way + "_whole", F.col(way + "_same") & before("rest").over(whole).eqNullSafe(F.col("rest")))
    ends = ends.select(
        "id", "r", "at", (F.col("many") | F.col("p_whole") | F.col("n_whole")).alias("many"),
        (F.col("tip") | (F.col("p_same") & ~F.col("p_whole")) | (F.col("n_same") & ~F.col("n_whole"))).alias("tip"),
    )
    return judged.where("not first and not last").select("id", "r", "at", "many", "tip").union(ends)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, r, begin, end): the maximal runs of words [begin, end) of windows of `least` words that occur elsewhere too.

    Words stand between ASCII white space, A-Z in lower case. Elsewhere is another document or another place of the same one. r is a
    hash of id and text. A row per passage, none for documents without; null and short texts have none; rows that repeat an id
    (or null) with its text are one document, with another text another one; whole texts are read; an empty table
    gives no rows; other columns are not read, so names cannot clash.
    """
    if not GRAM < least <= GRAM + (1 << BITS):
        raise ValueError(f"least must lie between {GRAM + 1} and {GRAM + (1 << BITS)}")
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(docs[id_col].alias("id"), row_key(docs, id_col, text_col).alias("r"), docs[text_col].cast("string").alias("text"))
    suffixes = stored(suffix_table(base, least), "suffixes")
    near = stored(compared(suffixes), "near")
    first = F.shiftright("at", 2 * BITS)
    size = F.shiftright("at", BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
    stretches = near.where("many").select("id", "r", first.alias("begin"), (first + size + least).alias("end"))

    by_doc = near.where("tip").groupBy(F.col("id").alias("t_id"), F.col("r").alias("t_r")).agg(F.collect_set(F.struct("at", "many")).alias("tips"))
    joined = base.join(by_doc, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("r") == F.col("t_r"))).select("id", "r", "text", "tips")

    def extended(batches):
        for batch in slices(batches, 128):
            ids, starts, codes, settled = [], [], [], []
            for k, (text, tips) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = split_words(text)
                d, e = Digests(words), Digests(words, _BASES[1], 1)
                at = np.array(sorted({t["at"] for t in tips}), np.int64)
                done = {t["at"]: t["many"] for t in tips}
                first, size = at >> 2 * BITS, ((at >> BITS) & ((1 << BITS) - 1)) + 1
                start = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                ids.append(np.full(len(start), k)), starts.append(start), settled.append(np.repeat([done[a] for a in at.tolist()], size))
                codes.append((d.of(start, start + least), e.of(start, start + least)))
            if ids:
                of = pa.array(np.concatenate(ids))
                one, two = (np.concatenate(c).view(np.int64) for c in zip(*codes, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(x) for x in (np.concatenate(starts), one, two, np.concatenate(settled)))], names=["id", "r", "start", "one", "two", "many"])

    windows = stored(joined.mapInArrow(extended, f"id {kind}, r long, start long, one long, two long, many boolean"), "windows")
    place = F.struct("id", "r", "start")
    again = windows.groupBy("one", "two").agg(F.min(place).alias("low"), F.max(place).alias("high")).where(~F.col("low").eqNullSafe(F.col("high")))
    # written, so that both sides of the join are dealt for it alone and a hot window can be split there
    again = stored(again.select(F.col("one").alias("a_one"), F.col("two").alias("a_two")), "again")
    matched = windows.where("not many").join(again, (F.col("one") == F.col("a_one")) & (F.col("two") == F.col("a_two"))).select("id", "r", F.col("start").alias("begin"), (F.col("start") + least).alias("end"))

    # merge each document's runs
    turn = Window.partitionBy("id", "r").orderBy("begin", "end")
    before = F.max("end").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    runs = stretches.union(matched).withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("begin")).cast("long"))
    runs = runs.withColumn("run", F.sum("new").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = stored(runs.groupBy("id", "r", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select(F.col("id").alias(id_col), "r", "begin", "end"), "passages")
    delete_stored(docs.sparkSession, suffixes, near, windows, again)
    return out


def repeated_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document with a repeated passage: id, n_passages, n_repeated_words, longest and passages (sorted (begin, end)).

    Rows that repeat an id with different texts are documents of their own, with a row each.
    """
    found = repeated_passages(docs, id_col, text_col, least)
    size = F.col("end") - F.col("begin")
    out = found.groupBy(id_col, "r").agg(F.count("*").alias("n_passages"), F.sum(size).alias("n_repeated_words"), F.max(size).alias("longest"), F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("passages"))
    return out.drop("r")


def oracle(least: int = LEAST) -> str:
    """repeated_documents() of documents in DuckDB SQL, over all windows, with passages as JSON (doc_id unique)."""
    return rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, i, md5(array_to_string(ws[i + 1 : i + {least}], ' ')) s from (select doc_id, ws, unnest(range(len(ws) - {least - 1})) i from w where len(ws) >= {least})),
r as (select doc_id, i from (select *, count(*) over (partition by s) n from g) where n > 1),
f as (select *, (i - lag(i) over (partition by doc_id order by i) > {least}) is not false new from r),
k as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) run from f),
p as (select doc_id, min(i) b, max(i) + {least} e from k group by doc_id, run)
select doc_id, count(*) n_passages, sum(e - b)::BIGINT n_repeated_words, max(e - b) longest, '[' || string_agg('{{"begin":' || b || ',"end":' || e || '}}', ',' order by b) || ']' passages from p group by 1"""
