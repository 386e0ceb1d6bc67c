"""Operator 5, benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

Items are the index's documents. Impacts are BM25 weights divided by the item's weight of all its own terms, so a passage's
score is the share of the item that it holds. Items stand in blocks; each term's list has its blocks with their largest
impact. A passage's terms of least impact that together stay below the threshold cannot carry an item alone, so only other
lists are walked; blocks whose bound (what was met, plus all that was not walked) stays below the threshold are skipped,
then those whose summed block maxima do; the items of the rest are scored exactly. The tests run for all passages of a slice
at once. Items at or above the threshold are verified on their words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices, stored

WORD = re.compile(r"\w+")
SHINGLE = 5
K1, B = 1.2, 0.75
#: Words between question and answer for which passages leave room, whatever the item's length.
BETWEEN = 8
#: Items of one block, and bytes of item text in one index (more items are searched in further indexes).
BLOCK, INDEX_BYTES = 4, 16 << 20
#: Share of the threshold up to which lists of little impact stay unwalked, and cells up to which blocks are looked up directly.
UNWALKED, DIRECT = 0.7, 1 << 24
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingle_set(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of `size` words; of fewer words the one run that they are."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """The item's last sentence is its answer, what stands before it the question; of a single sentence the last quarter of words."""
    parts = [p for p in _SENTENCE.split(text) if WORD.search(p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) * 3 // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


class Statistics:
    """What BM25 and the passages take from all items: how many, their words, the longest, and in how many each word stands."""

    def __init__(self, texts: Iterable[str | None]):
        self.n = self.words = 0
        self.longest, self.df = 1, Counter()
        for text in texts:
            if words := words_of(text):
                self.n, self.words, self.longest = self.n + 1, self.words + len(words), max(self.longest, len(words))
                self.df.update(set(words))


class ItemIndex:
    """The block-max index of items [(id, text)], by the statistics of all items (of these if none are given); items without words are left out."""

    def __init__(self, items: list[tuple], threshold: float, of_all: Statistics | None = None):
        self.threshold = threshold
        of_all = of_all or Statistics(t for _, t in items)
        kept = [(i, t, words_of(t)) for i, t in items if words_of(t)]
        self.ids = [i for i, _, _ in kept]
        self.shingles = [shingle_set(w) for _, _, w in kept]
        split = [question_and_answer(t) for _, t, _ in kept]
        self.questions = [shingle_set(words_of(q)) for q, _ in split]
        self.long_question = [len(words_of(q)) >= SHINGLE for q, _ in split]  # shorter ones tell nothing alone
        self.answers = [Counter(words_of(a)) for _, a in split]
        self.length = 2 * (of_all.longest + BETWEEN)
        n = len(kept)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, _, ws in kept for w in ws}))}
        self.none = len(self.vocabulary)  # stands for any other word
        average = of_all.words / max(of_all.n, 1)
        self.n_blocks = -(-n // BLOCK)
        cells: dict[int, np.ndarray] = {}  # (term, block) -> impacts of the block's items
        for d, (_, _, ws) in enumerate(kept):
            weights = {}
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (of_all.n - of_all.df[w] + 0.5) / (of_all.df[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / average))
            own = sum(weights.values())
            for w, x in weights.items():
                cells.setdefault(self.vocabulary[w] * self.n_blocks + d // BLOCK, np.zeros(BLOCK, np.float32))[d % BLOCK] = x / own
        self.keys = np.array(sorted(cells), np.int64)
        self.cells = np.array([cells[k] for k in self.keys.tolist()], np.float32).reshape(-1, BLOCK)
        self.cell_max = self.cells.max(axis=1) if n else np.zeros(0, np.float32)
        terms = self.keys // max(self.n_blocks, 1)
        self.list_start = np.searchsorted(terms, np.arange(self.none + 2))
        self.list_max = np.zeros(self.none + 1, np.float32)
        np.maximum.at(self.list_max, terms, self.cell_max)
        self.direct = None  # cell by (term, block), where that table is small; keys are searched otherwise
        if (self.none + 1) * self.n_blocks <= DIRECT:
            self.direct = np.full((self.none + 1) * self.n_blocks, len(self.keys), np.int32)
            self.direct[self.keys] = np.arange(len(self.keys))
        self.cell_max = np.append(self.cell_max, np.float32(0))
        self.cells = np.concatenate([self.cells, np.zeros((1, BLOCK), np.float32)])

    def cells_at(self, rows: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Numbers of the cells of each row's terms in its block; one of no impact where there is none."""
        if self.direct is not None:
            return self.direct[rows * self.n_blocks + block[:, None]]
        key = rows.astype(np.int64) * self.n_blocks + block[:, None]
        cell = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[cell] == key, cell, len(self.keys))

    def passages(self, words: list[str]) -> np.ndarray:
        """Distinct term numbers of the text's overlapping passages, a row each; none fills up and stands for repeats."""
        step = self.length // 2
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(self.none)), np.int32, len(words))
        n = max(1, -(-(len(ids) - step) // step))
        padded = np.full((n + 1) * step, self.none, np.int32)
        padded[: len(ids)] = ids
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(padded, self.length)[::step], axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = self.none
        return rows

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all items at or above the threshold, for passages as term rows."""
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        least = self.threshold - 1e-5
        bound = self.list_max[rows]
        live = np.flatnonzero(bound.sum(axis=1) >= least)
        if not len(live) or not self.n_blocks:
            return empty
        rows, bound = rows[live], bound[live]
        order = np.argsort(bound, axis=1)
        rows, bound = np.take_along_axis(rows, order, 1), np.take_along_axis(bound, order, 1)
        skipped = np.cumsum(bound, axis=1) < UNWALKED * least
        rest = (bound * skipped).sum(axis=1)
        where, at = np.nonzero(~skipped & (bound > 0))
        terms = rows[where, at]
        begin, size = self.list_start[terms], self.list_start[terms + 1] - self.list_start[terms]
        cell = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        met, inverse = np.unique(np.repeat(where, size) * self.n_blocks + self.keys[cell] % self.n_blocks, return_inverse=True)
        bounds = np.bincount(inverse, self.cell_max[cell], len(met)) + rest[met // self.n_blocks]
        met = met[bounds >= least]
        out = []
        for part in np.array_split(met, max(1, len(met) // 4096)):
            p, block = part // self.n_blocks, part % self.n_blocks
            cell = self.cells_at(rows[p], block)
            ok = np.flatnonzero(self.cell_max[cell].sum(axis=1) >= least)
            scores = self.cells[cell[ok]].sum(axis=1)
            i, lane = np.nonzero(scores >= least)
            out.append((live[p[ok[i]]], block[ok[i]] * BLOCK + lane, scores[i, lane]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else empty

    def verify(self, passage: list[str], item: int) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's shingles and of its answer's words that the passage holds; a part of under five words is one run."""
        have, bag = shingle_set(passage), Counter(passage)

        def share(part):
            if not part:
                return 1.0
            size = len(next(iter(part)))
            return len(part & (have if size == SHINGLE else shingle_set(passage, size))) / len(part)

        answer = self.answers[item]
        met = sum(min(n, bag[w]) for w, n in answer.items()) / max(1, answer.total())
        return share(self.shingles[item]), share(self.questions[item]), met if answer else 1.0


def indexes(items: DataFrame, item_col: str, text_col: str, threshold: float) -> Iterator[ItemIndex]:
    """Indexes of INDEX_BYTES of item text each, by the statistics of all items.

    Items are read twice, row by row: the driver holds one index at a time, and the words' counts.
    """
    rows = items.select(item_col, F.col(text_col).cast("string"))
    of_all = Statistics(r[1] for r in rows.toLocalIterator())
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= INDEX_BYTES:
            yield ItemIndex(held, threshold, of_all)
            held, size = [], 0
    if held:
        yield ItemIndex(held, threshold, of_all)


def each_index(shared: list) -> Iterator[ItemIndex]:
    """The broadcast indexes one by one: a single one stays with the worker, of several one at a time is read from its local file."""
    if len(shared) == 1:
        yield shared[0].value
    else:
        for b in shared:
            yield b.load_from_path(b._path)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = 0.6, overlap: float = 0.8, answer_overlap: float = 0.5,
) -> DataFrame:
    """(id, item, score, overlap, question_overlap, answer_overlap, word): the items that a document holds, with its best passage.

    Passages are twice the longest item and BETWEEN words long and overlap by half, so each item lies whole in one. An item is held if a passage
    scores threshold, has `overlap` of the five-word shingles of the item, or of its question if that has
    five words or more (words may stand between question and answer), and `answer_overlap` of its answer's words. An item of under five words is
    held where its words stand as one run. Texts are read whole; null and wordless texts and items hold nothing; repeated rows report each; an empty table gives no rows; other
    columns are not read, so names cannot clash. The documents are scanned once, each batch against one index after another, and
    nothing is shuffled; what is found is written, after which the broadcast indexes go.
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, score double, overlap double, question_overlap double, answer_overlap double, word long"
    base = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    shared = [spark.sparkContext.broadcast(index) for index in indexes(items, item_col, item_text_col, threshold)]

    def held(index, batch):
        texts = [words_of(t) for t in batch.column(1).to_pylist()]
        full = [k for k, words in enumerate(texts) if words]
        if not full or not index.n_blocks:
            return
        rows = [index.passages(texts[k]) for k in full]
        doc = np.repeat(full, [len(r) for r in rows])
        place = np.concatenate([np.arange(len(r)) for r in rows]) * (index.length // 2)
        best: dict[tuple[int, int], tuple] = {}
        for p, item, score in zip(*(x.tolist() for x in index.search(np.concatenate(rows))), strict=True):
            k, at = int(doc[p]), int(place[p])
            shares = index.verify(texts[k][at : at + index.length], item)
            if (shares[0] >= overlap or index.long_question[item] and shares[1] >= overlap) and shares[2] >= answer_overlap:
                best[k, item] = max(best.get((k, item), (0.0,)), (*shares[:1], score, *shares[1:], at))
        if best:
            ids = batch.column(0).to_pylist()
            cols = list(zip(*((ids[k], index.ids[i], s, o, q, a, at) for (k, i), (o, s, q, a, at) in best.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out_types(batch.column(0).type, index.ids), strict=True)], names=NAMES)

    def run(batches):
        for batch in batches:
            for index in each_index(shared):
                for part in slices([batch], 64):
                    yield from held(index, part)

    found = stored(base.mapInArrow(run, schema), "contamination")
    for b in shared:
        b.destroy()
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "overlap", "question_overlap", "answer_overlap", "word")


NAMES = ["id", "item", "score", "overlap", "question_overlap", "answer_overlap", "word"]


def out_types(id_type: pa.DataType, item_ids: list) -> list:
    return [id_type, pa.array(item_ids).type, *[pa.float64()] * 4, pa.int64()]


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with its columns, whose id has no item by contamination(). Columns of docs may have any names."""
    held = contamination(docs, items, id_col, text_col, **options).select(F.col(id_col).alias("held")).distinct()
    held = stored(held, "held")  # of known size: broadcast where small
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"))
    return rows.join(held, rows["id"].eqNullSafe(held["held"]), "left_anti").select("row.*")
