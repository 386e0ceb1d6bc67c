"""Greedy packing of a book's chapters into volumes, over ranges of the book.

A greedy cut depends on all chapters before it, but a range needs little of them: how full the open volume is on entry. That
decides the first chapter of the range which no longer fits; from each such chapter on the range's cuts are its own. So every
range states its outcome for each chapter that may be first, a short fold over the ranges of a book finds how each is entered,
and the ranges number their chapters. No task holds a book.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.curation import ranged


def first_unfit(sums: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """For volumes that begin at starts: the chapter after their last. sums are the sizes' prefix sums, from 0.

    A volume's first chapter of any size belongs to it, whatever its size; empty chapters before that one do not fill a volume.
    """
    begun = np.searchsorted(sums, sums[starts], side="right")  # one past the first chapter with a size
    full = np.searchsorted(sums, sums[starts] + limit, side="right") - 1
    return np.minimum(np.maximum(full, begun), len(sums) - 1)


def entered(sums: np.ndarray, used: int, limit: int) -> int:
    """The first chapter that does not fit a volume that holds `used` on entry."""
    return int(first_unfit(sums, np.zeros(1, np.int64), limit)[0]) if not used else int(np.searchsorted(sums[1:], limit - used, side="right"))


def outcomes(sizes: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int], int]:
    """(sums, volumes, left, total) of a range: sums up to the last chapter that may be the first not to fit; for a volume begun at each
    of those chapters the volumes begun from there to the end, and what the last of them holds; and the range's whole size."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    after = first_unfit(sums, np.arange(n), limit)
    volumes, left = np.ones(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            volumes[i], left[i] = volumes[after[i]] + 1, left[after[i]]
        else:
            left[i] = sums[n] - sums[i]
    most = min(int(after[0]) + 1, n)
    return sums[: most + 1].tolist(), volumes[:most].tolist(), left[:most].tolist(), int(sums[n])


def pack_by_size(chapters: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """(key, order, size, volume): greedy volumes of at most `limit`; a chapter beyond it stands alone. Sizes are 0 or more, null counts 0.

    Null keys are one book; chapters of equal order stand in any order; an empty table gives no rows.
    """
    rows = chapters.select(F.col(key).alias("book"), F.col(order).alias("place"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    placed = ranged(rows, "book", "place")

    def state(t: pd.DataFrame) -> pd.DataFrame:
        sums, volumes, left, total = outcomes(t.sort_values("place", kind="stable")["size"].to_numpy(np.int64), limit)
        return pd.DataFrame({"book": t["book"].iloc[:1], "slot": t["__slot"].iloc[:1], "sums": [sums], "volumes": [volumes], "left": [left], "total": [total]})

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        used, volume, found = 0, 1, []
        for r in t.sort_values("slot").itertuples(index=False):
            found.append((r.book, r.slot, used, volume))
            at = entered(np.asarray(r.sums, np.int64), used, limit)
            if at < len(r.volumes):
                used, volume = int(r.left[at]), volume + int(r.volumes[at])
            else:
                used += r.total
        return pd.DataFrame(found, columns=["e_book", "e_slot", "used", "volume"])

    def number(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("place", kind="stable")
        sums = np.concatenate([[0], np.cumsum(t["size"].to_numpy(np.int64))])
        cut, cuts = entered(sums, int(t["used"].iloc[0]), limit), np.zeros(len(t), np.int64)
        while cut < len(t):
            cuts[cut] = 1
            cut = int(first_unfit(sums, np.array([cut]), limit)[0])
        return t[["book", "place", "size"]].assign(volume=(np.cumsum(cuts) + t["volume"].iloc[0]).astype(np.int32))

    states = placed.groupBy("book", "__slot").applyInPandas(state, f"book {kinds['book']}, slot int, sums array<long>, volumes array<long>, left array<long>, total long")
    entries = states.groupBy("book").applyInPandas(fold, f"e_book {kinds['book']}, e_slot int, used long, volume int")
    met = placed.join(entries, placed["book"].eqNullSafe(entries["e_book"]) & (placed["__slot"] == entries["e_slot"]))
    done = met.groupBy("book", "__slot").applyInPandas(number, f"book {kinds['book']}, place {kinds['place']}, size long, volume int")
    return done.select(F.col("book").alias(key), F.col("place").alias(order), F.col("size").alias(size), "volume")
