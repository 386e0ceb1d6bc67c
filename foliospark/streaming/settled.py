"""Structured Streaming over job events: settled units, exactly once; progress on change; per-host pacing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "task_id long, chapter long, pages long, failed long, status string"


# Groups of chapters that share a state. A stream keeps the number it was started with.
BUCKETS = 4096
# Lists of reported chapters in a bucket's state beyond which they are joined into one.
LISTS = 32
# What a row says of its page.
OPEN, DONE, FAILED = 0, 1, 2


def _pack(rows: np.ndarray) -> bytes:
    """Rows by columns, whose numbers are alike, and compressed."""
    return zlib.compress(np.ascontiguousarray(rows.T, np.int64).tobytes(), 1)


def _unpack(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64).reshape(width, -1).T


def _first_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """rows sorted by their first columns, of which width are the key; of equal keys the first row."""
    rows = rows[np.lexsort(rows[:, :width].T[::-1])]  # a stable sort
    return rows[_heads(rows[:, :width])]


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted keys."""
    head = np.ones(len(keys), bool)
    head[1:] = (keys[1:] != keys[:-1]).any(1)
    return head


def _listed(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each row of keys whether known has it."""
    if not len(keys) or not len(known):
        return np.zeros(len(keys), bool)
    both = np.concatenate([known, keys])
    order = np.lexsort(both.T[::-1])
    group = np.cumsum(_heads(both[order]))
    place = np.empty(len(both), np.int64)
    place[order] = group
    hit = np.zeros(len(both) + 1, bool)
    hit[place[: len(known)]] = True
    return hit[place[len(known) :]]


class SettledChapters(StatefulProcessor):
    """State of a bucket of chapters: the ended pages of those not settled, and which were reported.

    Rows need (task_id, chapter, page, total, ended). Each page reaches its end once; a page that repeats is counted once, as its
    number is kept until the chapter settles. A bucket's rows are taken together: a call to the state store costs a round trip,
    which a state per chapter would pay several times for every chapter.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getValueState("pages", "rows binary")
        self.reported = handle.getListState("reported", "chapters binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = np.concatenate([pdf[["task_id", "chapter", "page", "total", "ended"]].to_numpy(np.int64) for pdf in rows])
        lists = [_unpack(bytes(x[0]), 2) for x in self.reported.get()]
        new = new[~_listed(new[:, :2], np.concatenate(lists) if lists else new[:0, :2])]
        if not len(new):
            return
        before = _unpack(bytes(self.pages.get()[0]), 4) if self.pages.exists() else new[:0, :4]
        ended = new[new[:, 4] != OPEN]
        pages = _first_rows(np.concatenate([before, np.column_stack([ended[:, :3], ended[:, 4] == FAILED])]), 3)
        totals = new[np.lexsort((-new[:, 3], new[:, 1], new[:, 0]))]
        totals = totals[_heads(totals[:, :2])][:, [0, 1, 3]]  # the chapters of this batch, each with its largest total

        head = np.flatnonzero(_heads(pages[:, :2]))
        seen, failed = np.diff(np.append(head, len(pages))), np.add.reduceat(pages[:, 3], head) if len(head) else np.empty(0, np.int64)
        chapters = pages[head, :2]
        met = _listed(chapters, totals[:, :2])
        total = np.zeros(len(chapters), np.int64)
        total[met] = totals[_listed(totals[:, :2], chapters), 2]  # both are sorted
        settled = met & (total > 0) & (seen >= total)
        if len(ended) or settled.any():
            self.pages.update((_pack(pages[~np.repeat(settled, seen)]),))
        if settled.any():
            if len(lists) < LISTS:
                self.reported.appendValue((_pack(chapters[settled]),))
            else:
                self.reported.put([(_pack(np.concatenate([*lists, chapters[settled]])),)])
            ids = [pd.array([None] * len(x) if null else x, "Int64") for x, null in zip(chapters[settled].T, key[1:], strict=True)]
            lost = failed[settled]
            yield pd.DataFrame({"task_id": ids[0], "chapter": ids[1], "pages": seen[settled], "failed": lost, "status": np.where(lost > 0, "failed", "done")})

    def close(self) -> None:
        pass


def settled_stream(events: DataFrame) -> DataFrame:
    """A row per chapter in the batch in which its last page ends, and never again, restarts included.

    events: (task_id, chapter, page, total, status); a bucket's state and its rows of one batch must fit a task's memory.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ended = F.when(F.col("status") == "done", DONE).when(F.col("status") == "failed", FAILED).otherwise(OPEN)
    bucket = F.pmod(F.xxhash64("task_id", "chapter"), F.lit(BUCKETS)).cast("int")
    nulls = [F.col(c).isNull().alias(f"no_{c}") for c in ("task_id", "chapter")]
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    rows = events.select(bucket.alias("bucket"), *nulls, number("task_id"), number("chapter"), F.col("page").cast("long"), number("total"), ended.cast("long").alias("ended"))
    return rows.groupBy("bucket", "no_task_id", "no_chapter").transformWithStateInPandas(SettledChapters(), OUT, "append", "none")


def progress_stream(events: DataFrame) -> DataFrame:
    """Running (done, failed, total) per task, in update mode: Spark emits a task only in batches that touch it."""
    return events.groupBy("task_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))


def run_available(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Write all that is available to Parquet; with the same checkpoint a later call goes on where this one ended."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def upsert_batches(stream: DataFrame, checkpoint: str, write) -> None:
    """Call write(batch, batch_id) for every batch once; write must ignore a batch_id that it has seen."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def replay(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def paced(arrivals: DataFrame, host: str, at: str, interval: float) -> DataFrame:
    """arrivals with `start`, the earliest time that keeps `interval` between starts of a host.

    start_i = max(arrival_i, start_(i-1) + interval) unrolls to i * interval plus the running maximum of arrival_j - j * interval:
    a window instead of a fold.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(host).orderBy(at)
    k = (F.row_number().over(w) - 1) * F.lit(interval)
    t = arrivals.withColumn("__slack", F.col(at) - k).withColumn("__k", k)
    start = F.max("__slack").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__k")
    return t.withColumn("start", start).drop("__slack", "__k")


def backoff(attempt: Column, jitter: Column) -> Column:
    """Seconds before a retry: min(8, 0.6 * 2^n) times 0.6 to 1.4 by jitter in 0..1."""
    return F.least(F.lit(8.0), F.lit(0.6) * F.pow(F.lit(2.0), attempt)) * (F.lit(0.6) + F.lit(0.8) * jitter)
