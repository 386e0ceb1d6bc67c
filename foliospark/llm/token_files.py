"""Operator 4, token ids as binary segments: frequency-ranked ids in byte-aligned codes with separate control bytes.

A segment holds consecutive documents. Its ids are replaced by their rank of frequency over all of the segment, the rank
table goes into its head, and each rank takes 1 to 4 bytes; two control bits a rank tell how many, four ranks to a control
byte, apart from the data bytes. Frequent ids so take one byte. Segments are self-contained: no pass over the corpus comes
before encoding, memory is bounded by one segment, and a lost executor costs the segments of its tasks alone.

Segment, little-endian: magic "FTS1"; n_ids, n_docs, n_table, n_data (u32 each); table (u32 ids by rank); control bytes
(ceil(n_ids / 4)); data bytes; then n_docs times n_tokens (u32). The container is Parquet with one segment a row, as Spark
commits it to any store atomically: (part, seg, n_ids, doc_ids, body).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.bytebpe import UnitCoder, tokenizer_spec, worker_coder
from foliospark.llm.common import shared_dir, slices

MAGIC = b"FTS1"
HEAD = struct.Struct("<4s4I")

#: By control byte: where each of its four ranks begins among the group's data bytes, how long it is, and the group's length.
_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
LENGTHS = (_CODES + 1).astype(np.uint8)
STARTS = np.concatenate([np.zeros((256, 1), np.int64), np.cumsum(LENGTHS, axis=1)[:, :3]], axis=1).astype(np.uint8)
GROUP = LENGTHS.sum(axis=1).astype(np.uint8)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ids: np.ndarray, counts: list[int]) -> bytes:
    """A segment of ids (u4) of len(counts) documents with so many ids each."""
    seen = np.bincount(ids)  # ids are a vocabulary's, so this is small
    table = np.flatnonzero(seen)
    table = table[np.argsort(-seen[table], kind="stable")]
    rank = np.zeros(len(seen), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    ranks = rank[ids]
    codes = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-len(codes) % 4 + len(codes), np.uint8)
    padded[: len(codes)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    width = int(codes.max()) + 1 if len(codes) else 1
    data = raw[:, :width][np.arange(width) <= codes[:, None]]
    return b"".join((HEAD.pack(MAGIC, len(ids), len(counts), len(table), len(data)), table.astype("<u4").tobytes(), control.tobytes(), data.tobytes(), np.asarray(counts, "<u4").tobytes()))


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of a segment; lengths and places of the ranks come from the tables by control byte."""
    magic, n_ids, n_docs, n_table, n_data = HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("no token segment")
    at = HEAD.size
    table = np.frombuffer(body, "<u4", n_table, at)
    at += 4 * n_table
    control = np.frombuffer(body, np.uint8, -(-n_ids // 4), at)
    at += len(control)
    data = np.frombuffer(body, np.uint8, n_data, at)
    counts = np.frombuffer(body, "<u4", n_docs, at + n_data)
    if not n_ids:
        return np.empty(0, "<u4"), counts
    group = np.zeros(len(control), np.int64)
    np.cumsum(GROUP[control[:-1]], out=group[1:])
    starts = (group[:, None] + STARTS[control]).reshape(-1)[:n_ids]
    lengths = LENGTHS[control].reshape(-1)[:n_ids]
    four = np.concatenate([data, np.zeros(4, np.uint8)])
    ranks = four[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = lengths > k
        if not more.any():
            break
        ranks[more] |= four[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[ranks], counts


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, segment_ids: int = 1 << 20) -> None:
    """Write the ids of every whole text of docs to path, in ascending order of id_col, end_id after each document.

    One range shuffle puts documents in order; each task then encodes and packs segments of about segment_ids ids as it
    reads. Null text counts as empty; a null id sorts first; rows that repeat an id follow each other; other columns are
    neither read nor written, so names cannot clash; an empty table makes an empty container.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder = worker_coder(UnitCoder, spec.value)
        part, seg = TaskContext.get().partitionId(), 0
        ids, keys, held = [], [], 0
        schema = None

        def out():
            nonlocal seg, held
            body = pack(np.frombuffer(b"".join(ids), "<u4"), [len(x) // 4 for x in ids])
            row = [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([held], pa.int64()), pa.array([keys], pa.list_(schema)), pa.array([body], pa.binary())]
            ids.clear(), keys.clear()
            seg, held = seg + 1, 0
            return pa.RecordBatch.from_arrays(row, names=["part", "seg", "n_ids", "doc_ids", "body"])

        for batch in slices(batches):
            schema = batch.column(0).type
            for key, coded in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(coded + end)
                keys.append(key)
                held += len(ids[-1]) // 4
                if held >= segment_ids:
                    yield out()
        if keys:
            yield out()

    ordered = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    ordered.mapInArrow(run, f"part int, seg int, n_ids long, doc_ids array<{kind}>, body binary").write.mode("errorifexists").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the container at path: id_col, start, n_tokens, ids_crc32, and ids (array) if with_ids.

    start counts the ids of all documents before it: sums per part, and of the parts, and then inside the segment. The
    windows see one row per segment of a part, and one row per part, never documents.
    """
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = segments.select("part", "seg", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select(F.col("part").alias("p"), before(Window.partitionBy(F.lit(0)).orderBy("part")).alias("part_start"))
    starts = sizes.select("part", "seg", before(Window.partitionBy("part").orderBy("seg")).alias("in_part")).join(parts, F.col("part") == F.col("p")).select(F.col("p"), F.col("seg").alias("s"), (F.col("in_part") + F.col("part_start")).alias("seg_start"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, counts = unpack(batch.column(3)[k].as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                begins = ends - counts
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(counts)
                columns = [pa.repeat(batch.column(0)[k], n), pa.repeat(batch.column(1)[k], n), pa.array(begins), batch.column(2)[k].values, pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["part", "seg", "begin", "id", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                for at in range(0, n, 10_000):
                    yield pa.RecordBatch.from_arrays([c.slice(at, 10_000) for c in columns], names=names)

    # decoded where the segments lie; only the documents' few numbers meet the segments' starts
    read = segments.select("part", "seg", "doc_ids", "body").mapInArrow(run, f"part int, seg int, begin long, id {kind}, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    met = read.join(starts, (F.col("part") == F.col("p")) & (F.col("seg") == F.col("s")))
    return met.select(F.col("id").alias(id_col), (F.col("seg_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """write_token_files() to a new folder under the shared one, then read_token_files()."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, id_col, text_col, **options)
    return read_token_files(docs.sparkSession, path, id_col)
