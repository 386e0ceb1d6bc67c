"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts state it, for Java regular expressions.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine, for a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="foliospark-"))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, so that it is computed once and outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: settled(), but columnar, compressed and prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(delete_stored, spark)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_WRITTEN: list[str] = []


def delete_stored(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what stored() wrote for the frames, which nothing may read any more; without frames all that is left, as the program's end does."""
    paths = [f._stored_at for f in frames] or list(_WRITTEN)
    try:
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
            _WRITTEN.remove(path)
    except (Py4JError, OSError, AttributeError, TypeError):  # the session has ended before the program
        if frames:
            raise


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once per row even where body names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The array of words between ASCII white space; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 512):
    """Arrow batches cut to at most so many rows, so that Python objects of one slice stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges of longs; component is the smallest node reachable.

    Large-star and small-star rounds over DataFrames, written each round, until no edge changes. Nothing is collected. Minima are
    pre-aggregated before the shuffle and written before they are joined back, so that both sides are dealt for the join alone:
    a small table of minima is broadcast by its size, and of a larger one adaptive execution splits a hub's neighbours.
    Ends after about log(diameter) rounds; most_rounds only guards against a fault and raises.
    """
    links = stored(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct(), "links")
    total = _fingerprint(links)
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node is tied to the smallest of its neighbours and itself
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).union(links.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = stored(both.groupBy(F.col("x").alias("l")).agg(F.min("y").alias("m")).select("l", F.least("l", "m").alias("m")), "low")
        large = stored(both.where("y > x").join(low, F.col("x") == F.col("l")).select(F.col("y").alias("v"), F.col("m").alias("u")).distinct(), "large")
        delete_stored(edges.sparkSession, low, links)
        # small star: the smaller neighbours of a node, and it, are tied to the smallest of them
        low = stored(large.groupBy(F.col("v").alias("l")).agg(F.min("u").alias("m")), "low")
        sides = F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")))
        small = large.join(low, F.col("v") == F.col("l")).select(F.explode(sides).alias("e")).select("e.v", "e.u").where("u < v").distinct()
        links = stored(small, "links")
        delete_stored(edges.sparkSession, low, large)
        now = _fingerprint(links)
        if now == total:
            roots = links.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return links.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
        total = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _fingerprint(links: DataFrame) -> tuple:
    """Count and order-free checksum of the edges; two rounds with the same have the same edges."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)
