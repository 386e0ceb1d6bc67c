"""Registered queries over streams, replayed from the events and resources relations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.sources import tables as S
from foliospark.streaming import settled as T

QUERIES, ORACLES = {}, {}
_ROWS = "task_id long, chapter long, page long, total long, status string"


def _folder(spark) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, one of this machine, for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="foliospark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_settled(spark, d):
    """Settled tasks by the stateful stream; equal to the batch query settled_chapters."""
    total = F.count("*").over(Window.partitionBy("task_id"))  # dealt as the pages were to be numbered
    rows = S.resources(spark, d).select(F.col("task_id").cast("long"), F.lit(1).cast("long").alias("chapter"), F.col("page").cast("long"), total.alias("total"), "status")
    folder = _folder(spark)
    rows.withColumn("part", F.pmod(F.hash("page"), F.lit(3))).write.partitionBy("part").parquet(f"{folder}/rows")
    written = spark.read.schema(f"{_ROWS}, part int").parquet(f"{folder}/rows")
    for part in range(3):  # one after another: the stream reads files by age, so that a task's pages come in both batches
        written.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
    files = len(spark.read.schema(_ROWS).parquet(f"{folder}/in").inputFiles())
    stream = T.settled_stream(T.replay(spark, f"{folder}/in", _ROWS, max(1, 2 * files // 3)))
    T.run_available(stream, f"{folder}/state", f"{folder}/out")
    return spark.read.schema(T.OUT).parquet(f"{folder}/out").select("task_id", "pages", "failed", "status")


QUERIES["stream_settled"] = stream_settled
ORACLES["stream_settled"] = f"select task_id, pages, failed, case when failed > 0 then 'failed' else 'done' end status from (select task_id, count(*) pages, count(*) filter (status = 'failed') failed, count(*) filter (status = 'done') done from {S.RESOURCES_SQL} group by 1) where done + failed = pages"


def paced_starts(spark, d):
    e = S.table(spark, d, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return T.paced(e.withColumn("at", F.col("at") + F.col("event_id") / 100000), "user_id", "at", 600.0).select("event_id", F.round(F.col("start") - 1704067200, 3).alias("start"))


QUERIES["paced_starts"] = paced_starts
ORACLES["paced_starts"] = """with recursive e as (select event_id, user_id, epoch(date_trunc('second', ts))::double + event_id / 100000 arr, row_number() over (partition by user_id order by epoch(date_trunc('second', ts)) + event_id / 100000) k from events),
  s as (select event_id, user_id, k, arr start from e where k = 1 union all select e.event_id, e.user_id, e.k, greatest(e.arr, s.start + 600) from s join e on e.user_id = s.user_id and e.k = s.k + 1) select event_id, round(start - 1704067200, 3) start from s"""
