"""The driver's tables as the relations that the operators work on, with one mapping for all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, pos, line): documents cut at newlines, positions from 0."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, source_id, created_at, status) from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))


STATUS = "case when l_linestatus = 'F' then 'done' when l_returnflag = 'N' then 'pending' else 'failed' end"
PAGE = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)"
#: The same relation in DuckDB SQL.
RESOURCES_SQL = f"(select l_orderkey task_id, {PAGE} page, {STATUS} status, l_quantity::bigint size from lineitem)"


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, page, status, size) from lineitem; pages are numbered from 1 within a task."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("task_id"), F.expr(PAGE).alias("page"), F.expr(STATUS).alias("status"), F.col("l_quantity").cast("long").alias("size"))
