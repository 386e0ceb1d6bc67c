"""Task and resource ledgers: counts, state transitions, merges, constraint checks. All shuffles are on the ledger's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAILURE_CODES = ("network", "invalid_image", "invalid_text", "blocked", "cancelled")


def page_counts(resources: DataFrame, *keys: str) -> DataFrame:
    """Pages, done and failed ones of each key."""
    return resources.groupBy(*keys).agg(
        F.count("*").alias("pages"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed")
    )


def finish_status(resources: DataFrame, key: str = "task_id") -> DataFrame:
    """Each task's end: done, partial or failed; null while a page is pending or downloading."""
    open_pages = F.count_if(F.col("status").isin("pending", "downloading"))
    done, pages = F.count_if(F.col("status") == "done"), F.count("*")
    status = F.when(open_pages > 0, None).when(done == pages, "done").when(done > 0, "partial").otherwise("failed")
    return resources.groupBy(key).agg(pages.alias("pages"), done.alias("done"), status.alias("finish"))


def settled_chapters(resources: DataFrame, key: str = "task_id") -> DataFrame:
    """Chapters whose pages are all done or failed; failed if any page is."""
    c = page_counts(resources, key)
    return c.where(F.col("done") + F.col("failed") == F.col("pages")).withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("done"))


def latest_wins(rows: DataFrame, keys: list[str], *newest_first) -> DataFrame:
    """One row per key: the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def contiguous_prefix(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows whose numbers run 1, 2, 3 ... without a gap from the start; numbers are distinct per key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return rows.withColumn("__place", place).where(F.col("__place") == F.col(number)).drop("__place")


def claim(resources: DataFrame, tasks: DataFrame) -> DataFrame:
    """Pending resources of running tasks as they look when claimed: downloading, one attempt more."""
    running = tasks.where("status = 'running'").select("task_id")
    met = resources.where("status = 'pending'").join(running, "task_id", "left_semi")
    return met.withColumns({"status": F.lit("downloading"), "attempts": F.col("attempts") + 1})


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of new whose key it lacks (of equal keys in new, one)."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def merge(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows replaced by changes of the same key, and new keys appended: a full outer join on the key."""
    t = table.select(*keys, F.struct(*table.columns).alias("__old"))
    c = changes.select(*keys, F.struct(*table.columns).alias("__new"))
    return t.join(c, keys, "full").select(F.coalesce("__new", "__old").alias("__row")).select("__row.*")


def transition(table: DataFrame, chosen, before: str, after: str) -> DataFrame:
    """table with status `after` where chosen holds and the status is `before`; `changed` tells which rows were affected."""
    hit = chosen & (F.col("status") == before)
    return table.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn("status", F.when(F.col("changed"), after).otherwise(F.col("status")))


def order_violations(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a manifest whose (chapter, page) does not rise strictly above the row before; rows come in column `seq`."""
    w = Window.partitionBy(key).orderBy("seq")
    now = F.struct(*order)
    return rows.withColumn("__before", F.lag(now).over(w)).where(F.col("__before").isNotNull() & (F.col("__before") >= now)).drop("__before")


def constraint_violations(resources: DataFrame) -> DataFrame:
    """Rows that the ledger's checks would refuse, with the first rule that fails."""
    rule = (
        F.when((F.col("chapter") < 1) | (F.col("page") < 1), "position")
        .when(~F.col("status").isin("pending", "downloading", "done", "failed"), "status")
        .when((F.col("status") == "done") & (F.col("sha256").isNull() | F.col("size").isNull()), "done needs a file")
        .when((F.col("status") == "failed") & ~F.coalesce(F.col("error_code").isin(*FAILURE_CODES), F.lit(False)), "failure code")
        .when(F.col("attempts") < 0, "attempts")
    )
    return resources.withColumn("rule", rule).where("rule is not null")


def first_missing(requested: DataFrame, known: DataFrame, key: str, pos: str) -> DataFrame:
    """The requested key of least position that known lacks, if any."""
    gone = requested.join(known.select(key).distinct(), key, "left_anti")
    return gone.orderBy(pos).limit(1)
