"""Operators of the shelf: searching, groups, reading progress, exports, checks of order and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import values as V


def search_books(books: DataFrame, search: str, title: str = "title", author: str = "author") -> DataFrame:
    """The books whose title or author holds the search (ASCII case aside, % and _ are wildcards); all for an empty one."""
    if not search:
        return books
    pattern = V.like_pattern(search)
    return books.where(F.lower(title).like(pattern) | F.lower(author).like(pattern))


def visible_books(books: DataFrame, group: str = "all", search: str = "") -> DataFrame:
    """Books (title, author, follow, update, group) that a view shows: updates, following, a group or all; then those whose title and author hold the search as it is."""
    shown = {"all": F.lit(True), "updates": F.col("update") > 0, "following": F.col("follow")}.get(group, F.col("group") == group)
    text = F.lower(F.concat(F.col("title"), F.lit(" "), F.coalesce("author", F.lit(""))))
    return books.where(shown & (text.contains(search.lower()) if search else F.lit(True)))


def checkable_follows(follows: DataFrame, books: DataFrame) -> DataFrame:
    return follows.join(books.select("book_id"), "book_id", "left_semi")


def zipped(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str) -> DataFrame:
    """a and b of each key side by side by place; `short` tells keys whose counts differ, which a strict caller refuses."""
    placed = lambda df, order: df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    met = placed(a, order_a).join(placed(b, order_b), [key, "place"], "full")
    missing = F.col(order_a).isNull() | F.col(order_b).isNull()
    return met.withColumn("short", F.max(missing.cast("int")).over(Window.partitionBy(key)) == 1)


def deletable_groups(groups: DataFrame, members: DataFrame, books: DataFrame) -> DataFrame:
    """(group_id, members, deletable): members that are still books; only a group without any may go."""
    live = members.join(books.select("book_id"), "book_id", "left_semi").groupBy("group_id").agg(F.count("*").alias("members"))
    out = groups.select("group_id").join(live, "group_id", "left").select("group_id", F.coalesce("members", F.lit(0)).alias("members"))
    return out.withColumn("deletable", F.col("members") == 0)


def saved_progress(progress: DataFrame, updates: DataFrame, books: DataFrame) -> DataFrame:
    """progress (book_id, position, percent, at) after updates (the same): those of known books that are sound replace what was, the newest winning."""
    sound = (F.length("position") <= 64) & F.col("percent").between(0, 1)
    new = updates.where(sound).join(books.select("book_id"), "book_id", "left_semi")
    both = progress.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    last = F.struct("new", "at", "position", "percent")
    return both.groupBy("book_id").agg(F.max(last).alias("x")).select("book_id", "x.position", "x.percent", "x.at")


def batch_summary(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """One row (deleted, freed, failures): of distinct wanted ids, what results (id, freed, error) say; failures are sorted by id."""
    met = wanted.select("id").distinct().join(results, "id", "left")
    failed = F.col("error").isNotNull() | F.col("freed").isNull()
    failures = F.array_join(F.sort_array(F.collect_list(F.when(failed, F.col("id")))).cast("array<string>"), ",")
    return met.agg(F.count_if(~failed).alias("deleted"), F.coalesce(F.sum(F.when(~failed, F.col("freed"))), F.lit(0)).alias("freed"), failures.alias("failures"))


def part_faults(pages: DataFrame, key: str) -> DataFrame:
    """The pages (place, source_index, part, missing) that break the order of parts, with why: a source falls back, a missing one has parts, or parts do not count from 1."""
    w = Window.partitionBy(key).orderBy("place")
    before, part, missing = F.lag("source_index").over(w), F.lag("part").over(w), F.lag("missing").over(w)
    same = F.col("source_index") == before
    expected = F.when(same, part + 1).otherwise(1)
    why = F.when(F.col("source_index") < before, "order").when(same & (missing | F.col("missing")), "missing").when(F.col("part") != expected, "part")
    return pages.withColumn("fault", why).where("fault is not null")


def series_order(links: DataFrame, key: str, order: str) -> DataFrame:
    """links (place, dom_place) of a series with their rank: auto and asc as they stand, desc turned round, dom by place in the page."""
    by = {"auto": F.asc("place"), "asc": F.asc("place"), "desc": F.desc("place"), "dom": F.asc(F.coalesce("dom_place", F.lit(0)))}[order]
    return links.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(by, "place")))


def kept_routes(routes: DataFrame, now: Column, most: int = 2000, days: int = 30) -> DataFrame:
    """routes (host, at) that are younger than `days`; of more than `most`, the newest."""
    young = routes.where(F.col("at") > now - F.expr(f"interval {days} days"))
    return young.orderBy(F.desc("at"), "host").limit(most)


def strips(pages: DataFrame, key: str, sample: int = 6) -> DataFrame:
    """(key, strip): whether the median of height by width of the first pages that have a width lies above 1.8."""
    k = F.row_number().over(Window.partitionBy(key).orderBy("page"))
    ratio = F.when((F.col("k") <= sample) & (F.col("width") > 0), F.col("height") / F.col("width"))
    return pages.withColumn("k", k).groupBy(key).agg(F.coalesce(F.median(ratio) > V.STRIP_ASPECT, F.lit(False)).alias("strip"))


def page_confidence(pages: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, confidence): the mean of a page's lines, 0 where it has none."""
    mean = lines.groupBy(key).agg(F.avg("confidence").alias("confidence"))
    return pages.select(key).distinct().join(mean, key, "left").select(key, F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def review_lines(lines: DataFrame) -> DataFrame:
    """Lines (text, confidence) that are to be read again, trimmed, with confidence to three places."""
    return lines.where((F.trim("text") != "") & (F.col("confidence") < V.REVIEW_BELOW)).withColumns({"text": F.trim("text"), "confidence": F.round("confidence", 3)})


def text_metadata(lines: DataFrame, key: str, first: int = 30) -> DataFrame:
    """(key, title, author) from header lines among the first ones (pos from 0), the last of each winning; null without one."""
    m = r"^\s*({})\s*[:：]\s*(.+?)\s*$"
    value = F.regexp_replace(F.regexp_extract("line", m.format("书名|作者"), 2), "^[《》]+|[《》]+$", "")
    found = lines.where(F.col("pos") < first)
    return found.groupBy(key).agg(*[F.max_by(value, F.when(F.col("line").rlike(m.format(name)), F.col("pos"))).alias(alias) for name, alias in (("书名", "title"), ("作者", "author"))])


def export_keys(exports: DataFrame, columns: list[str]) -> DataFrame:
    """exports with export_key: the SHA-256 of the columns as JSON with sorted keys."""
    return exports.withColumn("export_key", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))
