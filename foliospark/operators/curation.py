"""Cleaning of chapters' lines, with a log of every removal, and the passes over whole books.

Input is a relation of lines (keys, pos, line). Windows are per document; document frequencies shuffle distinct short lines
only, and the small set of repeated lines joins back (broadcast when Spark finds it small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.fixed_values import CJK, PUNCTUATION, RECOMMEND


def reused(df: DataFrame) -> DataFrame:
    """df computed once for several readers: checkpointed where the session names a shared folder, else persisted."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()


def spam_lines(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, line, n, total): lines that fill over 60 % of a document of 5 lines or more, at least 3 times."""
    counts = lines.groupBy(key, line).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("total", total).where((F.col("total") >= 5) & (F.col("n") >= 3) & (F.col("n") / F.col("total") > 0.6))


def adjacent_duplicates(lines: DataFrame, key: str) -> DataFrame:
    """Lines equal to the line before them."""
    return lines.withColumn("before", F.lag("line").over(Window.partitionBy(key).orderBy("pos"))).where(F.col("before") == F.col("line")).drop("before")


def clean_lines(lines: DataFrame, key: str, title: str | None = None) -> DataFrame:
    """Every line with `clean` (null where removed), `rule` of its removal (null where kept) and `review` (null or the review rule).

    In order: noise templates, lines that are an inline notice alone, addresses cut out, blank lines, the title; then the tail
    from the first recommendation at 60 % of the kept lines or later, lines that flood the document, and adjacent repeats.
    """
    t = lines.withColumn("__judged", T.judged_line(F.col("line")))
    t = t.withColumns({c: F.col("__judged")[c] for c in ("rule", "clean", "review")}).drop("__judged")
    if title:
        t = t.withColumn("rule", F.when(F.col("rule").isNull() & (F.col("clean") == T.normalize_line(T.strip_site_suffix(F.col(title)))), "章节标题").otherwise(F.col("rule")))
    doc = Window.partitionBy(key)
    upto = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alive = F.col("rule").isNull()
    t = t.withColumns({"k": F.count_if(alive).over(upto) - 1, "kept": F.count_if(alive).over(doc)})
    marker = alive & (F.col("k") >= F.col("kept") * 0.6) & T.full(F.col("clean"), RECOMMEND)
    t = t.withColumn("cut", F.min(F.when(marker, F.col("pos"))).over(doc))
    t = t.withColumn("rule", F.when(alive & (F.col("pos") >= F.col("cut")), "章末站点区块").otherwise(F.col("rule")))
    alive = F.col("rule").isNull()
    t = t.withColumn("kept", F.count_if(alive).over(doc)).withColumn("n", F.count_if(alive).over(Window.partitionBy(key, "clean")))
    t = t.withColumn("rule", F.when(alive & (F.col("kept") >= 5) & (F.col("n") >= 3) & (F.col("n") / F.col("kept") > 0.6), "章节刷屏").otherwise(F.col("rule")))
    alive = F.col("rule").isNull()
    before = F.last(F.when(alive, F.col("clean")), ignorenulls=True).over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("rule", F.when(alive & (before == F.col("clean")), "相邻重复").otherwise(F.col("rule")))
    return t.withColumn("clean", F.when(F.col("rule").isNull(), F.col("clean"))).drop("k", "kept", "cut", "n")


def removal_log(cleaned: DataFrame, key: str) -> DataFrame:
    """(key, pos, rule, raw): one row per removal and per line for review; blank lines go unlogged."""
    gone = cleaned.where("rule is not null and rule <> ''").select(key, "pos", "rule", F.col("line").alias("raw"))
    return gone.union(cleaned.where("review is not null").select(key, "pos", F.col("review").alias("rule"), F.col("line").alias("raw")))


def site_signatures(lines: DataFrame, book: str, chapter: str, totals: DataFrame) -> DataFrame:
    """(book, line, n): signature-shaped lines in at least 5 chapters and half of the book's total (column total of totals)."""
    found = lines.where(T.is_site_signature(F.col("line"))).select(book, chapter, "line").distinct()
    counts = found.groupBy(book, "line").agg(F.count("*").alias("n"))
    return counts.join(totals, book).where((F.col("n") >= 5) & (F.col("n") >= 0.5 * F.col("total"))).select(book, "line", "n")


def header_footer_lines(lines: DataFrame, book: str, chapter: str, ratio: float = 0.6, most: int = 30) -> DataFrame:
    """(book, line, n): lines of at most `most` characters in 3 or more chapters and over `ratio` of the book's."""
    chapters = lines.groupBy(book).agg(F.count_distinct(chapter).alias("total"))
    counts = lines.where(F.length("line") <= most).select(book, chapter, "line").distinct().groupBy(book, "line").agg(F.count("*").alias("n"))
    return counts.join(chapters, book).where((F.col("total") >= 3) & (F.col("n") >= 3) & (F.col("n") / F.col("total") > ratio)).select(book, "line", "n")


def drop_lines(lines: DataFrame, repeated: DataFrame, book: str) -> DataFrame:
    return lines.join(repeated.select(book, "line"), [book, "line"], "left_anti")


def article_code(text, paragraphs, link_density=None, title=None, continuation: bool = False):
    """The gate's verdict on an article, the first that holds: too_short, not_cjk_prose, looks_like_index_page, looks_like_word_soup, template_repeat, ok."""
    links = link_density if link_density is not None else F.lit(0.0)
    allowed = T.has_chapter_mark(title) if continuation and title is not None else F.lit(False)

    def code(body: Column) -> Column:
        """The verdict on the text without white space, which is made once."""
        size = F.length(body)
        share = lambda pattern: F.regexp_count(body, F.lit(pattern)) / size
        return (
            F.when((size == 0) | ((size < 200) & ~allowed), "too_short").when((size < 800) & (share(CJK) < 0.3), "not_cjk_prose").when(links > 0.25, "looks_like_index_page")
            .when(share(PUNCTUATION) < 0.01, "looks_like_word_soup").when(T.repeated_line_ratio(paragraphs) > 0.5, "template_repeat").otherwise("ok")
        )

    return T.let(T.dense(text), code)


def chapter_report(lines: DataFrame, ratio: float) -> DataFrame:
    """Per book: chapters, kept lines and characters, removed lines, and the histogram of rules, after cleaning and the header pass."""
    cleaned = reused(clean_lines(lines, "doc_id").select("source", "doc_id", "pos", "clean", "rule"))
    kept = cleaned.where("clean is not null").select("source", "doc_id", "pos", F.col("clean").alias("line"))
    repeated = header_footer_lines(kept, "source", "doc_id", ratio)
    final = drop_lines(kept, repeated, "source").groupBy("source").agg(F.count_distinct("doc_id").alias("chapters"), F.count("*").alias("kept_lines"), F.sum(F.length("line")).alias("characters"))
    rules = cleaned.where("rule is not null and rule <> ''").groupBy("source", "rule").agg(F.count("*").alias("n"))
    histogram = rules.groupBy("source").agg(F.sum("n").alias("removed_lines"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "n"))))).alias("removed_rules"))
    return final.join(histogram, "source", "left").select("source", "chapters", "kept_lines", "characters", F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"), F.coalesce("removed_rules", F.lit("{}")).alias("removed_rules"))


def chapter_block() -> Column:
    """A chapter's text of (heading, paragraphs, missing_reason, source_url)."""
    missing = F.array(F.col("heading"), F.concat(F.lit("［本章抓取失败："), "missing_reason", F.lit("］")), F.concat(F.lit("［地址："), "source_url", F.lit("］")))
    return F.array_join(F.when(F.col("missing_reason").isNotNull(), missing).otherwise(F.concat(F.array("heading"), F.col("paragraphs"))), "\n\n")


def render_txt(book: DataFrame, title: str) -> DataFrame:
    """(book, text) of (book, chapter, heading, paragraphs, missing_reason, source_url): a title, chapters three blank lines apart."""
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("chapter", chapter_block().alias("b")))), lambda x: x["b"])
    name = F.coalesce(F.nullif(T.strip(F.first(title)), F.lit("")), F.lit("未命名"))
    return book.groupBy("book").agg(F.concat(F.array_join(F.concat(F.array(name), blocks), "\n\n\n\n"), F.lit("\n")).alias("text"))


def render_txt_parts(book: DataFrame, title: str, size: int) -> DataFrame:
    """(book, part, text): render_txt's text in parts of `size` chapters, which joined in order give it whole, so that no row holds a book.

    Columns as for render_txt, and last: the number of the book's last chapter. Chapters are numbered from 1.
    """
    name = F.coalesce(F.nullif(T.strip(F.col(title)), F.lit("")), F.lit("未命名"))
    piece = F.concat(F.when(F.col("chapter") == 1, name).otherwise(""), F.coalesce(F.concat(F.lit("\n\n\n\n"), chapter_block()), F.lit("")), F.when(F.col("chapter") == F.col("last"), "\n").otherwise(""))
    parts = book.select("book", F.floor((F.col("chapter") - 1) / size).cast("long").alias("part"), "chapter", piece.alias("piece"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("chapter", "piece"))), lambda x: x["piece"])
    return parts.groupBy("book", "part").agg(F.array_join(pieces, "").alias("text"))


def ranged(rows: DataFrame, book: str, key: str) -> DataFrame:
    """rows ranged by book and key, with __slot, the number of their range: a book is dealt over many tasks, which hold its rows in order."""
    return reused(rows.repartitionByRange(book, key).withColumn("__slot", F.spark_partition_id()))


def numbered(docs: DataFrame, book: str, key: str, number: str = "chapter", last: str = "last") -> DataFrame:
    """docs with their place within the book by key, from 1, and the book's count; a book is dealt over many tasks.

    Within a range rows are counted, and the counts of the ranges before are added. All columns are shuffled, so texts are better
    joined by the key afterwards.
    """
    placed = ranged(docs, book, key)
    counts = placed.groupBy(book, "__slot").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(book)
    before = F.coalesce(F.sum("n").over(whole.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(book).alias("__book"), F.col("__slot").alias("__at"), before.alias("__before"), F.sum("n").over(whole).alias(last))
    ranked = placed.withColumn(number, F.row_number().over(Window.partitionBy(book, "__slot").orderBy(key)))
    joined = ranked.join(counts, ranked[book].eqNullSafe(counts["__book"]) & (ranked["__slot"] == counts["__at"]))
    return joined.withColumn(number, F.col(number) + F.col("__before")).drop("__book", "__at", "__slot", "__before")
