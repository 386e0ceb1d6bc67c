"""Link relations: deduplication orders, URL families, parallel sources, ranges, chapter order, volumes and packing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions import urls as U
from foliospark.functions.fixed_values import NAV_WORDS
from foliospark.operators.curation import numbered, ranged

MAX_CHAPTER = 20_000


def dedup_first_value_last_position(rows: DataFrame, page: str, key: str, pos: str) -> DataFrame:
    """Of rows with equal key the last position, with the values of the last row met when read backwards first: the last row."""
    rank = F.row_number().over(Window.partitionBy(page, key).orderBy(F.desc(pos)))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dedup_last_value_first_position(rows: DataFrame, page: str, key: str, pos: str, value: str) -> DataFrame:
    """Of rows with equal key the first position with the last row's value."""
    w = Window.partitionBy(page, key).orderBy(pos)
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(value, last).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def dedup_first(rows: DataFrame, page: str, key: str, pos: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(page, key).orderBy(pos))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def modal_group(links: DataFrame, page: str = "page", pos: str = "pos", url: str = "url") -> DataFrame:
    """The links of each page's largest URL family (of equal ones the first seen); pages of under 3 links stay, families of one go."""
    whole = Window.partitionBy(page)
    family = Window.partitionBy(page, "__family")
    t = links.withColumn("__family", U.signature(F.col(url)))
    t = t.withColumns({"__all": F.count("*").over(whole), "__n": F.count("*").over(family), "__first": F.min(pos).over(family)})
    t = t.withColumn("__best", F.max(F.struct("__n", -F.col("__first"))).over(whole))
    best = F.struct("__n", -F.col("__first")) == F.col("__best")
    keep = (F.col("__all") < 3) | (F.col("__n") == F.col("__all")) | (best & (F.col("__n") >= 2))
    return t.where(keep).drop("__family", "__all", "__n", "__first", "__best")


def pick_source(links: DataFrame, page: str = "page", pos: str = "pos", url: str = "url", title: str = "title") -> DataFrame:
    """One of a catalogue's parallel sources: the first place of digits in the path that deals the links into 2 to 8 groups of 3 or
    more, at least half of whose titles the largest group has, keeps the largest group (of equal ones the first seen)."""
    runs = F.regexp_extract_all(U.path(F.col(url)), F.lit(r"(\d+)"), F.lit(1))
    t = links.withColumn("__runs", runs)
    fit = t.groupBy(page).agg(F.count("*").alias("__all"), F.min(F.size("__runs")).alias("__low"), F.max(F.size("__runs")).alias("__high"))
    fit = fit.where((F.col("__all") >= 6) & (F.col("__low") == F.col("__high")) & (F.col("__low") >= 2)).select(F.col(page).alias("__page"))
    long = t.join(fit, F.col(page) == F.col("__page")).select(page, pos, title, F.posexplode("__runs").alias("slot", "value"))
    groups = long.groupBy(page, "slot", "value").agg(F.count("*").alias("n"), F.min(pos).alias("first"), F.collect_set(title).alias("titles"))
    slot = Window.partitionBy(page, "slot")
    groups = groups.withColumns({"groups": F.count("*").over(slot), "least": F.min("n").over(slot), "lead": F.max(F.struct("n", -F.col("first"), "titles", "value")).over(slot)})
    shared = F.size(F.array_intersect("titles", "lead.titles")) * 2 >= F.col("n")
    good = groups.groupBy(page, "slot").agg(F.bool_and(shared & F.col("groups").between(2, 8) & (F.col("least") >= 3)).alias("ok"), F.first("lead.value").alias("value")).where("ok")
    choice = good.groupBy(page).agg(F.min_by("value", "slot").alias("__value"), F.min("slot").alias("__slot")).withColumnRenamed(page, "__page2")
    met = t.join(choice, F.col(page) == F.col("__page2"), "left")
    return met.where(F.col("__value").isNull() | (F.get("__runs", "__slot") == F.col("__value"))).drop("__runs", "__page2", "__value", "__slot")


def sort_chapters(links: DataFrame, page: str = "page", pos: str = "pos", number: str = "number") -> DataFrame:
    """Links with `place`: by number where a page's links all have distinct numbers, else in page order."""
    whole = Window.partitionBy(page)
    t = links.withColumn("__ok", (F.count(number).over(whole) == F.count("*").over(whole)) & (F.size(F.collect_set(number).over(whole)) == F.count("*").over(whole)))
    key = F.when(F.col("__ok"), F.col(number).cast("long")).otherwise(F.col(pos).cast("long"))
    return t.withColumn("place", F.row_number().over(whole.orderBy(key))).drop("__ok")


def discover_chapters(anchors: DataFrame, limit: int = 2000) -> DataFrame:
    """(page, place, title, url, number): the chapters of a page's anchors (page, base, pos, url absolute, title, in_list).

    Navigation, other origins, categories and namespaces are refused; titles with a chapter mark are strong, links in a list
    whose path has a digit weak; two strong ones outweigh the weak. Then the last of repeats, the modal family, one source, order.
    """
    url, title = F.col("url"), T.collapse(F.col("title"))
    number = T.chapter_number(title)
    a = anchors.withColumn("title", title).withColumn("number", number)
    a = a.where(U.is_usable(url) & U.same_origin(F.col("base"), url) & ~U.is_namespace(url) & ~U.is_category(url))
    a = a.where((F.col("title") != "") & (F.length("title") <= 60) & ~F.col("title").isin(*NAV_WORDS) & (F.col("number").isNotNull() | (T.classify_next(F.col("title")) == "none")))
    a = a.withColumn("strong", F.col("number").isNotNull() | T.has_chapter_mark(F.col("title")))
    a = a.withColumn("n_strong", F.count_if("strong").over(Window.partitionBy("page")))
    weak = ~F.col("strong") & F.col("in_list") & U.path(url).rlike("[0-9]")
    a = a.where(F.when(F.col("n_strong") >= 2, F.col("strong")).otherwise(weak)).drop("strong", "n_strong", "in_list", "base")
    chosen = pick_source(modal_group(dedup_first_value_last_position(a, "page", "url", "pos")))
    return sort_chapters(chosen).where(F.col("place") <= limit).select("page", "place", "title", "url", "number")


_SEGMENT = re.compile(r"([0-9]+)(?:-([0-9]*))?")


def parse_ranges(text: str) -> list[tuple[int, int | None]]:
    """Segments of 1-10,15-20,200-; raises ValueError for what is empty, reversed, repeated, out of 1..20000 or open before the end."""
    if not text.strip() or len(text) > 200:
        raise ValueError("empty or too long a range")
    out: list[tuple[int, int | None]] = []
    for piece in text.split(","):
        m = _SEGMENT.fullmatch(piece.strip())
        if not m:
            raise ValueError(f"no range: {piece!r}")
        low = int(m[1])
        high = low if m[2] is None else int(m[2]) if m[2] else None
        if not 1 <= low <= MAX_CHAPTER or (high is not None and not low <= high <= MAX_CHAPTER):
            raise ValueError(f"out of range or reversed: {piece!r}")
        for a, b in out:
            if b is None or (high is None and low <= max(e or 0 for _, e in out)) or (high is not None and a <= high and low <= b):
                raise ValueError(f"repeated: {piece!r}")
        out.append((low, high))
    return out


def select_ranges(spark: SparkSession, items: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """The items whose index lies in a segment, with `place` in the order of segments: a range join on the parsed, short list.

    An open segment goes on to the last item, however many there are.
    """
    segments = [(i, a, b) for i, (a, b) in enumerate(parse_ranges(text))]
    ranges = spark.createDataFrame(segments, "segment int, low int, high int")
    met = items.join(F.broadcast(ranges), (F.col(index) >= F.col("low")) & (F.col("high").isNull() | (F.col(index) <= F.col("high"))))  # at most 100 segments: the text has 200 characters
    return met.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("segment", index))).drop("low", "high")


def fixed_volumes(chapters: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Chapters with volume number and zero-padded label, `size` to a volume."""
    t = numbered(chapters, key, order, "__place", "__last")
    t = t.withColumn("volume", F.floor((F.col("__place") - 1) / size) + 1)
    width = F.length((F.floor((F.col("__last") - 1) / size) + 1).cast("string"))
    return t.withColumn("label", _label(width)).drop("__place", "__last")


def run_volumes(chapters: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Chapters with the number of their run of equal labels."""
    placed = ranged(chapters, key, order)
    within = Window.partitionBy(key, "__slot").orderBy(order)
    new = (~F.lag(label).over(within).eqNullSafe(F.col(label)) | (F.row_number().over(within) == 1)).cast("int")
    placed = placed.withColumn("volume", F.sum(new).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a range's first run goes on with the last of the range before where their labels are equal
    slots = placed.groupBy(key, "__slot").agg(F.max("volume").alias("runs"), F.min_by(F.struct(label), order).alias("first"), F.max_by(F.struct(label), order).alias("end"))
    book = Window.partitionBy(key).orderBy("__slot")
    on = F.coalesce(F.lag("end").over(book) == F.col("first"), F.lit(False)).cast("int")
    slots = slots.withColumn("on", on).withColumn("before", F.coalesce(F.sum(F.col("runs") - F.col("on")).over(book.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slots = slots.select(F.col(key).alias("__key"), F.col("__slot").alias("__at"), (F.col("before") - F.col("on")).alias("__before"))
    met = placed.join(slots, placed[key].eqNullSafe(slots["__key"]) & (placed["__slot"] == slots["__at"]))
    return met.withColumn("volume", F.col("volume") + F.col("__before")).drop("__key", "__at", "__before", "__slot")


def _label(width: Column) -> Column:
    return F.concat(F.lit("第"), F.lpad(F.col("volume").cast("string"), width, F.lit("0")), F.lit("卷"))


def natural_key(c):
    """An array that orders text with numbers by value: digits before other text, leading zeros decide ties."""
    chunks = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda x: x.rlike(r"\A\d+\z")
    return F.transform(chunks, lambda x: F.struct(F.when(number(x), 0).otherwise(1).alias("kind"), F.when(number(x), x.try_cast("decimal(38,0)")).otherwise(F.lit(0)).alias("value"), x.alias("raw")))


def detect_width(lines: DataFrame, key: str) -> DataFrame:
    """(key, width) of documents that were wrapped at a fixed width: over the first 20,000 lines that are not blank.

    Display width counts wide characters twice. The width is the commonest of 30 or more (of equal ones the first seen)."""
    wide = r"[ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏가-힣\uf900-\ufaff︰-﹏＀-｠￠-￦]"
    t = lines.where(T.strip(F.col("line")) != "").withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("k <= 20000")
    t = t.withColumns({"w": F.length("line") + F.regexp_count("line", F.lit(wide)), "ends": F.regexp_replace("line", r"(?U)\s+$", "").rlike(r"[。！？!?…”」』》）)～~]\z")})
    widths = t.where("w >= 30").groupBy(key, "w").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    top = widths.groupBy(key).agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("width")).withColumnRenamed(key, "__key")
    full = F.col("w").between(F.col("width") - 2, F.col("width"))
    s = t.join(top, F.col(key) == F.col("__key")).groupBy(key, "width").agg(F.count("*").alias("total"), F.count_if(full).alias("full"), F.count_if(full & ~F.col("ends")).alias("open"))
    s = s.where((F.col("total") >= 40) & (F.col("full") >= 20) & (F.col("full") >= 0.25 * F.col("total")) & (F.col("open") >= 0.6 * F.col("full")))
    return s.select(key, "width")


def join_wrapped(lines: DataFrame, key: str, width: int) -> DataFrame:
    """(key, paragraph, text): wrapped lines joined; a full line without an end mark goes on unless the next is blank or indented."""
    w = Window.partitionBy(key).orderBy("pos")
    stripped = T.strip(F.col("line"))
    open_line = (F.length("line") >= width - 2) & ~F.regexp_replace("line", r"(?U)\s+$", "").rlike(r"[。！？!?…”」』》）)～~]\z") & (stripped != "")
    t = lines.withColumn("goes_on", F.lag(open_line).over(w)).withColumn("s", stripped)
    t = t.withColumn("new", (~F.coalesce(F.col("goes_on"), F.lit(False)) | F.col("line").rlike("^[ \\t　]")).cast("int")).where("s <> ''")
    t = t.withColumn("paragraph", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.sort_array(F.collect_list(F.struct("pos", "s")))
    alnum = r"[A-Za-z0-9]"
    joined = F.aggregate(parts, F.lit(""), lambda a, x: F.concat(a, F.when(a.rlike(alnum + r"\z") & x["s"].rlike(r"\A" + alnum), " ").otherwise(""), x["s"]))
    return t.groupBy(key, "paragraph").agg(joined.alias("text"))


def merge_ocr_lines(lines: DataFrame, page: str = "page") -> DataFrame:
    """(page, paragraph, text) of recognised lines (page, pos, text, x0, x1): an indent, an end mark or a short line begins anew."""
    whole = Window.partitionBy(page)
    w = whole.orderBy("pos")
    t = lines.withColumn("s", T.strip(F.col("text"))).where("s <> ''").withColumn("s", T.fix_misread(F.col("s")))
    width = F.when(F.col("x1") > F.col("x0"), F.col("x1") - F.col("x0"))
    t = t.withColumns({"left": F.min("x0").over(whole), "body": F.coalesce(F.median(width).over(whole), F.lit(0.0)), "char": F.coalesce(F.median(width / F.length("s")).over(whole), F.lit(0.0))})
    indented = (F.col("char") > 0) & (F.col("x0") - F.col("left") >= 1.5 * F.col("char"))
    full = (F.col("body") > 0) & (F.col("x1") - F.col("x0") >= 0.85 * F.col("body"))
    ended = F.lag("s").over(w).rlike("[。！？；…：”’」』）】]$")
    t = t.withColumn("new", (F.coalesce(ended, F.lit(True)) | indented | ~(full | (F.col("char") == 0))).cast("int"))
    t = t.withColumn("paragraph", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.groupBy(page, "paragraph").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("text"))


def ocr_words_to_lines(words: DataFrame) -> DataFrame:
    """(page, line, text, confidence, x0, y0, x1, y1) of word rows (page, block, par, line, word, left, top, width, height, conf, text)."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda x: x["text"])
    space = lambda a, x: F.when(a.rlike(r"[\x21-\x7E]\z") & x.rlike(r"\A[\x21-\x7E]"), F.concat(a, F.lit(" "), x)).otherwise(F.concat(a, x))
    text = F.aggregate(parts, F.lit(""), space)
    lines = words.where((F.col("conf") >= 0) & (F.trim("text") != "")).groupBy("page", "block", "par", "line")
    return lines.agg(text.alias("text"), F.bround(F.avg("conf") / 100, 4).alias("confidence"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"))


def settle_walk(spark: SparkSession, edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, step, page): the bounded walk along next-page edges (src, dst), stopped by a page already met or after `most` pages.

    One join per step over the live walks alone; ends as soon as none is live.
    """
    walk = starts.select(F.col("page").alias("start"), F.lit(1).alias("step"), F.col("page"), F.array("page").alias("seen"))
    out, step = walk, 1
    while step < most:
        walk = walk.join(edges, F.col("page") == F.col("src")).where(~F.array_contains("seen", F.col("dst")))
        walk = walk.select("start", (F.col("step") + 1).alias("step"), F.col("dst").alias("page"), F.concat("seen", F.array("dst")).alias("seen"))
        walk = walk.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else walk.cache()
        if walk.isEmpty():
            break
        out, step = out.union(walk), step + 1
    return out.select("start", "step", "page")
