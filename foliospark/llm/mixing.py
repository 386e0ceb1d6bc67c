"""Operator 2, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources' targets are water-filled from the weights. Each source is cut into blocks by a hash; its blocks are permuted per
epoch and drawn until the words reach the target, which gives the source its exact quota of block draws. A binary tree then
splits the vector of quotas among the output shards: a node hands half of its draws to its left child, and how many of these
come from each source is one multivariate hypergeometric draw, made source by source from the univariate law by inversion.
Each shard takes its own run of every source's permuted draws, so that shards are disjoint, and is shuffled locally.
DataFrame functions alone; every random choice is a hash of seed and ids, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import WORD, let, settled, stored

WEIGHTS = (5, 2, 1)
#: Documents of a block, blocks of a slice that one window sorts, sources that one row folds over.
BLOCK_DOCS, SLICE_BLOCKS, GROUP = 512, 1024, 512
_COPIES = "array<struct<epoch:int,shard:bigint,order:bigint>>"


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """(source, src, n_docs, source_size, target) of sized (source, size); src numbers sources by code point, null last.

    A target is its weight's share of all words, stopped at most_epochs times the source's words, the excess shared by
    weight among the rest until none is above: with sources in order of cap / weight, the first that stays under its
    share sets the level for itself and all after it. The windows run over one row per source.
    """
    whole = Window.partitionBy(F.lit(0))
    s = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    s = s.withColumn("src", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = whole.orderBy("ratio", "src")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "src"))).over(whole))
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    return s.select("source", "src", "n_docs", "source_size", "target")


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def hypergeometric(n: Column, k: Column, m: Column, u: Column) -> Column:
    """How many of m units drawn from n, of which k are marked, are marked: the least count whose distribution exceeds u.

    The weights of successive counts follow from their ratio, starting at 1 at the least count. Counts further than 12
    deviations and 12 units from the mean are left out: together they are less likely than a double can tell from 0.
    """
    n, k, m = (x.cast("double") for x in (n, k, m))
    mean, part = m * k / F.greatest(n, F.lit(1.0)), k / F.greatest(n, F.lit(1.0))
    reach = 12 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - part) * (n - m) / F.greatest(n - 1, F.lit(1.0)))) + 12
    low = F.greatest(F.lit(0.0), m - (n - k), F.floor(mean - reach).cast("double"))
    high = F.least(m, k, F.ceil(mean + reach).cast("double"))

    def drawn(b: Column) -> Column:
        counts = F.sequence(b["low"].cast("long"), b["high"].cast("long"))
        ratio = lambda j: (b["k"] - j) * (b["m"] - j) / ((j + 1) * (b["n"] - b["k"] - b["m"] + j + 1))
        nothing = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"))
        total = F.aggregate(counts, nothing, lambda a, j: F.struct((a["w"] * ratio(j)).alias("w"), (a["t"] + a["w"]).alias("t")), lambda a: a["t"])
        start = F.struct(F.lit(1.0).alias("w"), (b["u"] * total).alias("left"), b["low"].cast("long").alias("x"))

        def step(a, j):
            over = a["left"] >= a["w"]
            return F.struct((a["w"] * ratio(j)).alias("w"), F.when(over, a["left"] - a["w"]).otherwise(-1.0).alias("left"), (a["x"] + over.cast("long")).alias("x"))

        return F.least(F.aggregate(counts, start, step, lambda a: a["x"]), b["high"].cast("long"))

    return let(F.struct(low.alias("low"), high.alias("high"), n.alias("n"), k.alias("k"), m.alias("m"), u.alias("u")), drawn)


def split_node(members: Column, m: Column) -> Column:
    """Of m units drawn from members (array of key, k, u), how many come from each: array of key, k, left."""
    kind = "array<struct<key:bigint,k:bigint,left:bigint>>"
    n = F.aggregate(members, F.lit(0).cast("long"), lambda a, x: a + x["k"])
    start = F.struct(n.alias("n"), m.cast("long").alias("m"), F.array().cast(kind).alias("out"))

    def step(a, x):
        found = let(hypergeometric(a["n"], x["k"], a["m"], x["u"]), lambda y: F.struct(
            (a["n"] - x["k"]).alias("n"), (a["m"] - y).alias("m"), F.concat(a["out"], F.array(F.struct(x["key"].alias("key"), x["k"].alias("k"), y.alias("left")))).alias("out")))
        return found

    return F.aggregate(members, start, step, lambda a: a["out"])


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(src, shard, k): the tree's leaves, from the sources' quotas (src, k). Rows without a draw are left out.

    Level by level every node gives ceil(half) of its draws to the left. Its groups of GROUP sources are split first, then the
    sources of each group, so that no row folds over more than GROUP sources or all groups. A level is checkpointed.
    """
    counts = quotas.select("src", F.lit(0).cast("long").alias("node"), "k").where("k > 0")
    for level in range(levels):
        u = uniform(F.lit(seed), F.lit(level), F.col("node"), F.col("src"))
        groups = settled(
            counts.groupBy("node", F.floor(F.col("src") / GROUP).alias("grp"))
            .agg(F.sum("k").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("src").alias("key"), "k", u.alias("u")))).alias("members"))
        )
        u = uniform(F.lit(seed), F.lit(level), F.col("node"), -1 - F.col("grp"))
        nodes = groups.groupBy("node").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct(F.col("grp").alias("key"), F.col("n").alias("k"), u.alias("u")))).alias("members"))
        shares = nodes.select(F.col("node").alias("s_node"), F.explode(split_node(F.col("members"), F.ceil(F.col("all") / 2))).alias("s"))
        met = groups.join(shares, (F.col("node") == F.col("s_node")) & (F.col("grp") == F.col("s.key"))).select("node", F.explode(split_node(F.col("members"), F.col("s.left"))).alias("e"))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("e.left").alias("k")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("e.k") - F.col("e.left")).alias("k")))
        counts = settled(met.select(F.col("e.key").alias("src"), F.explode(sides).alias("side")).select("src", "side.node", "side.k").where("k > 0"))
    return counts.select("src", F.col("node").alias("shard"), "k")


def permuted_draws(blocks: DataFrame, seed: int) -> DataFrame:
    """(src, block, epoch, seq, rest, whole): the draws of blocks (src, block, words, n_blocks, source_size, target) until each source's target.

    Every epoch permutes a source's blocks by a hash; seq numbers its draws from 1 and rest is what the target still lacks before
    one. Running sums are taken within slices of about SLICE_BLOCKS blocks and over slices, so a hot source is no single sort.
    """
    turned = (
        blocks.where("target > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)))
        .withColumn("h", F.xxhash64(F.lit(seed), "epoch", "src", "block"))
        .withColumn("slice", F.pmod("h", F.ceil(F.col("n_blocks") / SLICE_BLOCKS)))
    )
    inner = Window.partitionBy("src", "epoch", "slice").orderBy("h", "block")
    turned = stored(turned.withColumn("nth", F.row_number().over(inner).cast("long")).withColumn("sum", F.sum("words").over(inner.rowsBetween(Window.unboundedPreceding, 0))), "draws")
    outer = Window.partitionBy("src").orderBy("epoch", "slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = turned.groupBy("src", "epoch", "slice").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    slices = stored(slices.select(F.col("src").alias("s_src"), F.col("epoch").alias("s_epoch"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(outer), F.lit(0)).alias("w0")), "slices")
    met = turned.join(slices, (F.col("src") == F.col("s_src")) & (F.col("epoch") == F.col("s_epoch")) & (F.col("slice") == F.col("s_slice")))
    rest = F.col("target") - F.col("w0") - F.col("sum") + F.col("words")
    return met.select("src", "block", "epoch", (F.col("n0") + F.col("nth")).alias("seq"), rest.alias("rest"), (F.col("words") <= rest).alias("whole")).where("rest > 0")


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs[text_col].cast("string"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], most_epochs: int, levels: int | None, seed: int, block_docs: int, shard_words: int):
    """(sized, sources, drawn, fitted, levels): documents' sizes; sources; draws of each block; copies of documents of crossing blocks."""
    sized = stored(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), _key(docs, id_col, text_col).alias("key"), _size(docs[text_col]).alias("size")), "sizes")
    sources = source_targets(sized, weights, most_epochs).withColumn("n_blocks", F.ceil(F.col("n_docs") / block_docs))
    sources = stored(sources.withColumnRenamed("source", "s"), "sources")
    if levels is None:
        words = sources.agg(F.sum("target")).first()[0] or 0.0
        levels = 4
        while words > shard_words << levels:
            levels += 1
    located = stored(_located(sized, sources, seed).select("id", "key", "size", "src", "block", "n_blocks", "source_size", "target"), "located")
    blocks = located.groupBy("src", "block").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("n_blocks", "source_size", "target")])
    draws = stored(permuted_draws(blocks, seed), "permuted")
    leaves = split_quotas(draws.groupBy("src").agg(F.count("*").alias("k")), levels, seed)
    upto = F.sum("k").over(Window.partitionBy("src").orderBy("shard"))
    seats = leaves.withColumn("upto", upto).select(F.col("src").alias("q_src"), "shard", F.explode(F.sequence(F.col("upto") - F.col("k") + 1, F.col("upto"))).alias("q_seq"))
    placed = draws.join(seats, (F.col("src") == F.col("q_src")) & (F.col("seq") == F.col("q_seq")))
    drawn = placed.groupBy(F.col("src").alias("p_src"), F.col("block").alias("p_block")).agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "whole", "rest"))).alias("d"))
    drawn = stored(drawn, "drawn")
    crossing = drawn.where(F.exists("d", lambda d: ~d["whole"]))
    fitted = _fit_crossing(located.join(crossing, (F.col("src") == F.col("p_src")) & (F.col("block") == F.col("p_block"))), seed)
    return sized, sources, drawn, stored(fitted, "fitted"), levels


def _located(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """rows (key, source, ...) with their source's row and their block."""
    met = rows.join(sources, rows["source"].eqNullSafe(sources["s"]))
    return met.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "key"), "n_blocks"))


def _fit_crossing(rows: DataFrame, seed: int) -> DataFrame:
    """(f_src, f_key, f_epoch): documents taken by the draws that cross a source's target, one block a source at most.

    In a hashed order each document of the block is taken if it still fits under the target; equal keys and sizes go together.
    """
    members = rows.groupBy("src", "block", "key", "size").agg(F.count("*").alias("n"), F.first("d").alias("d"))
    each = F.struct(F.xxhash64(F.lit(seed), F.lit("doc"), "key").alias("h"), "key", (F.col("size") * F.col("n")).alias("size"))
    held = members.groupBy("src", "block").agg(F.sort_array(F.collect_list(each)).alias("e"), F.get(F.filter(F.first("d"), lambda d: ~d["whole"]), F.lit(0)).alias("last"))
    start = F.struct(F.col("last.rest").alias("left"), F.array().cast("array<bigint>").alias("keys"))

    def step(acc, e):
        fits = e["size"] <= acc["left"]
        return F.struct((acc["left"] - F.when(fits, e["size"]).otherwise(0)).alias("left"), F.when(fits, F.concat(acc["keys"], F.array(e["key"]))).otherwise(acc["keys"]).alias("keys"))

    return held.select(F.col("src").alias("f_src"), F.explode(F.aggregate("e", start, step, lambda a: a["keys"])).alias("f_key"), F.lit(True).alias("f_taken"))


def _copied(located: DataFrame, drawn: DataFrame, fitted: DataFrame, seed: int) -> DataFrame:
    """located rows with copies: the draws of their block, of a crossing draw only where the document fits."""
    met = located.join(drawn, (F.col("src") == F.col("p_src")) & (F.col("block") == F.col("p_block")), "left")
    met = met.join(fitted, (F.col("src") == F.col("f_src")) & (F.col("key") == F.col("f_key")), "left")
    kept = F.filter("d", lambda d: d["whole"] | F.coalesce(F.col("f_taken"), F.lit(False)))
    copies = F.transform(kept, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.lit("order"), "key", d["epoch"]).alias("order")))
    return met.withColumn("copies", F.coalesce(copies, F.array().cast(_COPIES)))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
    most_epochs: int = 3, levels: int | None = None, seed: int = 42, block_docs: int = BLOCK_DOCS, shard_words: int = 1 << 25,
) -> DataFrame:
    """One row per row of docs: the id, source, size, source_size, target, copies (array of epoch, shard, order), taken.

    size counts words between ASCII white space (null text: 0). taken is size times the copies drawn: no more than most_epochs.
    There are 2 ** levels shards, by default 16, doubled until one holds about shard_words words or fewer; order sorts a shard's
    copies. A block holds about block_docs documents, dealt by a hash of id and text. Null is a source, last, and a null id an id;
    rows alike in id and text are drawn alike; an empty table gives no rows; columns other than the three named are not read.
    """
    sized, sources, drawn, fitted, _ = _plan(docs, id_col, text_col, source_col, weights, most_epochs, levels, seed, block_docs, shard_words)
    out = _copied(_located(sized, sources, seed), drawn, fitted, seed)
    out = out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies")
    return out.withColumn("taken", F.col("size") * F.size("copies"))


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
    most_epochs: int = 3, levels: int | None = None, seed: int = 42, block_docs: int = BLOCK_DOCS, shard_words: int = 1 << 25,
) -> DataFrame:
    """The rows of docs, with its columns, as often as mix() takes them, laid out by shard and shuffled locally by order.

    A document finds its draws by its source and block, so its text moves once, to its shard. Columns of docs may have any names.
    """
    _, sources, drawn, fitted, levels = _plan(docs, id_col, text_col, source_col, weights, most_epochs, levels, seed, block_docs, shard_words)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].alias("source"), _key(docs, id_col, text_col).alias("key"))
    copied = _copied(_located(packed, sources, seed), drawn, fitted, seed).select("row", F.explode("copies").alias("c"))
    laid = copied.repartition(1 << levels, "c.shard").sortWithinPartitions("c.shard", "c.order")
    return laid.select("row.*")
