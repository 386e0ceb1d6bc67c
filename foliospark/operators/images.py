"""Image candidates: what to refuse by address, what by measured size, and in which order to keep the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import urls as U
from foliospark.functions.fixed_values import URL_BLACKLIST
from foliospark.operators.links import natural_key


def prefilter(candidates: DataFrame, page: str = "page", pos: str = "pos", url: str = "url") -> DataFrame:
    """candidates with `stage`: url (unusable or blacklisted), duplicate (met before on the page) or null where kept."""
    usable, black = U.is_usable(F.col(url)), F.regexp_replace(url, r"\?.*$", "").rlike(URL_BLACKLIST)
    t = candidates.withColumn("__bad", ~usable | F.coalesce(black, F.lit(False)))
    again = F.row_number().over(Window.partitionBy(page, url, "__bad").orderBy(pos)) > 1
    return t.withColumn("stage", F.when(F.col("__bad"), "url").when(again, "duplicate")).drop("__bad")


def postfilter(items: DataFrame, min_side: int = 200, min_bytes: int = 0, max_aspect: float = 8.0, strip_width: int = 0) -> DataFrame:
    """items (format, width, height, size, complete) with `stage`: format, size, decode or null where kept."""
    w, h = F.col("width"), F.col("height")
    strip = (F.lit(strip_width) > 0) & (F.abs(w - strip_width) <= 2)
    aspect = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))
    stage = (
        F.when(F.coalesce("format", F.lit("")) == "", "format").when(F.col("size") < min_bytes, "size").when(~(strip & (h >= 1)) & ((w < min_side) | (h < min_side)), "size")
        .when((aspect > max_aspect) & ~strip, "size").when(~F.col("complete"), "decode")
    )
    return items.withColumn("stage", stage)


def order_candidates(candidates: DataFrame, mode: str = "auto", page: str = "page", pos: str = "pos", url: str = "url") -> DataFrame:
    """candidates with `place`, and `differs` where page order and natural order of the addresses disagree (3 or more)."""
    if mode not in ("auto", "dom", "asc", "desc"):
        raise ValueError(mode)
    whole = Window.partitionBy(page)
    natural = F.row_number().over(whole.orderBy(natural_key(F.col(url)), pos))
    t = candidates.withColumn("__natural", natural).withColumn("__dom", F.row_number().over(whole.orderBy(pos)))
    n = F.count("*").over(whole)
    t = t.withColumn("differs", (n >= 3) & F.bool_or(F.col("__natural") != F.col("__dom")).over(whole))
    place = {"asc": F.col("__natural"), "desc": n + 1 - F.col("__natural")}.get(mode, F.col("__dom"))
    return t.withColumn("place", place).drop("__natural", "__dom")


def best_of_srcset(srcset: Column) -> Column:
    """(url, weight) of the heaviest candidate, of equal ones the first: 800w weighs 800, 2x weighs 2000, none 1."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.trim(p)), lambda p: p != "")

    def weighed(p, i):
        bits = F.split(p, r"\s+")
        mark = F.lower(F.coalesce(F.get(bits, F.lit(1)), F.lit("")))
        number = F.regexp_extract(mark, r"^([0-9]+(?:\.[0-9]+)?)[wx]$", 1).try_cast("double")
        return F.struct(F.coalesce(F.when(mark.endswith("x"), number * 1000).when(mark.endswith("w"), number), F.lit(1.0)).alias("weight"), (-i).alias("i"), F.get(bits, F.lit(0)).alias("url"))

    best = F.array_max(F.transform(parts, weighed))
    return F.struct(best["url"].alias("url"), best["weight"].alias("weight"))
