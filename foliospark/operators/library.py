"""Library relations: suffix joins on hosts, hints, follows against remote catalogues, artifacts, segmentation of imported texts."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions import urls as U

#: Hosts of one kind as a whole, and the one whose path decides.
KIND_HOSTS = (
    ("ac.qq.com", "^/Comic(View)?/", "manga"), ("manhuagui.com", None, "manga"), ("mycomic.com", None, "manga"), ("dongmanmanhua.cn", None, "manga"), ("manga.bilibili.com", None, "manga"),
    ("quanben.io", None, "novel"), ("hetushu.com", None, "novel"), ("t.shuqi.com", None, "novel"), ("qidian.com", None, "novel"), ("fanqienovel.com", None, "novel"), ("8book.com", None, "novel"),
)


def host_suffixes(url: Column) -> Column:
    """A host and all its parent domains, longest first: a suffix match becomes an equality join."""
    parts = F.split(U.host(url), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def expected_kind(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with `kind` of known hosts (null for others), by an equality join on host suffixes with the short table of hosts."""
    spark = pages.sparkSession
    hosts = spark.createDataFrame(list(KIND_HOSTS), "suffix string, pattern string, kind string")
    key = pages.withColumn("__row", F.monotonically_increasing_id())
    met = key.select("__row", F.col(url).alias("__url"), F.explode(host_suffixes(F.col(url))).alias("suffix")).join(F.broadcast(hosts), "suffix")  # eleven rows
    met = met.where(F.col("pattern").isNull() | F.regexp_like(U.path(F.col("__url")), F.col("pattern")))
    kinds = met.groupBy("__row").agg(F.max_by("kind", F.length("suffix")).alias("kind"))
    return key.join(kinds, "__row", "left").drop("__row")


def library_hint(requests: DataFrame, books: DataFrame) -> DataFrame:
    """requests (url) with the first followed book (book_id, source_url, created_at) of the same address but for trailing slashes."""
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    first = books.groupBy(bare(F.col("source_url")).alias("__key")).agg(F.max_by("book_id", F.struct("created_at", "book_id")).alias("book_id"))
    return requests.join(first, bare(F.col("url")) == F.col("__key"), "left").drop("__key")


def compare_follows(follows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """follows (book_id, chapters, last_title) with remote_count, remote_match (the title at the boundary is the last known) and updates."""
    counts = catalogue.groupBy("book_id").agg(F.count("*").alias("remote_count"))
    edge = catalogue.select("book_id", F.col("idx").alias("chapters"), F.col("title").alias("__title"))
    met = follows.join(counts, "book_id", "left").join(edge, ["book_id", "chapters"], "left")
    match = F.coalesce(F.col("__title") == F.col("last_title"), F.lit(False))
    updates = F.when(match, F.greatest(F.lit(0), F.coalesce("remote_count", F.lit(0)) - F.col("chapters"))).otherwise(0)
    return met.select("book_id", "chapters", "last_title", F.coalesce("remote_count", F.lit(0)).alias("remote_count"), match.alias("remote_match"), updates.cast("long").alias("updates"))


def duplicate_by_hash(books: DataFrame, uploads: DataFrame) -> DataFrame:
    """uploads (upload, sha256) with the newest book one of whose artifacts (array of structs with sha256) has that hash."""
    owned = books.select("book_id", "created_at", F.explode("artifacts").alias("a")).select("book_id", "created_at", F.col("a.sha256").alias("sha256"))
    first = owned.groupBy("sha256").agg(F.max_by("book_id", F.struct("created_at", "book_id")).alias("book_id"))
    return uploads.join(first, "sha256", "left")


def labelled_volumes(chapters: DataFrame, labels: DataFrame, key: str, order: str, fallback: int) -> DataFrame:
    """chapters (key, order, url) in volumes by their labels (url, label); a book with a chapter without one falls back to fixed volumes."""
    from foliospark.operators.links import fixed_volumes, run_volumes

    met = chapters.join(labels, "url", "left")
    gaps = met.groupBy(F.col(key).alias("__book")).agg(F.bool_or(F.col("label").isNull()).alias("__gap"))
    met = met.join(gaps, met[key].eqNullSafe(gaps["__book"])).drop("__book")
    full = run_volumes(met.where(~F.col("__gap")), key, order, "label").withColumn("fallback", F.lit(False))
    fixed = fixed_volumes(met.where("__gap").drop("label"), key, order, fallback).withColumn("fallback", F.lit(True))
    cols = [*chapters.columns, "volume", "label", "fallback"]
    return full.select(*cols).union(fixed.select(*cols))


def segment_text(lines: DataFrame, key: str, target: int = 8000) -> DataFrame:
    """(key, chapter, title, n_paragraphs, n_chars) of lines (key, pos, line): by headings where there are 3, else by size.

    A repeated heading within three paragraphs is skipped and a volume heading leads the next title: state that runs from line to
    line, so a document is folded whole in one Python call; documents bound the groups.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        has = pdf["head"].sum() >= 3
        out, title, body, last, length, number = [], "前言" if has else "第 1 段", [], "", 0, 1
        lead = False  # the title begins with a volume's

        def end():
            out.append((pdf[key].iloc[0], len(out) + 1, title, len(body), sum(map(len, body))))

        for line, head, short, volume in zip(pdf["line"], pdf["head"], pdf["short"], pdf["volume"], strict=True):
            if not line:
                continue
            if has and head:
                if line == last and len(body) <= 3:
                    continue
                if body:
                    end()
                joins = not body and lead
                title, lead = (f"{title} · {short}", True) if joins else (short, volume)
                body, last = [], line
            else:
                if not has and body and length >= target:
                    end()
                    number, body, length = number + 1, [], 0
                    title = f"第 {number} 段"
                body.append(line)
                length += len(line)
        if body:
            end()
        return pd.DataFrame(out, columns=[key, "chapter", "title", "n_paragraphs", "n_chars"])

    s = T.strip(F.col("line"))
    short = T.strip_site_suffix(s)
    prepared = lines.select(key, "pos", s.alias("line"), T.is_heading(s).alias("head"), short.alias("short"), short.rlike(r"(?U)^第[〇一二三四五六七八九十百千万零两\d]+卷").alias("volume"))
    return prepared.groupBy(key).applyInPandas(fold, f"{key} {lines.schema[key].dataType.simpleString()}, chapter int, title string, n_paragraphs int, n_chars long")


def safe_filename(name: Column, default: str = "untitled") -> Column:
    """A name that any file system takes: unsafe marks full-width, controls blank, dots off the ends, at most 100 characters and 220 bytes."""
    unsafe = '/\\:*?"<>|'
    s = F.translate(name, unsafe, "".join(chr(ord(c) + 0xFEE0) for c in unsafe))
    s = T.collapse(F.regexp_replace(s, r"[\x00-\x1f\x7f]", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"^\.+|\.+$", ""), r"^$", "")
    s = F.regexp_replace(F.regexp_replace(F.substring(s, 1, 100), r"(?U)\s+$", ""), r"\.+$", "")
    kept = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(""), lambda a, c: F.when(F.octet_length(F.concat(a, c)) <= 220, F.concat(a, c)).otherwise(a))
    s = F.when(F.octet_length(s) > 220, kept).otherwise(s)
    reserved = F.upper(s).rlike(r"^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(F.coalesce(s, F.lit("")) == "", default).when(reserved, F.concat(F.lit("_"), s)).otherwise(s)


def strip_width(images: DataFrame, key: str) -> DataFrame:
    """(key, width) of books that are strips: of the first 40 readable images, 60 % share a width and the median h / w is over 1.8."""
    first = images.where("width > 0 and height > 0").withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy("page"))).where("__k <= 40")
    n = first.groupBy(key).agg(F.count("*").alias("n"), F.median(F.col("height") / F.col("width")).alias("aspect"))
    mode = first.groupBy(key, "width").agg(F.count("*").alias("m"), F.min("__k").alias("f")).groupBy(key).agg(F.max_by(F.struct("width", "m"), F.struct("m", -F.col("f"))).alias("w"))
    return n.join(mode, key).where((F.col("w.m") >= 0.6 * F.col("n")) & (F.col("aspect") > 1.8)).select(key, F.col("w.width").alias("width"))


def choose_trial(artifacts: DataFrame, key: str, target: int) -> DataFrame:
    """(key, trial): the first trial all of whose artifacts meet the target, else the one with the least largest artifact (first of equal)."""
    per = artifacts.groupBy(key, "trial").agg(F.max("bytes").alias("largest"))
    best = F.min_by("trial", F.struct(F.when(F.col("largest") <= target, 0).otherwise(1), F.when(F.col("largest") <= target, F.lit(0)).otherwise(F.col("largest")), F.col("trial")))
    return per.groupBy(key).agg(best.alias("trial"))


def needs_ocr(images: DataFrame, chars: DataFrame, key: str = "page") -> DataFrame:
    """(key, ocr): little text (under 200 characters) beside content images without a size, or whose area outweighs the text's.

    images (key, area null if undeclared), chars (key, n_chars); images under 40,000 px² are ignored, a character counts 256 px².
    """
    i = images.groupBy(key).agg(F.bool_or(F.col("area").isNull()).alias("open"), F.sum(F.when(F.col("area") >= 40000, F.col("area"))).alias("area"))
    share = F.coalesce("area", F.lit(0)) / F.greatest(F.coalesce("area", F.lit(0)) + F.col("n_chars") * 256, F.lit(1))
    return chars.join(i, key, "left").select(key, ((F.col("n_chars") < 200) & (F.coalesce("open", F.lit(False)) | (share > 0.4))).alias("ocr"))


def map_private_use(texts: DataFrame, mapping: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts with private-use characters replaced by mapping (code, han); `complete` tells whether all were known.

    The mapping is a font's and small; characters join it per distinct character of a text, not per position.
    """
    from foliospark.functions.scripts import private_use_chars

    used = texts.select(key, F.explode(private_use_chars(F.col(text))).alias("code")).join(mapping, "code", "left")
    pairs = used.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("code", "han"))).alias("pairs"), F.bool_and(F.col("han").isNotNull()).alias("complete"))
    joined = texts.join(pairs, key, "left")
    swapped = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<code:string,han:string>>")), F.col(text), lambda a, p: F.replace(a, p["code"], p["han"]))
    complete = F.coalesce("complete", F.lit(True))
    return joined.select(*[c for c in texts.columns if c != text], F.when(complete, swapped).otherwise(F.col(text)).alias(text), complete.alias("complete"))


def read_rules(files: DataFrame) -> DataFrame:
    """(path, host, version, rule as JSON, error) of site rules in TOML (path, content), at most 64 KiB each; unknown keys are errors."""
    import json

    known = {"version", "host", "name", "catalogue", "chapter", "images", "cleanup"}

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    if len(content) > 64 << 10:
                        raise ValueError("too large")
                    rule = tomllib.loads(bytes(content).decode())
                    if extra := set(rule) - known:
                        raise ValueError(f"unknown keys {sorted(extra)}")
                    rows.append((path, str(rule["host"]).lower(), int(rule.get("version", 1)), json.dumps(rule, sort_keys=True, ensure_ascii=False), None))
                except (ValueError, KeyError, UnicodeDecodeError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "host", "version", "rule", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, host string, version int, rule string, error string")
