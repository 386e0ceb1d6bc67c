"""Text predicates and normalisations as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import fixed_values as V

_WIDE = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))
_STRONG = r"(?:(?=https?://|www\.)" + V.URL + ")"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def dense(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def full(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(rf"(?U{'i' if ignore_case else ''})\A(?:{pattern})\z")


def fold_wide(c: Column) -> Column:
    """Full-width ASCII as ASCII; lines without any are left alone."""
    return F.when(c.rlike("[！-～]"), F.translate(c, _WIDE, _NARROW)).otherwise(c)


def has_quotes(c: Column) -> Column:
    return c.rlike(f"[{V.QUOTES}]")


#: What every address holds, and what every line holds that a noise template can fill: cheap tests that spare the costly ones.
_DOTTED = "(?i)[a-z0-9][.][a-z]{2}"
_NOISY = r"(?U)[\u2E80-\u9FFF\uF900-\uFAFF\uFF00-\uFFEF©]|(?i:copyright|all rights reserved)|\A\S*\z|\A[^\p{L}]*\z"


#: What a line may hold that some pass of cleaning could act on: characters beyond Latin, Greek and the like, white space that would
#: fold, runs of stops, addresses and notices of copyright. The letters left out of the ranges are those that match ASCII ones without case.
_BUSY = (
    r"[^ !-~À-\u012F\u0132-\u017E\u0180-\u167F\u2010-\u2015]|  |\A | \z|[.]{3}|(?i:[a-z0-9][.][a-z]{2})"
    r"|[cC][oO][pP][yY][rR][iI][gG][hH][tT]|[aA][lL][lL] [rR][iI][gG][hH][tT][sS] "
)


def is_plain(line: Column) -> Column:
    """Whether the line surely passes cleaning as it is: words parted by single spaces, with none of what the passes look for."""
    return line.contains(" ") & line.rlike("[A-Za-z]") & ~line.rlike(_BUSY)


def _whole_url(folded: Column) -> Column:
    return folded.rlike(_DOTTED) & (F.regexp_extract(folded, f"(?i){V.URL}", 0) == folded) & ~folded.rlike(r"[.,!?:;)]\z")


def noise_rule(line: Column) -> Column:
    """The name of the first template that the whole line fills, else null; lines with a quote mark have none."""

    def rules(text: Column, folded: Column) -> Column:
        rule = F.when((text == "") | has_quotes(text), F.lit(None).cast("string")).when(_whole_url(folded), "网址行")
        for name, pattern, fold in V.LINE_TEMPLATES:
            rule = rule.when(full(text, pattern, fold), name)
        advert = None
        for name, pattern, fold in V.AD_TEMPLATES:
            hit = full(folded, pattern, fold)
            advert = F.when(hit, name) if advert is None else advert.when(hit, name)
        return rule.when(F.length(dense(text)) <= V.MAX_AD_LENGTH, advert)

    return let(strip(line), lambda text: F.when(text.rlike(_NOISY), let(fold_wide(text), lambda folded: rules(text, folded))))


def is_noise_line(line: Column) -> Column:
    return (strip(line) == "") | noise_rule(line).isNotNull()


def has_url(line: Column) -> Column:
    return let(fold_wide(line), lambda folded: folded.rlike(_DOTTED) & folded.rlike(f"(?i){V.URL}"))


def remove_urls(line: Column) -> Column:
    """(line, n): addresses with a scheme or www. taken out and white space collapsed; lines with quotes stay."""
    # trailing marks are no part of an address
    pattern = f"(?i){_STRONG[:-1]}(?<![.,!?:;)]))"

    def cut(text: Column, folded: Column) -> Column:
        n = F.when(has_quotes(text), 0).otherwise(F.regexp_count(folded, F.lit(pattern)))
        rest = strip(F.regexp_replace(F.regexp_replace(folded, pattern, ""), r"(?U)\s{2,}", " "))
        return let(n, lambda k: F.struct(F.when(k > 0, rest).otherwise(text).alias("line"), k.alias("n")))

    untouched = lambda text: F.struct(text.alias("line"), F.when(text.isNotNull(), 0).alias("n"))
    return let(line, lambda text: let(fold_wide(text), lambda folded: F.when(folded.rlike(_DOTTED), cut(text, folded)).otherwise(untouched(text))))


def is_site_signature(line: Column) -> Column:
    text = dense(line)
    return (F.length(text) <= V.MAX_AD_LENGTH) & ~has_quotes(text) & ~text.rlike(V.PROSE_WORDS) & full(text, V.SITE_SIGNATURE)


def _strip_inline(c: Column) -> Column:
    pattern = rf"(?iU)(?:^|(?<=[。！？]))\s*(?:{V.SITE_NOTICE}|{V.PAGE_NOTICE})(?:[。!！]|$)"
    some = lambda v: v.contains("记住本站") | v.contains("本章未完")  # noqa: E731  every notice holds one of these
    return let(c, lambda v: F.when(~some(v) | has_quotes(v) | ~v.rlike(pattern), v).otherwise(collapse(F.regexp_replace(v, pattern, ""))))


def _tight(c: Column) -> Column:
    value = collapse(F.translate(c, V.ZERO_WIDTH, ""))
    return F.regexp_replace(value, r"(?<=[一-鿿])[ \t]+(?=[一-鿿])", "")


def _ellipsis(c: Column) -> Column:
    return F.regexp_replace(c, r"\.{3,}|。{3,}|…{2,}|·{3,}", "……")


def normalize_line(c: Column) -> Column:
    """White space folded, none between CJK; ellipses alike; inline notices out; half-width marks after CJK made full."""
    return _normalized(_tight(c))


def _normalized(tight: Column) -> Column:
    def widened(value: Column) -> Column:
        for half, wide in V.FULL_WIDTH:
            value = F.regexp_replace(value, rf"(?U)(?<=[一-鿿])\s*\{half}\s*(?!\d)", wide)
        return F.regexp_replace(value, r"(?U)\(\s*([一-鿿](?:[^()]*[^()\s])?)\s*\)", "（$1）")

    # marks are widened beside CJK alone, so other lines skip those passes
    return collapse(let(_strip_inline(_ellipsis(tight)), lambda v: F.when(v.rlike("[一-鿿]"), widened(v)).otherwise(v)))


def inline_notice_only(c: Column) -> Column:
    return _notice_only(_tight(c))


def _notice_only(tight: Column) -> Column:
    return let(_ellipsis(tight), lambda before: (before != "") & (_strip_inline(before) == ""))


def judged_line(line: Column) -> Column:
    """(rule, clean, review) of a line on its own: the rule that removes it ('' for a blank line) or null, its clean text, the review it needs or null."""

    def judged(raw: Column, tight: Column) -> Column:
        found = F.struct(
            F.coalesce(noise_rule(tight), F.when(_notice_only(tight), "站点提示")).alias("rule"), _normalized(tight).alias("clean"),
            (remove_urls(raw)["n"] > 0).alias("fragments"), has_url(raw).alias("address"),
        )
        return let(found, lambda f: let(F.when(f["fragments"], remove_urls(f["clean"])["line"]).otherwise(f["clean"]), lambda clean: F.struct(
            F.when(f["rule"].isNull() & (clean == ""), "").otherwise(f["rule"]).alias("rule"), clean.alias("clean"),
            F.when(f["rule"].isNull(), F.when(f["fragments"], "网址片段").when(f["address"], "网址片段待复核")).alias("review"),
        )))

    none = F.lit(None).cast("string")
    as_it_is = F.struct(none.alias("rule"), line.alias("clean"), none.alias("review"))
    return F.when(is_plain(line), as_it_is).otherwise(let(line, lambda raw: let(_tight(raw), lambda tight: judged(raw, tight))))


def ratio(c: Column, pattern: str) -> Column:
    """Share of the characters besides white space that the pattern finds; 0 for none."""
    return let(dense(c), lambda text: F.when(F.length(text) == 0, 0.0).otherwise(F.regexp_count(text, F.lit(pattern)) / F.length(text)))


def cjk_ratio(c: Column) -> Column:
    return ratio(c, V.CJK)


def punctuation_density(c: Column) -> Column:
    return ratio(c, V.PUNCTUATION)


def repeated_line_ratio(lines: Column) -> Column:
    """Share of an array's lines that are repeats of another."""
    return F.when(F.size(lines) == 0, 0.0).otherwise((F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines))


def has_chapter_mark(c: Column) -> Column:
    return c.rlike(f"(?U){V.CHAPTER_MARK}")


def strip_site_suffix(title: Column) -> Column:
    text = collapse(title)
    parts = F.filter(F.transform(F.split(text, f"(?U){V.TITLE_SPLIT}"), strip), lambda p: p != "")
    marked = F.filter(parts, has_chapter_mark)
    return F.when(F.size(parts) <= 1, text).when(F.size(marked) > 0, F.get(marked, F.lit(0))).otherwise(F.get(parts, F.lit(0)))


def cn_number(c: Column) -> Column:
    """Chinese numerals as a number: digits alone are read one by one, else by units; null for 0 and what is no numeral."""
    digits = F.create_map(*[x for d, v in zip(V.CN_DIGITS, V.CN_VALUES, strict=True) for x in (F.lit(d), F.lit(v).cast("long"))])
    units = F.create_map(*[x for u, v in V.CN_UNITS.items() for x in (F.lit(u), F.lit(v).cast("long"))])
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    plain = F.translate(c, V.CN_DIGITS, "".join(map(str, V.CN_VALUES))).try_cast("long")
    zero = F.lit(0).cast("long")
    state = lambda t, s, n: F.struct(t.alias("total"), s.alias("section"), n.alias("number"))

    def step(a, ch):
        d, u = F.try_element_at(digits, ch), F.try_element_at(units, ch)
        big = state(a["total"] + (a["section"] + a["number"]) * u, zero, zero)
        small = state(a["total"], a["section"] + F.when(a["number"] == 0, F.lit(1)).otherwise(a["number"]) * u, zero)
        return F.when(d.isNotNull(), state(a["total"], a["section"], d)).when(u == 10000, big).otherwise(small)

    known = c.rlike(rf"\A[{V.CN_DIGITS}{''.join(V.CN_UNITS)}]+\z")
    folded = F.aggregate(chars, state(zero, zero, zero), step, lambda a: a["total"] + a["section"] + a["number"])
    value = F.when(c.rlike(rf"\A[{V.CN_DIGITS}]+\z"), plain).when(known, folded)
    return F.when(value > 0, value)


def chapter_number(c: Column) -> Column:
    """The chapter number in a title; the first pattern found decides, even where its number is none."""
    out = None
    for pattern in V.NUMBER_PATTERNS:
        token = F.regexp_extract(c, f"(?U){pattern}", 1)
        value = F.coalesce(token.try_cast("long"), cn_number(token))
        value = F.when(value > 0, value)
        hit = c.rlike(f"(?U){pattern}")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def classify_next(c: Column) -> Column:
    """chapter, page or none, by the words of a link."""
    value = F.lower(dense(c))
    any_of = lambda words: value.rlike("|".join(words))
    return F.when(any_of(V.NEXT_CHAPTER_WORDS), "chapter").when(any_of(V.NEXT_PAGE_WORDS), "page").otherwise("none")


def is_heading(c: Column, strict: bool = True) -> Column:
    """A chapter heading; strict (import) refuses sentence and quote marks and knows English headings."""
    found = c.rlike(f"(?U){V.HEADING}") | c.rlike(f"(?U){V.SPECIAL_HEADING}")
    if strict:
        found = (found | c.rlike(f"(?U){V.ENGLISH_HEADING}")) & ~c.rlike('[。！？!?"“”‘’「」『』]')
    return (F.length(c) <= 40) & found


def fix_misread(c: Column) -> Column:
    return F.translate(c, "".join(a for a, _ in V.OCR_FIXES), "".join(b for _, b in V.OCR_FIXES))


def cloth_color(title: Column) -> Column:
    """The cover colour: 32-bit FNV-1a over code points modulo the palette."""
    chars = F.filter(F.split(F.when(title == "", "书").otherwise(title), ""), lambda x: x != "")
    value = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.get(F.array(*[F.lit(c) for c in V.CLOTH_COLORS]), (value % len(V.CLOTH_COLORS)).cast("int"))


def parse_size(c: Column) -> Column:
    """Bytes of 50MB, 50MiB, 50; null where the form, the range or the fraction is wrong."""
    text = strip(c)
    pattern = r"(?i)\A([0-9]+(?:\.[0-9]+)?)\s*(B|KB|MB|GB|KiB|MiB|GiB)?\z"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.when(unit.isin("", "b"), 1)
    for name, value in (("kb", 1000), ("mb", 1000**2), ("gb", 1000**3), ("kib", 1024), ("mib", 1024**2), ("gib", 1024**3)):
        factor = factor.when(unit == name, value)
    size = F.regexp_extract(text, pattern, 1).try_cast("decimal(24,9)") * factor.cast("decimal(13,0)")
    return F.when(text.rlike(pattern) & (size == F.floor(size)) & size.between(1, 10**12), size.cast("long"))


def sniff_format(data: Column) -> Column:
    """The image format by magic bytes; empty for none."""
    head = lambda a, n: F.substring(F.hex(F.substring(data, a, n)), 1, 2 * n)
    return (
        F.when(head(1, 3) == "FFD8FF", "jpeg").when(head(1, 8) == "89504E470D0A1A0A", "png").when(head(1, 6).isin("474946383761", "474946383961"), "gif")
        .when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "webp").when(head(1, 2) == "424D", "bmp").when(head(1, 4).isin("49492A00", "4D4D002A"), "tiff")
        .when(head(5, 8).isin("6674797061766966", "6674797061766973"), "avif").when(head(1, 2) == "FF0A", "jxl").otherwise("")
    )
