"""Column expressions for names, sizes, addresses, metadata and small ordered lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import urls as U

#: File suffixes of images, suffixes by content type, marks of placeholder addresses.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".avif", ".jxl", ".jfif", ".pjpeg")
SUFFIX_OF_TYPE = {
    "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/pjpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp", "image/avif": ".avif",
    "image/jxl": ".jxl", "image/svg+xml": ".svg",
}
PLACEHOLDER = r"(?i)(blank|spacer|placeholder|loading|grey|gray|pixel|1x1|transparent|default)"
#: Confidence below which a recognised line is reviewed, and the aspect above which pages are strips.
REVIEW_BELOW, STRIP_ASPECT = 0.6, 1.8


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB of 1024, one decimal beyond bytes; an exact half goes to the even digit."""
    power = F.when(n < 1024, 0).when(n < 1 << 20, 1).when(n < 1 << 30, 2).otherwise(3)
    scaled = F.bround(n / F.pow(F.lit(1024.0), power), 1)
    return F.when(power == 0, F.format_string("%d B", n.cast("long"))).otherwise(F.concat(F.format_string("%.1f", scaled), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power + 1)))


def xml_text(text: Column) -> Column:
    """The text without the characters that XML metadata cannot hold, and without DEL to U+009F."""
    return F.regexp_replace(text, r"[^\t\n\r\x20-\x7E\xA0-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]", "")


def task_url(url: Column) -> Column:
    """The trimmed address of a task, or null: http or https, with a host, no credentials and no control characters."""
    s = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    ok = U.is_usable(s) & U.scheme(s).isin("http", "https") & ~U.part(s, 2).contains("@") & ~s.rlike(r"[\x00-\x1F]")
    return F.when(ok, s)


def workdir_key(url: Column) -> Column:
    """Host and the first ten hexadecimal digits of the address's SHA-256: one working folder an address."""
    return F.concat(F.coalesce(F.nullif(U.host(url), F.lit("")), F.lit("site")), F.lit("-"), F.left(F.sha2(url, 256), F.lit(10)))


def thumbnail_id(task: Column, page: Column) -> Column:
    """The first 64 bits of the task's SHA-256 times a million, plus the page: beyond a long, so a decimal."""
    return F.conv(F.left(F.sha2(task, 256), F.lit(16)), 16, 10).cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(7,0)") + page.cast("decimal(10,0)")


def image_suffix(url: Column, content_type: Column) -> Column:
    """The suffix to store an image under: of its address, else of its content type, else .jpg."""
    ext = U.path_ext(url)
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    of_type = F.create_map(*[F.lit(x) for pair in SUFFIX_OF_TYPE.items() for x in pair])
    return F.when(ext == ".jfif", ".jpg").when(ext.isin(*IMAGE_SUFFIXES), ext).otherwise(F.coalesce(F.element_at(of_type, kind), F.lit(".jpg")))


def by_trust(urls: Column) -> Column:
    """Distinct addresses, placeholders last, otherwise in order."""
    odd = lambda u: u.rlike(PLACEHOLDER)
    return F.array_distinct(F.concat(F.filter(urls, lambda u: ~odd(u)), F.filter(urls, odd)))


def longer(script: Column, dom: Column) -> Column:
    """The list of the script where it is longer than that of the page, else the page's."""
    return F.when(F.size(script) > F.size(dom), script).otherwise(dom)


def title_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def repeated_chapter(segments: Column) -> Column:
    """The first chapter that a segment (first, last; last null: open) shares with those before it; null if none does."""
    open_end = F.lit(1 << 30)

    def clash(s, i):
        before = F.slice(segments, 1, i)
        met = F.filter(before, lambda e: (e["first"] <= F.coalesce(s["last"], open_end)) & (s["first"] <= F.coalesce(e["last"], open_end)))
        return F.array_min(F.transform(met, lambda e: F.greatest(e["first"], s["first"])))

    return F.get(F.filter(F.transform(segments, clash), lambda x: x.isNotNull()), F.lit(0))


def export_formats(text: Column, allowed: tuple[str, ...]) -> Column:
    """The formats of a list between commas, lower case; null where one is unknown or repeated, or none is given."""
    parts = F.transform(F.split(text, ","), lambda p: F.lower(F.trim(p)))
    ok = F.forall(parts, lambda p: p.isin(*allowed)) & (F.size(F.array_distinct(parts)) == F.size(parts))
    return F.when(ok, parts)


def group_name(name: Column) -> Column:
    """The trimmed name of a group, null unless of 1 to 50 characters."""
    s = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(s).between(1, 50), s)


def jsonp_content(body: Column, callback: str) -> Column:
    """The string `content` of d<callback>({...}), null unless it is one that holds links."""
    s = F.trim(body)
    inner = F.regexp_extract(s, rf"(?s)^d{callback}\((.*)\)\s*;?$", 1)
    content = F.get_json_object(inner, "$.content")
    return F.when(content.contains("<a "), content)


def watermark(text: Column) -> Column:
    """Whether a short text without Han characters writes a number and a domain in look-alikes: an eight and a dot of some kind."""
    s = F.trim(text)
    return s.rlike(r"^[^\u4e00-\u9fff]{5,20}$") & s.rlike("[8⑧⒏⑻８]") & s.rlike("[·.．。｡•・]")


def like_pattern(search: str) -> str:
    """The search as a pattern: % and _ in it are wildcards, as in the ledger's own search; a backslash is itself."""
    return "%" + search.replace("\\", "\\\\").lower() + "%"
