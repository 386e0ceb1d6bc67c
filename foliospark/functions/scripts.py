"""Script payloads of pages: unescaping, packed scripts, compressed strings, image lists. Columns where Spark can say it, else Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
IMAGE = r"\.(?:jpe?g|png|gif|webp|bmp|avif)(?:[?#]|$)"


def unescape_js(text: str | None) -> str | None:
    """\\xNN, \\uNNNN, \\n, \\r, \\t and escaped marks."""
    if text is None:
        return None
    plain = {"n": "\n", "r": "\r", "t": "\t"}
    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else plain.get(m[3], m[3]), text, flags=re.S)


def unpack_script(payload: str, radix: int, words: list[str]) -> str:
    """A packed script with each token, a number in the radix, replaced by its word (an empty word stays the token)."""

    def number(token: str) -> int:
        value = 0
        for ch in token:
            digit = _DIGITS.find(ch)
            if not 0 <= digit < radix:
                return -1
            value = value * radix + digit
        return value

    def word(m):
        k = number(m[0])
        return words[k] if 0 <= k < len(words) and words[k] else m[0]

    return re.sub(r"\b\w+\b", word, payload)


def packed_payload(script: str | None) -> str | None:
    """The unpacked body of the page's eval(function(p,a,c,k,e,d)...) call, if any."""
    m = re.search(r"\}\(\s*'((?:[^'\\]|\\.)*)'\s*,\s*(\d+)\s*,\s*\d+\s*,\s*'((?:[^'\\]|\\.)*)'\s*\.split\('\|'\)", script or "", re.S)
    return unpack_script(unescape_js(m[1]), int(m[2]), unescape_js(m[3]).split("|")) if m and 2 <= int(m[2]) <= len(_DIGITS) else None


def decompress_base64(blob: str | None, most: int = 8 << 20) -> str | None:
    """The published LZ-string format in base64: variable-width codes over a growing dictionary; None for what is malformed."""
    if not blob or any(c not in _BASE64 for c in blob):
        return None
    bits = "".join(f"{_BASE64.index(c):06b}" for c in blob.rstrip("="))
    at = 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(bits):
            raise ValueError("truncated")
        value = int(bits[at : at + n][::-1], 2)
        at += n
        return value

    try:
        kind = take(2)
        if kind == 2:
            return ""
        table: dict[int, str] = {3: chr(take(8 if kind == 0 else 16))}
        last, out, size, width, left = table[3], [table[3]], 4, 3, 4
        total = 1
        while total < most:
            code = take(width)
            if code == 2:
                return "".join(out)
            if code in (0, 1):
                table[size] = chr(take(8 if code == 0 else 16))
                code, size, left = size, size + 1, left - 1
                if not left:
                    left, width = 1 << width, width + 1
            if code in table:
                entry = table[code]
            elif code == size:
                entry = last + last[0]
            else:
                return None
            out.append(entry)
            total += len(entry)
            table[size] = last + entry[0]
            last, size, left = entry, size + 1, left - 1
            if not left:
                left, width = 1 << width, width + 1
    except (ValueError, OverflowError):
        return None
    return None


@F.pandas_udf(StringType())
def unescape_js_udf(text: pd.Series) -> pd.Series:
    return text.map(unescape_js)


@F.pandas_udf(StringType())
def packed_payload_udf(script: pd.Series) -> pd.Series:
    return script.map(packed_payload)


@F.pandas_udf(StringType())
def decompress_udf(blob: pd.Series) -> pd.Series:
    return blob.map(decompress_base64)


def string_list(raw: Column) -> Column:
    """A JSON list of strings; single quotes are taken for double ones where the text is no list as it stands."""
    parse = lambda c: F.from_json(c, "array<string>")
    return F.coalesce(parse(raw), parse(F.replace(raw, F.lit("'"), F.lit('"'))))


def array_images(html: Column, most: int = 2000) -> Column:
    """The longest list of image addresses in a page's scripts, at least 2 long, capped at the fixed 2,000 of the format."""
    lists = F.transform(F.regexp_extract_all(html, F.lit(r"""(\[\s*(?:"[^"\]]*"|'[^'\]]*')(?:\s*,\s*(?:"[^"\]]*"|'[^'\]]*'))*\s*,?\s*\])"""), F.lit(1)), lambda x: string_list(F.regexp_replace(x, r",\s*\]", "]")))
    images = F.filter(F.filter(lists, lambda x: x.isNotNull()), lambda x: (F.size(x) >= 2) & F.forall(x, lambda u: u.rlike("(?i)" + IMAGE)))
    best = F.array_max(F.transform(images, lambda x, i: F.struct(F.size(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return F.slice(best["x"], 1, most)


def same_folder(urls: Column) -> Column:
    return F.size(F.array_distinct(F.transform(urls, lambda u: F.regexp_replace(u, r"[^/]*(?:[?#].*)?$", "")))) == 1


def private_use_chars(text: Column) -> Column:
    """The distinct private-use characters of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\uE000-\uF8FF])"), F.lit(1)))


def needs_deobfuscation(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\uE000-\uF8FF]")) >= 8


def player_url(value: Column) -> Column:
    """A player's address: plain, percent-encoded, or base64 of percent-encoded text."""
    plain = F.when(value.rlike("^https?://"), value)
    percent = F.try_url_decode(value)
    inner = F.try_url_decode(F.try_to_binary(value, F.lit("base64")).cast("string"))
    return F.coalesce(plain, F.when(percent.rlike("^https?://"), percent), F.when(inner.rlike("^https?://"), inner))
