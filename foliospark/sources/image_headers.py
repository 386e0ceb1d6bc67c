"""Images by their bytes alone: format, dimensions and whether the end is there, without decoding a pixel."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "format string, width int, height int, complete boolean"

# The largest side and number of pixels that are decoded.
MAX_SIDE = 100_000
MAX_PIXELS = 16_000_000


def _png(b: bytes):
    width, height = struct.unpack_from(">II", b, 16)
    at, data, ended = 8, False, False
    while at + 12 <= len(b) and not ended:
        size, kind = struct.unpack_from(">I4s", b, at)
        data, ended = data or kind == b"IDAT", kind == b"IEND"
        at += 12 + size
    return width, height, data and ended and at == len(b)


def _gif(b: bytes):
    width, height, flags = struct.unpack_from("<HHBxx", b, 6)
    return width, height, _gif_ends(b, 13 + _colours(flags))


def _colours(flags: int) -> int:
    """Bytes of the colour table that the flags announce."""
    return 3 << (flags & 7) + 1 if flags & 0x80 else 0


def _gif_ends(b: bytes, at: int) -> bool:
    """Whether the blocks from at on lead to the end mark; a byte of its value in the header or in data is none."""
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return not b[at:].strip(b";\r\n\0")
        if kind == 0x2C:  # an image: its place, its colours, the size of its codes
            if at + 10 > len(b):
                return False
            at += 11 + _colours(b[at + 9])
        elif kind == 0x21:  # an extension with its label
            at += 2
        elif kind == 0:  # padding between blocks
            at += 1
            continue
        else:
            return False
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return False


def _bmp(b: bytes):
    size, width, height = struct.unpack_from("<I12xii", b, 2)
    return width, abs(height), size <= len(b)


def _webp(b: bytes):
    whole = struct.unpack_from("<I", b, 4)[0] + 8 <= len(b)
    kind = b[12:16]
    if kind == b"VP8X":
        low, high, low2, high2 = struct.unpack_from("<HBHB", b, 24)
        return 1 + low + (high << 16), 1 + low2 + (high2 << 16), whole
    if kind == b"VP8L":
        bits = struct.unpack_from("<I", b, 21)[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), whole
    width, height = struct.unpack_from("<HH", b, 26)
    return width & 0x3FFF, height & 0x3FFF, whole


def _jpeg(b: bytes):
    at, size = 2, (0, 0)
    while b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:  # padding before a marker
            at += 1
            continue
        if marker == 0xDA:  # the scan; what follows is entropy-coded up to the end marker
            return *size, size != (0, 0) and b.rfind(b"\xff\xd9") > at
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", b, at + 5)
            size = width, height
        at += 2 if 0xD0 <= marker <= 0xD8 or marker == 0x01 else 2 + struct.unpack_from(">H", b, at + 2)[0]
    return *size, False


READERS = (("png", b"\x89PNG\r\n\x1a\n", _png), ("gif", b"GIF87a", _gif), ("gif", b"GIF89a", _gif), ("bmp", b"BM", _bmp), ("jpeg", b"\xff\xd8\xff", _jpeg))


def probe(b: bytes | None):
    """(format, width, height, complete); format is null for other bytes, dimensions are 0 where the header is cut off."""
    b = bytes(b or b"")
    name, read = ("webp", _webp) if b[:4] == b"RIFF" and b[8:12] == b"WEBP" else next(((n, r) for n, mark, r in READERS if b.startswith(mark)), (None, None))
    if not name:
        return None, 0, 0, False
    try:
        width, height, complete = read(b)
    except (struct.error, IndexError):
        return name, 0, 0, False
    return (name, width, height, complete) if 0 < width < 1 << 31 and 0 < height < 1 << 31 else (name, 0, 0, False)


def probe_images(files: DataFrame, content: str = "content") -> DataFrame:
    """files with format, width, height and complete instead of their content, one Arrow pass, nothing shuffled."""
    kept = [c for c in files.columns if c != content]
    schema = files.select(*kept).schema.simpleString()[7:-1]

    def run(batches):
        for pdf in batches:
            found = pd.DataFrame(map(probe, pdf[content]), columns=["format", "width", "height", "complete"], index=pdf.index)
            yield pd.concat([pdf[kept], found], axis=1)

    return files.mapInPandas(run, f"{schema}, {FIELDS}")


def may_decode(width: Column, height: Column) -> Column:
    """Whether both sides and the number of pixels lie within the limits."""
    sides = width.between(1, MAX_SIDE) & height.between(1, MAX_SIDE)
    return F.coalesce(sides & (width.cast("long") * height <= MAX_PIXELS), F.lit(False))
