"""Image headers byte by byte and strict JSON, beyond what the SQL gate holds."""

import io
import struct
import zlib

import pytest

from foliospark.functions.records import _chapters, canonical
from foliospark.sources.image_headers import probe


def png(width, height, data=b"\0"):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    out = io.BytesIO(b"\x89PNG\r\n\x1a\n")
    out.seek(0, 2)
    out.write(chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)))
    if data is not None:
        out.write(chunk(b"IDAT", data))
    out.write(chunk(b"IEND", b""))
    return out.getvalue()


def test_png_needs_data_and_an_end():
    assert probe(png(640, 480)) == ("png", 640, 480, True)
    assert probe(png(640, 480, None)) == ("png", 640, 480, False)
    assert probe(png(640, 480) + b"more") == ("png", 640, 480, False)
    assert probe(png(0, 480))[1:3] == (0, 0)


@pytest.mark.parametrize("cut", [0, 3, 10, 20])
def test_short_headers_have_no_dimensions(cut):
    for whole in (png(5, 6), b"GIF89a\5\0\6\0\0\0\0;", b"\xff\xd8\xff\xe0\0\4\0\0\xff\xc0\0\x0b\x08\0\6\0\5\1\1\x11\0", b"RIFF\x16\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0\4\0\0\5\0\0"):
        assert not probe(whole[: min(cut, len(whole) - 1)])[3]


def test_webp_and_jpeg_variants():
    lossless = b"RIFF\x12\0\0\0WEBPVP8L\5\0\0\0\x2f" + struct.pack("<I", 99 | 49 << 14) + b"\0"
    assert probe(lossless) == ("webp", 100, 50, True)
    lossy = b"RIFF\x16\0\0\0WEBPVP8 \x0a\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 64, 32)
    assert probe(lossy) == ("webp", 64, 32, True)
    progressive = b"\xff\xd8\xff\xff\xc2\0\x0b\x08" + struct.pack(">HH", 7, 9) + b"\1\1\x11\0\xff\xda\0\x08\1\1\0\0\x3f\0\0\xff\xd9"
    assert probe(progressive) == ("jpeg", 9, 7, True)
    assert probe(None) == probe(b"text") == (None, 0, 0, False)


def test_a_gif_ends_at_its_end_mark_alone():
    head = lambda width, height, flags=0: b"GIF89a" + struct.pack("<HHB", width, height, flags) + b"\0\0"
    image = b"\x21\xf9\4\0\0\0\0\0" + b"\x2c\0\0\0\0\1\0\1\0\x80" + bytes(6) + b"\2\2;;\0"
    for width, height in ((5, 59), (59, 13), (59 << 8, 10)):
        assert probe(head(width, height)) == ("gif", width, height, False)
        assert probe(head(width, height) + b";") == probe(head(width, height) + b"\0;\r\n\0") == ("gif", width, height, True)
    whole = head(1, 1, 0x81) + b";" * 12 + image + b";"
    assert probe(whole) == ("gif", 1, 1, True)
    assert not any(probe(whole[:n])[3] for n in range(len(whole)))
    assert probe(head(1, 1) + b"\7;") == ("gif", 1, 1, False)


def test_records():
    assert canonical('{"b": 1.5, "a": {"d": [], "c": null}}') == '{"a":{"c":null,"d":[]},"b":1.5}'
    for refused in (None, "", "[]", "1", '{"a":1,"a":1}', '{"a":{"b":1,"b":2}}', '{"a":Infinity}', '{"a":1} x', "{" * 100_000, '{"a":' * 100_000, '{"a":1e999}'):
        assert canonical(refused) is None, refused


def test_embedded_chapters():
    key = '"list":'
    assert _chapters('x"list":[[{"itemId":"1","title":"]"}],[]],"z"', key) == [{"item": "1", "title": "]"}]
    for bad in (None, "", '"list":', '"list":{}', '"list":[1]', '"list":[[]]', '"list":[[{"itemId":1,"title":"a"}]]', '"list":[[{"itemId":"a","title":"a"}]]', '"list":[[{"itemId":"1"}]]', '"list":[[3]]'):
        assert _chapters(bad, key) is None, bad
