"""Book files from chapter and page relations: one file per book, made where the book's rows meet, written by Spark as rows.

A book is the unit of output and bounds a group: chapters of one book must fit one task, as they must fit one file.
"""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DATE = (1980, 1, 1, 0, 0, 0)


def _put(z: zipfile.ZipFile, name: str, data: bytes | str, stored: bool = False) -> None:
    info = zipfile.ZipInfo(name, _DATE)
    info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
    info.external_attr = 0o644 << 16
    z.writestr(info, data)


def _xhtml(title: str, body: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title></head><body>{body}</body></html>'


def epub_bytes(title: str, author: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """A deterministic EPUB 3 of (heading, paragraphs), with nav and ncx."""
    n = range(1, len(chapters) + 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        _put(z, "mimetype", "application/epub+zip", True)
        _put(z, "META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for k, (heading, paragraphs) in zip(n, chapters, strict=True):
            _put(z, f"OEBPS/c{k:05d}.xhtml", _xhtml(heading, f"<h1>{escape(heading)}</h1>" + "".join(f"<p>{escape(p)}</p>" for p in paragraphs)))
        toc = "".join(f'<li><a href="c{k:05d}.xhtml">{escape(h)}</a></li>' for k, (h, _) in zip(n, chapters, strict=True))
        _put(z, "OEBPS/nav.xhtml", _xhtml(title, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{toc}</ol></nav>'))
        points = "".join(f'<navPoint id="p{k}" playOrder="{k}"><navLabel><text>{escape(h)}</text></navLabel><content src="c{k:05d}.xhtml"/></navPoint>' for k, (h, _) in zip(n, chapters, strict=True))
        _put(z, "OEBPS/toc.ncx", f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>{points}</navMap></ncx>')
        items = "".join(f'<item id="c{k}" href="c{k:05d}.xhtml" media-type="application/xhtml+xml"/>' for k in n)
        spine = "".join(f'<itemref idref="c{k}"/>' for k in n)
        _put(z, "OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>zh</dc:language></metadata><manifest>{items}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx">{spine}</spine></package>')
    return out.getvalue()


def epub_books(chapters: DataFrame) -> DataFrame:
    """(book, content, sha256, error) of (book, title, author, chapter, heading, paragraphs); chapters must run 1..n."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chapter")
        if pdf["chapter"].tolist() != list(range(1, len(pdf) + 1)):
            return pd.DataFrame([(pdf["book"].iloc[0], None, "chapters are not consecutive")], columns=["book", "content", "error"])
        rows = [(h, list(p)) for h, p in zip(pdf["heading"], pdf["paragraphs"], strict=True)]
        return pd.DataFrame([(pdf["book"].iloc[0], epub_bytes(pdf["title"].iloc[0], pdf["author"].iloc[0], rows), None)], columns=["book", "content", "error"])

    kind = chapters.schema["book"].dataType.simpleString()
    return chapters.groupBy("book").applyInPandas(make, f"book {kind}, content binary, error string").withColumn("sha256", F.sha2("content", 256))


def archive_books(pages: DataFrame) -> DataFrame:
    """(book, content, error) of image pages (book, page, ext, data): a CBZ with pages in order; pages must run 1..n."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        if pdf["page"].tolist() != list(range(1, len(pdf) + 1)):
            return pd.DataFrame([(pdf["book"].iloc[0], None, "pages have gaps")], columns=["book", "content", "error"])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for page, ext, data in zip(pdf["page"], pdf["ext"], pdf["data"], strict=True):
                _put(z, f"{page:06d}{ext}", bytes(data), True)
        return pd.DataFrame([(pdf["book"].iloc[0], out.getvalue(), None)], columns=["book", "content", "error"])

    kind = pages.schema["book"].dataType.simpleString()
    return pages.groupBy("book").applyInPandas(make, f"book {kind}, content binary, error string")


def review_text(review: DataFrame, removed: DataFrame, title: str) -> DataFrame:
    """One row `text`: low-confidence lines (chapter, text, confidence), then removals (chapter, rule, text), each in order."""
    low = review.select(F.lit(0).alias("part"), "chapter", F.format_string("第 %d 章 [%.3f] %s", F.col("chapter"), F.col("confidence"), F.col("text")).alias("line"))
    gone = removed.select(F.lit(1).alias("part"), "chapter", F.concat(F.lit("第 "), "chapter", F.lit(" 章 ["), "rule", F.lit("] "), "text").alias("line"))
    rows = low.union(gone).agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "chapter", "line"))), lambda x: x["line"]).alias("l"))
    return rows.select(F.array_join(F.concat(F.array(F.lit(title)), "l"), "\n").alias("text"))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with `unique_name`: repeats of a name get (2), (3) ... in order."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("("), k, F.lit(")"))))
