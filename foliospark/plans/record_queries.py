"""Registered queries of image headers and JSON records, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import records as J
from foliospark.sources import image_headers as I
from foliospark.sources import tables as S

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _big(c, digits):
    return F.lpad(F.hex(c), digits, "0")


def _little(c, digits):
    h = _big(c, digits)
    return F.concat(*[F.substring(h, digits - 1 - k, 2) for k in range(0, digits, 2)])


_W, _H = "(l_partkey % 5000 + 1)", "(l_suppkey * 37 % 9000 + 1)"


@query(f"""select l_orderkey, l_linenumber, case l_orderkey % 6 when 0 then 'png' when 1 then 'gif' when 2 then 'bmp' when 3 then 'webp' when 4 then 'jpeg' end format,
  case when l_orderkey % 6 < 5 then {_W} else 0 end::int width, case when l_orderkey % 6 < 5 then {_H} else 0 end::int height, l_orderkey % 6 < 5 and l_linenumber % 3 > 0 complete,
  l_orderkey % 6 < 5 and {_W} * {_H} <= 16000000 allowed from lineitem""")
def image_headers(spark, d):
    """A header of each line's format and dimensions is written byte by byte; every third line lacks its last byte."""
    w, h, k = F.expr(_W), F.expr(_H), F.col("l_orderkey") % 6
    lit = F.lit
    png = F.concat(lit("89504E470D0A1A0A0000000D49484452"), _big(w, 8), _big(h, 8), lit("080200000000000000" + "00000001494441540000000000" + "0000000049454E44AE426082"))
    gif = F.concat(lit("474946383961"), _little(w, 4), _little(h, 4), lit("0000003B"))
    bmp = F.concat(lit("424D1B000000000000001A0000000C000000"), _little(w, 8), _little(h, 8), lit("00"))
    webp = F.concat(lit("524946461700000057454250565038580A00000000000000"), _little(w - 1, 6), _little(h - 1, 6), lit("00"))
    jpeg = F.concat(lit("FFD8FFE000040000FFFFC0000B08"), _big(h, 4), _big(w, 4), lit("01011100FFDA0008010100003F0000FFD9"))
    made = F.when(k == 0, png).when(k == 1, gif).when(k == 2, bmp).when(k == 3, webp).when(k == 4, jpeg).otherwise("4E6F20696D616765")
    whole = F.unhex(made)
    content = F.when(F.col("l_linenumber") % 3 == 0, F.substring(whole, 1, F.octet_length(whole) - 1)).otherwise(whole)
    files = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", content.alias("content"))
    return I.probe_images(files).withColumn("allowed", I.may_decode(F.col("width"), F.col("height")))


_RECORDS = """case o_orderkey % 6 when 0 then '{"b": ' || o_custkey || ', "a": "é"}' when 1 then '{"a":1,"a":' || o_custkey || '}' when 2 then '{"a":NaN}'
  when 3 then '[' || o_custkey || ']' when 4 then '{"z":[' || o_custkey || ', {"y":null, "x":true}]}' else '{"a":' || o_custkey end"""


@query("""select o_orderkey, case o_orderkey % 6 when 0 then '{"a":"' || chr(92) || 'u00e9","b":' || o_custkey || '}' when 4 then '{"z":[' || o_custkey || ',{"x":true,"y":null}]}' end record from orders""")
def strict_records(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", J.canonical_json(F.expr(_RECORDS)).alias("record"))


@query("""select o_orderkey, sha256('{"dpi": 150, "formats": ["pdf", "cbz"], "keep_images": ' || (o_custkey % 2 = 0)::varchar || ', "task_id": "' || o_custkey || '", "title": "' || o_orderstatus || '"}') export_key from orders""")
def export_keys(spark, d):
    task = F.struct(F.col("o_orderstatus").alias("title"), F.col("o_custkey").cast("string").alias("task_id"), (F.col("o_custkey") % 2 == 0).alias("keep_images"), F.array(F.lit("pdf"), F.lit("cbz")).alias("formats"), F.lit(150).alias("dpi"))
    return S.table(spark, d, "orders").select("o_orderkey", J.export_key(F.to_json(task)).alias("export_key"))


@query("""with l as (select l_orderkey page, l_partkey item, l_suppkey title, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 k, l_returnflag from lineitem)
  select page, (row_number() over (partition by page order by k) - 1)::int pos, item::varchar item, 'T{' || title || '}' title from l where page % 4 > 0 and page not in (select page from l where page % 4 = 1 and item % 10 = 0)""")
def embedded_catalogues(spark, d):
    """Pages with a volume a line; pages of 4 hold no list, in pages of 4 + 1 an item that ends in 0 has a number that is no string, which voids the page."""
    li = S.table(spark, d, "lineitem")
    number = F.when((F.col("l_orderkey") % 4 == 1) & (F.col("l_partkey") % 10 == 0), F.col("l_partkey").cast("string")).otherwise(F.concat(F.lit('"'), "l_partkey", F.lit('"')))
    chapter = F.concat(F.lit('[{"title":"T{'), "l_suppkey", F.lit('}","itemId":'), number, F.lit("}]"))
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", chapter.alias("chapter"))))
    pages = li.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(rows["chapter"], ", ").alias("list"))
    key = F.when(F.col("page") % 4 == 0, "other").otherwise("chapterListWithVolume")
    html = F.concat(F.lit('<script>window.state={"x":{},"'), key, F.lit('":['), "list", F.lit('],"y":"]"};</script>'))
    return pages.select("page", F.posexplode(J.embedded_chapters(html)).alias("pos", "c")).select("page", "pos", "c.item", "c.title")
