"""Registered queries of the library relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.functions import scripts as J
from foliospark.operators import library as B
from foliospark.plans import text_queries
from foliospark.plans.text_queries import LINES, golden
from foliospark.sources import tables as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _golden(name, *args):
    golden(name, *args)
    QUERIES[name], ORACLES[name] = text_queries.QUERIES.pop(name), text_queries.ORACLES.pop(name)


_golden("safe_filenames", [("第1/2话", "第1／2话"), ("a\tb  c", "a b c"), ("..x..", "x"), ("", "untitled"), ("con", "_con"), ("长" * 120, "长" * 73), ("x?", "x？")], B.safe_filename, "string", "varchar")
_golden("player_urls", [("http://a/x", "http://a/x"), ("http%3A%2F%2Fa%2Fx", "http://a/x"), ("aHR0cCUzQSUyRiUyRmElMkZ5", "http://a/y"), ("zz", None)], J.player_url, "string", "varchar")
_golden("script_images", [('var a=["/1.jpg","/2.jpg"]', 2), ("x=['a.png','b.png','c.png',]; y=[\"1.jpg\",\"2.jpg\"]", 3), ('["a.jpg"]', None), ('["a","b"]', None)], lambda c: F.size(J.array_images(c)), "int", "int")


@query("select page_id, null::varchar kind from pages where not regexp_matches(url, 'qidian') union all select -1, 'novel' union all select -2, 'manga' union all select -3, null")
def host_kinds(spark, d):
    extra = spark.createDataFrame([(-1, "https://www.qidian.com/book/1"), (-2, "https://ac.qq.com/ComicView/1"), (-3, "https://ac.qq.com/")], "page_id long, url string")
    return B.expected_kind(S.table(spark, d, "pages").select("page_id", "url").union(extra)).select("page_id", "kind")


FOLLOWS = "(select source book_id, greatest(1, count(*) - 3)::bigint chapters, case when source < 'src5' then 'stale' else '' || max(doc_id) filter (k = n - 3) end last_title from (select source, doc_id, row_number() over (partition by source order by doc_id) k, count(*) over (partition by source) n from documents) group by 1)"


@query(f"""with c as (select source book_id, row_number() over (partition by source order by doc_id) idx, '' || doc_id title from documents), f as (select * from {FOLLOWS}),
  n as (select book_id, count(*) n from c group by 1) select f.book_id, f.chapters, f.last_title, n.n remote_count, coalesce(c.title = f.last_title, false) remote_match, case when coalesce(c.title = f.last_title, false) then greatest(0, n.n - f.chapters) else 0 end::bigint updates
  from f left join n using (book_id) left join c on c.book_id = f.book_id and c.idx = f.chapters""")
def follow_compare(spark, d):
    w = Window.partitionBy("source")
    docs = S.table(spark, d, "documents").select(F.col("source").alias("book_id"), F.row_number().over(w.orderBy("doc_id")).cast("long").alias("idx"), F.col("doc_id").cast("string").alias("title"), F.count("*").over(w).alias("n"))
    follows = docs.groupBy("book_id").agg(F.greatest(F.lit(1), F.first("n") - 3).cast("long").alias("chapters"), F.max(F.when(F.col("idx") == F.col("n") - 3, F.col("title"))).alias("last_title"))
    follows = follows.withColumn("last_title", F.when(F.col("book_id") < "src5", "stale").otherwise(F.col("last_title")))
    return B.compare_follows(follows, docs.select("book_id", "idx", "title"))


@query("""with b as (select o_custkey book_id, o_orderdate, o_orderkey, sha256('' || (o_orderkey % 50)) h from orders) select u.n upload, sha256('' || u.n) sha256, (select max_by(book_id, o_orderkey + epoch(o_orderdate) * 1000000) from b where h = sha256('' || u.n)) book_id from (select unnest(range(60)) n) u""")
def duplicate_uploads(spark, d):
    o = S.table(spark, d, "orders")
    hashed = lambda c: F.sha2(c.cast("string"), 256)
    books = o.select(F.col("o_custkey").alias("book_id"), F.struct("o_orderdate", "o_orderkey").alias("created_at"), F.array(F.struct(hashed(F.col("o_orderkey") % 50).alias("sha256"))).alias("artifacts"))
    uploads = spark.range(60).select(F.col("id").alias("upload"), hashed(F.col("id")).alias("sha256"))
    return B.duplicate_by_hash(books, uploads).select("upload", "sha256", "book_id")


@query("with p as (select o_orderkey % 7 k, o_custkey % 5 trial, max(o_totalprice) m from orders group by 1, 2), r as (select *, row_number() over (partition by k order by case when m <= 300000 then 0 else 1 end, case when m <= 300000 then 0 else m end, trial) n from p) select k, trial from r where n = 1")
def trial_choice(spark, d):
    o = S.table(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("k"), (F.col("o_custkey") % 5).alias("trial"), F.col("o_totalprice").alias("bytes"))
    return B.choose_trial(o, "k", 300000)


@query(f"""with recursive l as (select doc_id, trim(line) line, row_number() over (partition by doc_id order by pos) k from {LINES} where trim(line) <> ''),
  r as (select doc_id, k, length(line) size, length(line) filled, 1 part from l where k = 1
    union all select l.doc_id, l.k, length(l.line), case when r.filled >= 2000 then 0 else r.filled end + length(l.line), r.part + (r.filled >= 2000)::int from r join l on l.doc_id = r.doc_id and l.k = r.k + 1)
  select doc_id, part chapter, '第 ' || part || ' 段' title, count(*)::int n_paragraphs, sum(size)::bigint n_chars from r group by 1, 2""")
def text_segments(spark, d):
    return B.segment_text(S.lines(spark, d), "doc_id", 2000)


@query(f"""with l as (select doc_id, pos, trim(line) line, max(pos) over (partition by doc_id) last from {LINES}), body as (select doc_id, pos // 4 part, pos // 12 volume, line, last from l where line <> ''),
  many as (select doc_id, part, case when part % 3 = 0 then '第' || volume + 1 || '卷 · ' else '' end || '第' || part + 1 || '章 起' title, count(*)::int n, sum(length(line))::bigint c from body where last >= 2 group by all),
  few as (select doc_id, count(*)::int n, sum(length(line))::bigint c from (select doc_id, line from l union all select doc_id, '第1卷' from l where pos = 0 union all select doc_id, '第1章 起' from l where pos = 0) where line <> '' and doc_id in (select doc_id from l where last < 2) group by 1)
  select doc_id, (row_number() over (partition by doc_id order by part))::int chapter, title, n n_paragraphs, c n_chars from many union all select doc_id, 1, '第 1 段', n, c from few""")
def heading_segments(spark, d):
    """A chapter's heading before every fourth line and once more two lines later, a volume's before every twelfth; under three headings the text is one part."""
    lines = S.lines(spark, d)
    chapter = F.concat(F.lit("第"), F.floor(F.col("pos") / 4) + 1, F.lit("章 起"))
    volume = F.concat(F.lit("第"), F.floor(F.col("pos") / 12) + 1, F.lit("卷"))
    heads = F.array(F.when(F.col("pos") % 12 == 0, volume), F.when(F.col("pos") % 2 == 0, chapter), F.col("line"))
    put = lines.select("doc_id", F.col("pos").alias("at"), F.posexplode(heads).alias("k", "line")).where("line is not null")
    return B.segment_text(put.select("doc_id", (F.col("at") * 3 + F.col("k")).alias("pos"), "line"), "doc_id", 1 << 30)


@query("select k, width from (values ('s', 690)) t(k, width)")
def strip_books(spark, d):
    rows = [("s", i, 690, 1600) for i in range(10)] + [("s", 10, 90, 1600), ("n", 1, 800, 1200), ("n", 2, 800, 1200)]
    return B.strip_width(spark.createDataFrame(rows, "k string, page int, width int, height int"), "k")


@query("select page, ocr from (values (1, true), (2, false), (3, true), (4, false)) t(page, ocr)")
def ocr_pages(spark, d):
    images = spark.createDataFrame([(1, None), (2, 10_000), (3, 500_000), (4, None)], "page int, area long")
    return B.needs_ocr(images, spark.createDataFrame([(1, 10), (2, 10), (3, 100), (4, 500)], "page int, n_chars int"))
