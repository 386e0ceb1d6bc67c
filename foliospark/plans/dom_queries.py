"""Registered queries of the page operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.operators import curation as C
from foliospark.operators import dom as D
from foliospark.sources import tables as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select page_id, lower(tag) tag, count(*) n from (select page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<([A-Za-z][A-Za-z0-9-]*)', 1)) tag from pages) group by 1, 2")
def html_nodes_summary(spark, d):
    n = D.nodes(S.table(spark, d, "pages").select("page_id", "html"))
    return n.where("tag is not null").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1)) href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) title from pages")
def html_links(spark, d):
    found = D.css_select(S.table(spark, d, "pages"), "nav li > a[href]")
    return found.select("page_id", F.col("attrs")["href"].alias("href"), F.col("text").alias("title"))


@query()
def html_article(spark, d):
    a = D.articles(S.table(spark, d, "pages"))
    text = F.array_join("paragraphs", "\n")
    return a.select("page_id", "title", F.size("paragraphs").alias("n_paragraphs"), F.length(text).alias("n_chars"), F.bround("score", 6).alias("score"), C.article_code(text, F.col("paragraphs"), F.col("link_density")).alias("code"))


@query("select page_id, count(*) n, count(*) filter (internal) n_internal from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) h, true internal from pages) group by 1")
def html_anchor_counts(spark, d):
    a = D.anchors(S.table(spark, d, "pages")).where("tag = 'a'")
    return a.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("url") != "").alias("n_internal"))


SHOP = '<main class="reader"><img data-src="/1.jpg" src="/blank.gif"><picture><img srcset="/2.jpg 1x, /3.jpg 2x"></picture><img src="/t.png" width="92" height="87"></main><aside style="background:url(/bg.png)"></aside><a href="/full.JPG">x</a>'


@query("select * from (values ('http://h/1.jpg', 'img'), ('http://h/3.jpg', 'srcset'), ('http://h/bg.png', 'css'), ('http://h/full.JPG', 'anchor')) t(url, source)")
def html_image_candidates(spark, d):
    page = spark.createDataFrame([(1, "http://h/a", SHOP)], "page_id int, url string, html string")
    return D.image_candidates(page).select("url", "source")


@query("select n, tag from (values (1, 'img'), (2, 'img'), (3, 'img')) t(n, tag)")
def css_selectors(spark, d):
    page = spark.createDataFrame([(1, "http://h/a", SHOP)], "page_id int, url string, html string")
    return D.css_select(page, "main.reader > img, picture img").select(F.row_number().over(Window.partitionBy("page_id").orderBy("node")).alias("n"), "tag")
