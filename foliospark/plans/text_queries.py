"""Registered queries of the text operators. Chinese semantics run on literal rows that both engines know, with their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import curation as C
from foliospark.sources import tables as S

QUERIES, ORACLES = {}, {}
LINES = "(select doc_id, source, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos from documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(v) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def golden(name: str, rows: list[tuple], expression, kind: str, cast: str) -> None:
    """A query over literal inputs; its oracle is the table of expected values."""

    def run(spark, d):
        data = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, input string")
        return data.select("id", "input", expression(F.col("input")).cast(kind).alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = "select id::int id, input, value::" + cast + " as value from (values " + ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(rows)) + ") t(id, input, value)"


NOISE = [
    ("请记住本站域名 www.example.com", "站点提示"), ("http://ad.example.com/track?id=9", "网址行"), ("求推荐票，求收藏！", "求票推广"), ("本章未完，请点击下一页", "站点提示"), ("……", "符号行"), ("----", "符号行"), ("12345", "页码"),
    ("他抬头看见远山如黛。", None), ("“你来了。”他说。", None), ("第 3 章 起点", None), ("天才一秒记住本站地址：www.biquge-fake.cc", "站点推广"), ("（本章完）", "章节提示"), ("QQ群：123456", "社群推广"),
    ("ｗｗｗ．ｅｘａｍｐｌｅ．ｃｏｍ", "网址行"), ("example.com", "网址行"), ("本章未完，点击下一页继续阅读 >>> www.example-very-long-novel.com", None), ("‘求月票！’", None), ("「本章完」", None), ("最新章节请到我的梦里阅读。", None),
    ("=" * 58, "分隔线"), ("本书由知轩藏书整理", "站点推广"), ("更多的人请到后院去看看那座网球场", None), ("本书由他亲手整理成册", None), ("   ", None), ("第1/3页", "页码"), ("上一章 目录 下一章", "站点导航"), ("目录", "站点导航"),
    ("Copyright 2020 someone", "版权声明"), ("温馨提示：按回车返回书目", "站点提示"), ("笔趣阁", "站点标识"),
]
golden("noise_rules", NOISE, T.noise_rule, "string", "varchar")
golden("normalize_lines", [
    ("他 说,你好. 真的吗?", "他说，你好。真的吗？"), ("等等...", "等等……"), ("(测试)", "（测试）"), ("(hello)", "(hello)"), ("version 1.5, build 7", "version 1.5, build 7"), ("他走了。请记住本站域名", "他走了。"), ("他说:走吧...", "他说：走吧……"), ("中英 之间", "中英之间"), ("  a　b  ", "a b"), ("", ""),
], T.normalize_line, "string", "varchar")
golden("chapter_numbers", [
    ("第一章 起点", 1), ("第12章 转折", 12), ("第十二章 转折", 12), ("第二十三章 归来", 23), ("第 105 节", 105), ("Chapter 7", 7), ("7. 起点", 7), ("序章", None), ("第0章", None), ("第零章", None), ("第三万五千卷", 35000),
], T.chapter_number, "bigint", "bigint")
golden("cn_numerals", [("十", 10), ("十二", 12), ("二十", 20), ("二十三", 23), ("一百零五", 105), ("两千零一十", 2010), ("序", None), ("", None), ("一二三", 123), ("三万零七", 30007), ("零", None)], T.cn_number, "bigint", "bigint")
golden("site_suffix", [("第一章 起点_测试书城", "第一章 起点"), ("测试之书 - 某作者", "测试之书"), ("书名", "书名"), ("站点 | 第三章 归 | 书", "第三章 归")], T.strip_site_suffix, "string", "varchar")
golden("next_links", [("下一页", "page"), ("下一頁", "page"), ("Next Page", "page"), ("下一章", "chapter"), ("下一节", "chapter"), ("Next Chapter", "chapter"), ("目录", "none"), ("", "none")], T.classify_next, "string", "varchar")
golden("url_removal", [("看这里 http://a.com/x 吧", "看这里 吧"), ("去www.example.com看看", "去看看"), ("example.com 保留", "example.com 保留"), ("“www.a.com”", "“www.a.com”"), ("无", "无")], lambda c: T.remove_urls(c)["line"], "string", "varchar")
golden("site_signature", [("【起点中文网】", True), ("笔趣小说网首发", False), ("青山书库首发", True), ("他走进书城", False), ("“起点中文网”", False), ("普通句子。", False)], T.is_site_signature, "boolean", "boolean")
golden("headings", [("第一章 起点", True), ("第3卷", True), ("序章", True), ("Chapter 12 Dawn", True), ("第一章 他来了。", False), ("普通", False), ("第一章" + "长" * 40, False)], T.is_heading, "boolean", "boolean")
golden("sizes", [("50MB", 50_000_000), ("50MiB", 52_428_800), ("12", 12), ("1.5 KB", 1500), ("0", None), ("1.5", None), ("abc", None), ("2 TB", None)], T.parse_size, "bigint", "bigint")
golden("misread_fixes", [("他说｡走吧､", "他说。走吧、"), ("a", "a")], T.fix_misread, "string", "varchar")


@query("select doc_id, case when len(l) = 0 then 0 else (len(l) - len(list_distinct(l)))::double / len(l) end ratio from (select doc_id, string_split(text, chr(10)) l from documents)")
def repeated_line_ratio(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.repeated_line_ratio(F.split("text", "\n")).alias("ratio"))


@query(f"select doc_id, line, n, total::bigint total from (select *, sum(n) over (partition by doc_id) total from (select doc_id, line, count(*) n from {LINES} group by 1, 2)) where total >= 5 and n >= 3 and n / total > 0.6")
def spam_lines(spark, d):
    return C.spam_lines(S.lines(spark, d), "doc_id")


@query(f"select doc_id, pos::int pos, line from (select *, lag(line) over (partition by doc_id order by pos) b from {LINES}) where b = line")
def adjacent_dedup(spark, d):
    return C.adjacent_duplicates(S.lines(spark, d), "doc_id").select("doc_id", "pos", "line")


COPYRIGHT = r"^\s*(?:(?:copyright\b|©|版权所有).{0,80}|.{0,60}all rights reserved\.?)\s*$"
RULE = rf"""case when trim(line) = '' or regexp_matches(line, '[“”‘’「」『』"'']') then null when regexp_full_match(line, '[\W_]{{1,12}}') and not regexp_matches(line, '[\p{{L}}\p{{N}}]') then '符号行'
  when regexp_full_match(line, '[-—_=~*·#＝－]{{3,200}}[:：]?') then '分隔线' when regexp_matches(lower(line), '{COPYRIGHT}') then '版权声明' when regexp_full_match(line, '[\s\d]{{1,12}}') then '页码' end"""


@query(f"select rule, count(*) n from (select {RULE} rule from {LINES}) where rule is not null group by 1")
def noise_rule_histogram(spark, d):
    rule = T.noise_rule(F.col("line"))
    return S.lines(spark, d).select(rule.alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""with l as (select *, {RULE} rule from {LINES}), k as (select *, count(*) over (partition by doc_id) kept, count(*) over (partition by doc_id, line) n from l where rule is null and trim(line) <> ''),
  s as (select *, kept >= 5 and n >= 3 and n / kept > 0.6 spam from k), a as (select *, lag(line) over (partition by doc_id order by pos) b from s where not spam)
  select doc_id, count(*) kept_lines, sum(length(line))::bigint characters from a where b is null or b <> line group by 1""")
def clean_documents(spark, d):
    return C.clean_lines(S.lines(spark, d), "doc_id").where("clean is not null").groupBy("doc_id").agg(F.count("*").alias("kept_lines"), F.sum(F.length("clean")).alias("characters"))


def _books(spark, d):
    """Literal chapters with a signature line in 9 of 10, joined to the documents' lines."""
    rows = [("literal", i, 0, "【起点中文网】") for i in range(9)] + [("literal", i, 1, "他走了。") for i in range(10)] + [("few", i, 0, "【书海阅读网】") for i in range(4)]
    literal = spark.createDataFrame(rows, "source string, doc_id long, pos int, line string")
    return S.lines(spark, d).select("source", "doc_id", "pos", "line").unionByName(literal)


@query("select 'literal' source, '【起点中文网】' line, 9::bigint n")
def book_signatures(spark, d):
    lines = _books(spark, d)
    return C.site_signatures(lines, "source", "doc_id", lines.groupBy("source").agg(F.count_distinct("doc_id").alias("total")))


HEADERS = f"""select source, line, n from (select source, line, count(*) n from (select distinct source, doc_id, line from {LINES} where length(line) <= 30) group by 1, 2)
  join (select source, count(*) total from documents group by 1) using (source) where total >= 3 and n >= 3 and n / total > 0.05"""


@query(HEADERS)
def header_footer_lines(spark, d):
    return C.header_footer_lines(S.lines(spark, d), "source", "doc_id", 0.05)


PUNCT = r"[，。！？；：、“”‘’（）《》〈〉…—,.!?;:\"''()\[\]·]"
METRICS = rf"""select doc_id, length(regexp_replace(text, '\s+', '', 'g')) size, case when size = 0 then 0 else len(regexp_extract_all(regexp_replace(text, '\s+', '', 'g'), '{PUNCT}')) / size end punctuation,
  case when size = 0 then 0 else len(regexp_extract_all(text, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]')) / size end cjk from documents"""


@query(f"select doc_id, size::int size, punctuation::double punctuation, cjk::double cjk from ({METRICS})")
def text_metrics(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.length(T.dense(F.col("text"))).alias("size"), T.punctuation_density(F.col("text")).alias("punctuation"), T.cjk_ratio(F.col("text")).alias("cjk"))


@query(f"""with m as ({METRICS}), g as (select doc_id, case when size < 200 then 'too_short' when cjk < 0.3 and size < 800 then 'not_cjk_prose' when punctuation < 0.01 then 'looks_like_word_soup'
  when (len(string_split(text, chr(10))) - len(list_distinct(string_split(text, chr(10))))) / len(string_split(text, chr(10))) > 0.5 then 'template_repeat' else 'ok' end code from m join documents using (doc_id))
  select code, quality, count(*) n from g left join labels using (doc_id) group by 1, 2""")
def article_gate(spark, d):
    docs, labels = S.table(spark, d, "documents"), S.table(spark, d, "labels")
    coded = docs.select("doc_id", C.article_code(F.col("text"), F.split("text", "\n")).alias("code"))
    return coded.join(labels, "doc_id", "left").groupBy("code", "quality").agg(F.count("*").alias("n"))


@query(f"""with l as (select *, {RULE} rule from {LINES}), k as (select *, count(*) over (partition by doc_id) kept, count(*) over (partition by doc_id, line) n from l where rule is null and trim(line) <> ''),
  s as (select *, kept >= 5 and n >= 3 and n / kept > 0.6 spam from k), a as (select *, lag(line) over (partition by doc_id order by pos) b from s where not spam),
  f as (select * from a where b is null or b <> line), t as (select source, count(distinct doc_id) total from f group by 1),
  h as (select source, line from (select source, line, count(*) n from (select distinct source, doc_id, line from f where length(line) <= 30) group by 1, 2) join t using (source) where total >= 3 and n >= 3 and n / total > 0.05),
  r as (select source, rule from l where rule is not null union all select source, '章节刷屏' from s where spam union all select source, '相邻重复' from a where b = line),
  rr as (select source, sum(n)::bigint removed_lines, '{{' || string_agg('"' || rule || '":' || n, ',' order by rule) || '}}' removed_rules from (select source, rule, count(*) n from r group by 1, 2) group by 1)
  select f.source, count(distinct doc_id) chapters, count(*) kept_lines, sum(length(line))::bigint characters, coalesce(any_value(removed_lines), 0) removed_lines, coalesce(any_value(removed_rules), '{{}}') removed_rules
  from f left join rr using (source) where not exists (select 1 from h where h.source = f.source and h.line = f.line) group by 1""")
def chapter_report(spark, d):
    return C.chapter_report(S.lines(spark, d), 0.05)


FOLD = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(p_name, ''), lambda c: unicode(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"select p_partkey, ['#2E4A62', '#3D5A4C', '#7A2E2A', '#2B3A55', '#8A5A2B', '#4A3B52', '#5B6B3A', '#6E2F3F', '#3A4A4A', '#7B6A4A'][({FOLD} % 10 + 1)::int] color from part")
def title_color(spark, d):
    return S.table(spark, d, "part").select("p_partkey", T.cloth_color(F.col("p_name")).alias("color"))


#: Chapters in one part of txt_render.
PART = 16


@query(f"""select source book, part, sha256(case when part = 0 then source else '' end || string_agg(repeat(chr(10), 4) || '第 ' || chapter || ' 章' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)), '' order by chapter)
  || case when max(chapter) = max(last) then chr(10) else '' end) digest
  from (select *, (chapter - 1) // {PART} part from (select source, text, row_number() over (partition by source order by doc_id) chapter, count(*) over (partition by source) last from documents)) group by 1, 2""")
def txt_render(spark, d):
    """All chapters of every book, digested in parts, so that no row holds a book."""
    docs = S.table(spark, d, "documents")
    book = C.numbered(docs.select(F.col("source").alias("book"), "doc_id"), "book", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    book = book.select("book", "chapter", "last", F.concat(F.lit("第 "), F.col("chapter"), F.lit(" 章")).alias("heading"), F.split("text", "\n").alias("paragraphs"), F.lit(None).cast("string").alias("missing_reason"), F.lit("").alias("source_url"))
    return C.render_txt_parts(book, "book", PART).select("book", "part", F.sha2("text", 256).alias("digest"))
