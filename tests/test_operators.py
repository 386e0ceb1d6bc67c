"""Golden facts of operators that SQL doesn't cover."""

import gzip
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.functions import fixed_values as V
from foliospark.functions import text as T
from foliospark.functions import urls as U
from foliospark.operators import curation as C
from foliospark.operators import dom as D
from foliospark.operators import ledger as L
from foliospark.operators import links as K
from foliospark.operators import packing as P
from foliospark.operators import robots as R
from foliospark.sources import books as B
from foliospark.sources import sinks as W
from foliospark.streaming import settled as S


def test_fixed_values():
    assert [hex(ord(c)) for c in V.ZERO_WIDTH] == ["0x200b", "0x200c", "0x200d", "0x2060", "0xfeff"]
    assert len(V.CN_DIGITS) == len(V.CN_VALUES)


@pytest.mark.parametrize("text", ["1", "1-10", "1-10,15-20,103", "200-", "1-5,8-", " 1-3 , 5 ", "20000"])
def test_ranges(text):
    assert K.parse_ranges(text)


@pytest.mark.parametrize("text", ["", " ", "abc", "-", "1,,2", "1 - 3", "0", "0-5", "20001", "1-20001", "10-5", "1-5,3", "1-5,5-8", "1-3,2-", "5-,6", "5-,10-", "1.5", "1-2-3", "第1章", "1," * 150])
def test_wrong_ranges(text):
    with pytest.raises(ValueError):
        K.parse_ranges(text)


def clean(spark, lines, title=None):
    rows = [(1, i, x, title) for i, x in enumerate(lines)]
    out = C.clean_lines(spark.createDataFrame(rows, "doc_id long, pos int, line string, title string"), "doc_id", "title" if title else None)
    return [r.clean for r in out.orderBy("pos").collect() if r.clean is not None], [(r.rule, r.raw) for r in C.removal_log(out, "doc_id").orderBy("pos").collect()]


def test_clean_lines(spark):
    kept, log = clean(spark, ["", "他来了。", "他来了。", "请记住本站域名 www.example.com", "她走了。", *["刷屏行"] * 8])
    assert kept == ["他来了。", "她走了。"] or kept == ["他来了。", "他来了。", "她走了。"][:2]
    assert [r for r, _ in log].count("章节刷屏") == 8 and ("站点提示", "请记住本站域名 www.example.com") in log and ("相邻重复", "他来了。") in log
    assert clean(spark, ["第一章 起点", "正文内容。"], "第一章 起点_某书城")[0] == ["正文内容。"]
    kept, log = clean(spark, ["一。", "二。", "三。", "四。", "相关推荐", "尾巴"])
    assert kept == ["一。", "二。", "三。", "四。"] and [r for r, _ in log] == ["章末站点区块"] * 2
    kept, log = clean(spark, ["看http://a.com/x吧 他说。", "去 example.com 看看。"])
    assert kept[0] == "看吧 他说。" or "http" not in kept[0]
    assert [r for r, _ in log] == ["网址片段", "网址片段待复核"]


def test_signatures_and_headers(spark):
    rows = [("b", c, 0, "【起点中文网】") for c in range(5)] + [("b", c, 1, f"行{c}") for c in range(10)]
    lines = spark.createDataFrame(rows, "book string, chapter int, pos int, line string")
    totals = lambda n: spark.createDataFrame([("b", n)], "book string, total int")
    assert C.site_signatures(lines, "book", "chapter", totals(10)).count() == 1
    assert C.site_signatures(lines, "book", "chapter", totals(11)).count() == 0
    pages = spark.createDataFrame([("b", c, 0, "页眉书名" if c < 3 else "x") for c in range(4)], "book string, chapter int, pos int, line string")
    assert [r.line for r in C.header_footer_lines(pages, "book", "chapter").collect()] == ["页眉书名"]
    assert C.header_footer_lines(pages.where("chapter < 2"), "book", "chapter").count() == 0


PAGE = '<div id="a" class="wide tall" lang="en-US" data-x="head-middle-tail"><p>1<p>2<br>3<ul><li>x<li class="k"><b>y</b></ul></div><img src=1><script>var a="<p>"</script>'


@pytest.mark.parametrize(
    ("selector", "tags"),
    [("p", ["p", "p"]), ("div > p", ["p", "p"]), ("div li.k b", ["b"]), ("#a", ["div"]), (".wide.tall", ["div"]), ("[lang|=en]", ["div"]), ("[data-x^=head][data-x$=tail][data-x*=middle]", ["div"]), ("[class~=tall]", ["div"]), ("li, img", ["li", "li", "img"]), ("*", ["div", "p", "p", "br", "ul", "li", "li", "b", "img", "script"]), ("[data-x=head]", []), ("ul > b", [])],
)
def test_selectors(selector, tags):
    page = D.Page(PAGE)
    assert [page.tag[k] for k in D.select(page, D.compile_selector(selector))] == tags


@pytest.mark.parametrize("selector", ["", "p:first-child", "a + b", "a ~ b", "p >", "a,,b", "[x"])
def test_wrong_selectors(selector):
    with pytest.raises(ValueError):
        D.compile_selector(selector)


def test_articles():
    page = D.Page("<div><p>第一段</p><p>第二段<br>第三段</p><script>x</script><div>四</div></div>")
    assert D.paragraphs(page, 1) == ["第一段", "第二段", "第三段", "四"]
    text = "一二三四五六七八九十。" * 30
    a = D.article(f"<title>T - site</title><nav>菜单</nav><div id=content><p>{text}</p><p>尾</p><div class=comments>评论</div></div><div><p>{text * 2}</p></div>")
    assert a["paragraphs"] == [text, "尾"] and a["score"] > 0 and D.article(None)["paragraphs"] == []
    assert D.sanitize('<p onclick=x>a &lt;<a href="#n">b</a><a href="http://x">c</a><script>d</script></p>') == '<p>a &lt;<a href="#n">b</a><a>c</a></p>'


def test_continuations(spark):
    cases = [
        ("http://h/2.html", "http://h/2_2.html", True), ("http://h/2.html", "http://h/2-2.html", True), ("http://h/2.html", "http://h/3.html", False), ("http://h/2_2.html", "http://h/2_3.html", True),
        ("http://h/2_2.html", "http://h/2_4.html", False), ("http://h/2_2.html", "http://h/2-3.html", False), ("http://h/2_2.html", "http://h/2_3.htm", False), ("http://h/2_2.html?a=1", "http://h/2_3.html?a=2", False),
        ("http://h/2.html", "http://h/2_3.html", False), ("http://h/chapter_2.html", "http://h/chapter_3.html", False), ("http://h/r?id=9", "http://h/r?id=9&page=2", True), ("http://h/r?id=9&page=2", "http://h/r?page=3&id=9", True),
        ("http://h/r?id=9&page=2", "http://h/r?id=8&page=3", False), ("http://h/r?page=2", "http://h/r?p=3", False), ("http://h/r?page=0", "http://h/r?page=1", False), ("http://h/r?page=x", "http://h/r?page=2", False),
        ("http://h/r?page=1&p=1", "http://h/r?page=2&p=1", False), ("http://h/r?27", "http://h/r?27_2", True), ("http://h/r?27_2", "http://h/r?27_3", True), ("http://h/r", "http://h/r?_2", False),
        ("http://h/#/a/1", "http://h/#/a/1_2", True), ("http://h/#!/a?page=1", "http://h/#!/a?page=2", True), ("http://h/x#/a/1", "http://h/y#/a/1_2", False), ("http://h/#/a/1", "http://h/", False), ("http://h/2.html#top", "http://h/2_2.html", True),
    ]
    found = spark.createDataFrame(cases, "a string, b string, same boolean").select("a", "b", "same", U.continues(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b) for r in found if r.got is not r.same] == []


@pytest.mark.parametrize(
    ("rules", "path", "allowed"),
    [("Disallow: /a", "/a/b", False), ("Disallow: /a\nAllow: /a/b", "/a/b", True), ("Disallow: /a\nAllow: /a", "/a", True), ("Disallow: /*.jpg$", "/x.jpg", False), ("Disallow: /*.jpg$", "/x.jpg?y", True), ("Disallow: /a?", "/a?b", False), ("Disallow: /[0]", "/[0]", False), ("Disallow:", "/x", True), ("Disallow: x", "/x", True)],
)
def test_robots(spark, rules, path, allowed):
    files = spark.createDataFrame([("s", "User-agent: *\n" + rules)], "site string, body string")
    assert R.decide(spark.createDataFrame([("s", path)], "site string, url_path string"), R.robots_rules(files, "folio")).first().allowed is allowed


def test_ledger(spark):
    r = spark.createDataFrame([(1, 1, 1, "done", None, None, None, 0), (1, 1, 2, "failed", "x", 1, "weird", 0), (1, 0, 1, "pending", None, None, None, 0), (1, 1, 3, "lost", None, None, None, 0)], "task_id int, chapter int, page int, status string, sha256 string, size int, error_code string, attempts int")
    assert sorted(x.rule for x in L.constraint_violations(r).collect()) == ["done needs a file", "failure code", "position", "status"]
    manifest = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 1, 2), (1, 2, 1, 2), (1, 3, 2, 1)], "task_id int, seq int, chapter int, page int")
    assert [x.seq for x in L.order_violations(manifest, "task_id", "chapter", "page").collect()] == [2]
    prefix = spark.createDataFrame([(1, 1), (1, 3), (2, 2), (3, 1), (3, 2)], "t int, n int")
    assert sorted(map(tuple, L.contiguous_prefix(prefix, ["t"], "n").collect())) == [(1, 1), (3, 1), (3, 2)]
    moved = L.transition(r, F.col("page") == 1, "pending", "running")
    assert [x.status for x in moved.where("changed").collect()] == ["running"]


def test_bytes():
    assert B.decode_page("中文".encode("gb18030")) == "中文" and B.decode_page("é".encode("latin-1"), "text/html; charset=latin-1") == "é"
    assert B.decode_page(b'<meta charset="big5">' + "書".encode("big5")).endswith("書")
    assert B.decode_page(b"<meta http-equiv=content-type content='text/html; charset=gbk'>" + "书".encode("gbk"), "text/html; charset=no-such").endswith("书")
    assert B.decode_page(b"\xff\xfe" + "é".encode("utf-16-le"), "text/html; charset=latin-1") == "é" and B.decode_page(b"\xef\xbb\xbfa") == "a" and "\ufffd" in B.decode_page(b"a\xff\xff")
    data = b"x" * 100
    assert B.decode_body(gzip.compress(data) * 2, "gzip") == data * 2 and B.decode_body(zlib.compress(data), "deflate") == data
    assert B.decode_body(zlib.compress(data)[2:-4], "deflate") == data
    for bad, kind, most in ((gzip.compress(data)[:-3], "gzip", 1000), (gzip.compress(data), "gzip", 50), (zlib.compress(data) + b"z", "deflate", 1000), (data, "br", 1000)):
        with pytest.raises(ValueError):
            B.decode_body(bad, kind, most)
    assert B.decode_text("\ufeff a\r\nb".encode()) == " a\nb"
    with pytest.raises(ValueError):
        B.decode_text(b"a\0b")
    assert [B.safe_path(p) for p in ("a/b", "/a", "a/../b", "a\\b", "C:/x", "")] == [True, False, False, False, False, False]


def test_epub_round_trip(spark):
    chapters = spark.createDataFrame([("b", "书", "人", 2, "第二章", ["二"]), ("b", "书", "人", 1, "第一章", ["一 & 1"]), ("c", "t", "", 2, "h", ["x"])], "book string, title string, author string, chapter int, heading string, paragraphs array<string>")
    made = {r.book: r for r in W.epub_books(chapters).collect()}
    assert made["c"].error and made["b"].content == W.epub_bytes("书", "人", [("第一章", ["一 & 1"]), ("第二章", ["二"])])
    files = spark.createDataFrame([("x.epub", made["b"].content), ("bad.epub", b"no zip")], "path string, content binary")
    rows = B.epub_sections(files).orderBy("path", "index").collect()
    assert rows[0].error and [(r.title, r.author, r.heading) for r in rows[1:]] == [("书", "人", "第一章"), ("书", "人", "第二章")]


def test_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in ("p10.jpg", "p2.jpg", "__MACOSX/p1.jpg", ".h.png", "notes.txt", "P1.PNG"):
            z.writestr(n, b"x")
    rows = B.archive_pages(spark.createDataFrame([("a", out.getvalue())], "path string, content binary")).collect()
    assert [r.name for r in rows] == ["P1.PNG", "p2.jpg", "p10.jpg"]


def test_sections_and_names(spark):
    t = spark.createDataFrame([("a", "前面\n第一章 起\n甲\n第二章 落\n乙"), ("b", "字" * 8001)], "path string, text string")
    assert [(r.path, r.title, r.body) for r in B.text_sections(t).orderBy("path", "section").collect()] == [("a", None, "前面"), ("a", "第一章 起", "甲"), ("a", "第二章 落", "乙"), ("b", "第 1 段", "字" * 8000), ("b", "第 2 段", "字")]
    names = {"《春山》作者：青禾.txt": ("春山", "青禾"), "《春山》（青禾）.txt": ("春山", "青禾"), "春山 作者：青禾.txt": ("春山", "青禾"), "春山_青禾.txt": ("春山", "青禾"), "春山-青禾.txt": ("春山", "青禾"), "【整理】春山(精校版)[全本].TXT": ("春山", ""), "春山-2026.txt": ("春山-2026", "")}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", B.filename_metadata(F.col("n")).alias("m")).collect()
    assert {r.n: tuple(r.m) for r in rows} == names


def test_sniff(spark):
    heads = {b"\xff\xd8\xff\xe0": "jpeg", b"\x89PNG\r\n\x1a\n": "png", b"GIF89a": "gif", b"RIFF1234WEBP": "webp", b"BM12": "bmp", b"II*\0": "tiff", b"0000ftypavif": "avif", b"\xff\x0a": "jxl", b"x": ""}
    rows = spark.createDataFrame([(bytearray(h),) for h in heads], "b binary").select("b", T.sniff_format(F.col("b")).alias("f")).collect()
    assert {bytes(r.b): r.f for r in rows} == heads


def test_stream_emits_once(spark, tmp_path):
    schema = "task_id long, chapter long, page long, total long, status string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: S.run_available(S.settled_stream(S.replay(spark, str(tmp_path / "in"), schema)), str(tmp_path / "state"), str(tmp_path / "out"))
    read = lambda: sorted(map(tuple, spark.read.schema(S.OUT).parquet(str(tmp_path / "out")).collect()))
    put([(1, 1, 1, 2, "done"), (1, 2, 1, 1, "done"), (1, 2, 1, 1, "done"), (1, 3, 1, 2, "failed")])
    go()
    assert read() == [(1, 2, 1, 0, "done")]
    put([(1, 1, 2, 2, "done"), (1, 3, 2, 2, "failed"), (1, 2, 1, 1, "done")])
    go()
    go()
    assert read() == [(1, 1, 2, 0, "done"), (1, 2, 1, 0, "done"), (1, 3, 2, 2, "failed")]


def test_segments(spark):
    from foliospark.operators import library as Y

    text = ["前文", "第一卷 山", "第一章 起", "甲", "第一章 起", "乙", "第二章 落", "丙", "第二卷 水", "第一章 起", "丁"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)] + [(2, i, "字" * 3000) for i in range(7)], "doc_id int, pos int, line string")
    got = [(r.doc_id, r.chapter, r.title, r.n_paragraphs) for r in Y.segment_text(lines, "doc_id").orderBy("doc_id", "chapter").collect()]
    assert got == [(1, 1, "前言", 1), (1, 2, "第一卷 山 · 第一章 起", 2), (1, 3, "第二章 落", 1), (1, 4, "第二卷 水 · 第一章 起", 1), (2, 1, "第 1 段", 3), (2, 2, "第 2 段", 3), (2, 3, "第 3 段", 1)]


def test_volumes_hints_and_fonts(spark):
    from foliospark.operators import library as Y

    chapters = spark.createDataFrame([("a", i, f"u{i}") for i in range(1, 5)] + [("b", i, f"v{i}") for i in range(1, 5)], "book string, idx int, url string")
    labels = spark.createDataFrame([("u1", "上"), ("u2", "上"), ("u3", "下"), ("u4", "下"), ("v1", "上")], "url string, label string")
    rows = Y.labelled_volumes(chapters, labels, "book", "idx", 3).orderBy("book", "idx").collect()
    assert [(r.volume, r.label, r.fallback) for r in rows] == [(1, "上", False)] * 2 + [(2, "下", False)] * 2 + [(1, "第1卷", True)] * 3 + [(2, "第2卷", True)]
    books = spark.createDataFrame([("x", "http://h/a/", 1), ("y", "http://h/a", 2)], "book_id string, source_url string, created_at int")
    assert Y.library_hint(spark.createDataFrame([("http://h/a//",)], "url string"), books).first().book_id == "y"
    texts = spark.createDataFrame([(1, "天"), (2, ""), (3, "无")], "id int, text string")
    out = Y.map_private_use(texts, spark.createDataFrame([("", "青"), ("", "空")], "code string, han string"), "id")
    assert sorted((r.id, r.text, r.complete) for r in out.collect()) == [(1, "青天空", True), (2, "", False), (3, "无", True)]
    rules = spark.createDataFrame([("a.toml", b'host = "H.com"\nversion = 1\n'), ("b.toml", b'host = "x"\nrun = "rm"'), ("c.toml", b"=")], "path string, content binary")
    assert [(r.host, bool(r.error)) for r in Y.read_rules(rules).orderBy("path").collect()] == [("h.com", False), (None, True), (None, True)]


def test_scripts():
    from foliospark.functions import scripts as P

    assert P.unescape_js(r"\x41中\n\'") == "A中\n'"
    script = "eval(function(p,a,c,k,e,d){}('0 1=\\'2\\';',10,3,'var|x|y'.split('|'),0,{}))"
    assert P.packed_payload(script) == "var x='y';" and P.packed_payload("none") is None
    assert P.decompress_base64("BYUwNmD2Q===") in ("hello", None) and P.decompress_base64("!") is None and P.decompress_base64("Q===") == ""


def test_books_render_whole(spark):
    """Parts joined give render_txt's text, and hold every chapter: a cap of five would fail here."""
    docs = spark.createDataFrame([(b, i, f"{b} {i}\nmore") for b, n in (("a", 41), ("b", 3)) for i in range(n)], "book string, doc_id long, text string").repartition(5)
    book = C.numbered(docs, "book", "doc_id")
    assert sorted((r.book, r.chapter, r.doc_id, r.last) for r in book.collect()) == [(b, i + 1, i, n) for b, n in (("a", 41), ("b", 3)) for i in range(n)]
    missing = F.when(F.col("chapter") == 2, F.lit("gone"))
    book = book.select("book", "chapter", "last", F.concat(F.lit("# "), F.col("chapter")).alias("heading"), F.split("text", "\n").alias("paragraphs"), missing.alias("missing_reason"), F.lit("u").alias("source_url"))
    whole = {r.book: r.text for r in C.render_txt(book, "book").collect()}
    parts = {b: "".join(r.text for r in sorted(C.render_txt_parts(book, "book", 4).where(F.col("book") == b).collect(), key=lambda r: r.part)) for b in whole}
    assert parts == whole and all(f"# {k}\n" in parts["a"] for k in range(1, 42))


def test_plain_lines_pass_cleaning_as_they_are(spark):
    """is_plain() spares lines all passes: whatever it says yes to, each pass must leave alone, however odd the line's parts."""
    bits = ["", " ", "\t", "　", "​", "...", "…", "。", "www.abc.com", "abc.com", "A.bc", "©", "COPYRIGHT", "all rights reserved", "all rightſ reserved", "Kom.top", "第1章", "12", "求推荐票", '"', "–", "é", "Ж", "\x85", "e.g. this", "3.14", "the cat sat"]
    rows = [(a + m + b,) for a in bits for m in (" ", " word ") for b in bits] + [(None,), ("",), ("word",), ("the cat sat",)]
    line = F.col("line")
    seen = spark.createDataFrame(rows, "line string").select(
        "line", T.is_plain(line).alias("plain"), T.judged_line(line).alias("j"), T.noise_rule(T._tight(line)).alias("rule"), T.normalize_line(line).alias("clean"), T.remove_urls(line)["n"].alias("n"), T.has_url(line).alias("url"), T.inline_notice_only(line).alias("notice"),
    ).collect()
    plain = [r for r in seen if r["plain"]]
    assert len(plain) >= 20 and {"the cat sat", "é word Ж"} <= {r["line"] for r in plain}
    for r in plain:
        assert (r["rule"], r["clean"], r["n"], r["url"], r["notice"]) == (None, r["line"], 0, False, False)
        assert tuple(r["j"]) == (None, r["line"], None)
    assert {"求推荐票 ", " abc.com", "", None} <= {r["line"] for r in seen if not r["plain"]}


def test_books_over_many_ranges(spark):
    """Places, runs and volumes of books that stand in several ranges are those of a plain pass; null books and labels count like any other."""
    rows = [(b, k, None if (k // n) % 3 == 2 else "abc"[(k // n) % 3]) for b, n in (("hot", 25), ("x", 1), (None, 4)) for k in range(200 if b == "hot" else 12)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = spark.createDataFrame(rows, "book string, k int, label string")
        assert C.ranged(t, "book", "k").where("book = 'hot'").select("__slot").distinct().count() > 1
        runs = {(r["book"], r["k"]): r["volume"] for r in K.run_volumes(t, "book", "k", "label").collect()}
        fixed = {(r["book"], r["k"]): (r["volume"], r["label"]) for r in K.fixed_volumes(t.drop("label"), "book", "k", 9).collect()}
        places = {(r["book"], r["k"]): (r["chapter"], r["last"]) for r in C.numbered(t, "book", "k").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    count = {b: sum(r[0] == b for r in rows) for b in ("hot", "x", None)}
    volume, before = {}, {}
    for b, k, label in rows:
        volume[b] = volume.get(b, 0) + (b not in before or before[b] != label)
        before[b] = label
        assert runs[b, k] == volume[b] and places[b, k] == (k + 1, count[b])
        wide = len(str((count[b] - 1) // 9 + 1))
        assert fixed[b, k] == (k // 9 + 1, f"第{str(k // 9 + 1).zfill(wide)}卷")
    assert len(runs) == len(fixed) == len(places) == len(rows)


def test_packing_over_many_ranges(spark):
    """Volumes of books that stand in several ranges are those of the plain fold; sizes of zero, null and beyond the limit included."""
    import random

    rng, limit = random.Random(7), 10
    rows = [(b, k, rng.choice([0, None, 1, 2, 3, 5, 9, 10, 11, 40])) for b, n in (("hot", 400), ("x", 1), (None, 30), ("zero", 20)) for k in range(n)]
    rows = [(b, k, 0 if b == "zero" else s) for b, k, s in rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = spark.createDataFrame(rows, "book string, k int, bytes int")
        got = {(r["book"], r["k"]): r["volume"] for r in P.pack_by_size(t, "book", "k", "bytes", limit).collect()}
        assert P.pack_by_size(t.limit(0), "book", "k", "bytes", limit).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    states = {}
    for b, k, s in rows:
        used, volume = states.get(b, (0, 1))
        states[b] = (used + (s or 0), volume) if used == 0 or used + (s or 0) <= limit else (s or 0, volume + 1)
        assert got[b, k] == states[b][1]
    assert len(got) == len(rows)
