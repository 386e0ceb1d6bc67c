"""URL functions as Column expressions over the parts of an address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import fixed_values as V

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(url, _PARTS, k)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def port(url: Column) -> Column:
    given = F.regexp_extract(part(url, 2), ":([0-9]+)$", 1).try_cast("int")
    return F.coalesce(given, F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80))


def path(url: Column) -> Column:
    return part(url, 3)


def route_fragment(url: Column) -> Column:
    return F.when(part(url, 5).rlike("^!?/"), part(url, 5)).otherwise("")


def is_usable(url: Column) -> Column:
    s = F.trim(url)
    known = (scheme(s) == "") | (scheme(s).isin("http", "https") & (host(s) != ""))
    return F.coalesce((s != "") & ~s.startswith("#") & known & ~part(s, 2).contains("@"), F.lit(False))


def normalize(url: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(url), F.lit(" "), F.lit("%20")), "#.*$", "")


def same_host(a: Column, b: Column) -> Column:
    bare = lambda u: F.regexp_replace(host(u), r"^www\.", "")
    return (host(a) != "") & (host(b) != "") & (bare(a) == bare(b))


def same_origin(a: Column, b: Column) -> Column:
    return scheme(a).isin("http", "https") & (host(a) != "") & (scheme(a) == scheme(b)) & (host(a) == host(b)) & (port(a) == port(b))


def page_key(url: Column) -> Column:
    return F.struct(scheme(url).alias("scheme"), host(url).alias("host"), F.coalesce(port(url), F.lit(80)).alias("port"), F.when(path(url) == "", "/").otherwise(path(url)).alias("path"), part(url, 4).alias("query"), route_fragment(url).alias("route"))


def path_ext(url: Column) -> Column:
    name = F.regexp_extract(F.try_url_decode(path(url)), r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    return F.when(F.length(ext) <= 6, ext).otherwise("")


def redact(url: Column) -> Column:
    authority = F.regexp_replace(part(url, 2), "^.*@", "")
    lead = F.when(part(url, 1) != "", F.concat(scheme(url), F.lit("://"))).when(authority != "", "//").otherwise("")
    return F.concat(lead, authority, path(url), F.when(part(url, 4) != "", "?...").otherwise(""))


def signature(url: Column) -> Column:
    """Digit runs, and long tokens of mixed letters and digits, as #: addresses of one family are equal."""
    token = r"(?<![A-Za-z0-9])(?![A-Za-z]+[0-9]+(?![A-Za-z0-9]))(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{8,}"
    return F.regexp_replace(F.regexp_replace(url, token, "#"), r"(?U)\d+", "#")


def is_category(url: Column) -> Column:
    return path(url).rlike(V.CATEGORY_PATH)


def is_namespace(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1).contains(":")


def guess_kind(url: Column, text: Column, titles: Column) -> Column:
    """manga or novel: address, page text and chapter titles each give points; ties are novels."""
    target = F.concat(host(url), path(url))
    share = lambda p: F.when(F.size(titles) > 0, (2 * F.size(F.filter(titles, lambda t: t.rlike(p))) >= F.size(titles)).cast("int")).otherwise(0)
    points = lambda pattern, words, mark: 2 * target.rlike(pattern).cast("int") + 2 * F.coalesce(text.rlike(words), F.lit(False)).cast("int") + share(mark)
    return F.when(points(V.MANGA_URL, "漫画|漫畫", "[话話]") > points(V.NOVEL_URL, "小说|小說", "章"), "manga").otherwise("novel")


def _follows(x: Column, y: Column, deep: bool = False) -> Column:
    """Whether y is x with the number behind its last _ or - raised by one; a text without such a number is page 1.

    deep: what stands before the mark must end in a digit, or the number counts chapters and not pages of one.
    """
    head = lambda t: F.regexp_extract(t, r"(?s)^(.*[_-])[0-9]+$", 1)
    last = lambda t: F.regexp_extract(t, "([0-9]+)$", 1).try_cast("decimal(30,0)")
    onward = (head(x) == head(y)) & (last(y) == last(x) + 1)
    if deep:
        onward = onward & head(x).rlike(r"\p{Nd}[_-]$") & (last(x) > 0)
    return F.when(head(x) == "", (x != "") & head(y).isin(F.concat(x, F.lit("_")), F.concat(x, F.lit("-"))) & (last(y) == 2)).otherwise(onward)


def _same_but_page(path: Column, query: Column, next_path: Column, next_query: Column) -> Column:
    """Whether path and query differ from the next ones in one page number alone."""
    params = lambda q: F.transform(F.filter(F.split(q, "&"), lambda x: x != ""), lambda x: F.coalesce(F.try_url_decode(x), x))
    counts = lambda x: F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(*V.PAGE_PARAMS)
    rest = lambda q: F.array_sort(F.filter(params(q), lambda x: ~counts(x)))
    counter = lambda q: F.filter(params(q), counts)
    name = lambda c: F.split_part(F.get(c, F.lit(0)), F.lit("="), F.lit(1))
    number = lambda c: F.regexp_extract(F.get(c, F.lit(0)), "=([0-9]+)$", 1).try_cast("decimal(30,0)")
    stem, ext = (lambda p, k=k: F.regexp_extract(p, r"(?s)^(.*?)(\.[^./]*)?$", k) for k in (1, 2))
    a, b = counter(query), counter(next_query)
    in_path = (F.array_sort(params(query)) == F.array_sort(params(next_query))) & (ext(path) == ext(next_path)) & _follows(stem(path), stem(next_path), True)
    first = F.when(F.size(a) == 0, F.lit(1)).when((F.size(a) == 1) & (name(a) == name(b)), number(a))
    in_param = (F.size(b) == 1) & (rest(query) == rest(next_query)) & (first > 0) & (number(b) == first + 1)
    in_query = F.when((F.size(a) == 0) & (F.size(b) == 0), _follows(query, next_query)).otherwise(in_param)
    return F.coalesce(F.when(path == next_path, in_query).otherwise(in_path), F.lit(False))


def continues(current: Column, candidate: Column) -> Column:
    """Whether candidate is the next page of current.

    An address numbers its page in one place: a page parameter, the end of a bare query, or the end of the path's stem; all
    else is equal. Of addresses with different hash routes the routes are compared, as paths with queries of their own.
    """
    place = lambda u, k: F.coalesce(part(u, k), F.lit(""))
    routes = [F.regexp_replace(F.when(place(u, 5).rlike("^!?/"), place(u, 5)).otherwise(""), "^!", "") for u in (current, candidate)]
    outer = [place(u, k) for u in (current, candidate) for k in (3, 4)]
    inner = [x for r in routes for x in (F.regexp_extract(r, r"(?s)^([^?]*)", 1), F.regexp_extract(r, r"(?s)\?(.*)$", 1))]
    hashed = (routes[0] != "") & (routes[1] != "") & (outer[0] == outer[2]) & (outer[1] == outer[3]) & _same_but_page(*inner)
    return F.when(routes[0] == routes[1], _same_but_page(*outer)).otherwise(hashed)
