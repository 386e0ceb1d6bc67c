"""HTML pages as sequences of leaf blocks with their ancestors: a tolerant scanner, and the features of a block."""

from __future__ import annotations

import html
import re

#: What a page consists of; elements whose content is no text are one token, a self-closed svg or math is empty. Quantifiers are possessive: no backtracking.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    r"|<(script|style|template|title|noscript|iframe|object|svg|math|canvas|audio|video|noframes)(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td textarea tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that ends where one of these begins.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: Words of class, id and role by what they tell, where all of a name is known; SURE ones tell it beside any other word.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion banner outbrain taboola dfp",
    "nav": "nav navs navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager toc tabs sitemap skip",
    "head": "header head masthead topbar logo branding",
    "foot": "footer foot colophon copyright imprint contentinfo",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular teaser teasers complementary",
    "notice": "notice notices cookie cookies consent gdpr alert alerts popup modal newsletter subscribe subscription paywall disclaimer toast overlay",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses feedback forum",
    "form": "form forms search login signin signup register",
    "social": "share sharing social follow tags rating print",
    "content": "article content contents post entry story text paragraph prose document",
}
SURE = frozenset("advertisement adsense adslot outbrain taboola navbar navigation breadcrumb breadcrumbs masthead footer colophon sidebar cookie cookies gdpr newsletter paywall comments commentlist disqus".split())
#: Words of layout, which leave what the other words of a name tell as it is.
LAYOUT = frozenset(
    "area bar block body bottom box button buttons center col column columns container footer grid group header holder inner item items label left level line link links list main menu "
    "more most page panel posts primary recent right row secondary section site slot small the title top unit view wide wrap wrapper".split()
)
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
_ANCESTORS = "article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header label li main menu nav ol p pre section select table td textarea th ul button details dialog option".split()
_IN_ARTICLE = ("header", "footer", "aside", "nav", "form", "section", "figure", "table")
FEATURES = {
    name: k
    for k, name in enumerate(
        ["bias", *(f"in:{t}" for t in _ANCESTORS), *(f"own:{t}" for t in _ANCESTORS), *(f"hint:{h}" for h in HINTS), *(f"near:{h}" for h in HINTS), *(f"weak:{h}" for h in HINTS)]
        + [f"article>{t}" for t in _IN_ARTICLE] + [f"words:{k}" for k in range(6)] + [f"links:{k}" for k in range(4)]
        + ["stop", "commas", "mark:©", "mark:bar", "upper", "first", "last", "bare", "negative", "clean", "wrapped"]
    )
}
_NEGATIVE_TAGS = frozenset("nav footer aside form menu select button textarea dialog fieldset label option".split())
#: The share of a page's text from which on an element that holds its heading is a wrapper, whatever it is called.
WRAPPER = 0.5


class Level:
    """An open element: tag, what its names tell for sure and perhaps, its text's length, and whether it holds a heading or main part."""

    __slots__ = ("chars", "main", "sure", "tag", "weak")

    def __init__(self, tag: str, sure: tuple[str, ...], weak: tuple[str, ...]):
        self.tag, self.sure, self.weak, self.chars, self.main = tag, sure, weak, 0, False


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: text with references decoded and white space made one space, and the Levels above it.

    Blocks end where a block element begins or ends, and at br. Text in noscript is none: it asks for scripts or repeats them.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[Level] = []
    parts: list[str] = []
    links = linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
                for level in stack:
                    level.chars += len(text)
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m[2] else 1
        elif tag == "br":
            flush()
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            else:
                if stack and stack[-1].tag == "p":
                    stack.pop()
                elif stack and tag in CLOSED_BY.get(stack[-1].tag, ()):
                    stack.pop()
                if tag not in VOID_TAGS and not m[4].endswith("/"):
                    level = Level(tag, *(hints(m[4]) if m[4] else ((), ())))
                    if tag in ("h1", "main") or (tag == "article" and "comment" not in level.sure):
                        for above in stack:
                            above.main = True
                    stack.append(level)
        elif tag in ("span", "font") and m[4] and not m[2]:
            continue
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def hints(attributes: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """What class, id and role tell for sure, and what they may tell: names of which some words are unknown."""
    sure, weak = [], []
    for m in ATTRIBUTE.finditer(attributes):
        for name in re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").replace("_", "-").split() if m[0] else ():
            words = re.findall(r"[a-z]{2,}", name.lower())
            told = [h for w in words if (h := HINT_OF.get(w))]
            if not told:
                continue
            plain = all(w in HINT_OF or w in LAYOUT for w in words) or any(w in SURE for w in words)
            if "content" in told and set(told) <= {"content", "head"}:
                told = ["content"]  # an entry's header holds its heading
            elif any(h != "content" for h in told):
                told = [h for h in told if h != "content"]
            for h in told:
                kept = sure if plain else weak
                if h not in kept:
                    kept.append(h)
    return tuple(sure), tuple(weak)


_PATHS: dict[tuple, list[int]] = {}


def path_features(path: tuple) -> list[int]:
    """Features of the ancestors (tag, sure, weak, wrapper); pages share most paths, so they are kept (up to a bound).

    A wrapper's names tell nothing, and neither does a form that wraps the page. Names tell more the nearer they stand.
    """
    if (known := _PATHS.get(path)) is not None:
        return known
    names = {"bias"}
    near = None
    article = bad = False
    for tag, sure, weak, wrapper in path:
        if wrapper:
            names.add("wrapped")
            sure, weak = tuple(h for h in sure if h == "content"), ()
        if not (wrapper and tag == "form"):
            names.add(f"in:{tag}")
            bad |= tag in _NEGATIVE_TAGS or (tag == "header" and not article)
        if article:
            names.add(f"article>{tag}")
        article |= tag in ("article", "main")
        bad |= any(h != "content" for h in sure)
        names.update(f"hint:{h}" for h in sure)
        names.update(f"weak:{h}" for h in weak)
        near = sure[-1] if sure else near
    if near:
        names.add(f"near:{near}")
    if path:
        names.add(f"own:{path[-1][0]}")
    names.add("negative" if bad else "clean")
    if all(t in ("html", "body", "p", "div") and not hs for t, hs, _, _ in path):
        names.add("bare")
    found = sorted(FEATURES[n] for n in names if n in FEATURES)
    if len(_PATHS) > 20_000:
        _PATHS.clear()
    _PATHS[path] = found
    return found


_STOPS = tuple(".!?…。！？\"”»")


def features(page: list[Block]) -> list[list[int]]:
    """Feature numbers of each block, in order."""
    rows = []
    f = FEATURES
    enough = WRAPPER * sum(len(b.text) for b in page)
    for k, b in enumerate(page):
        text = b.text
        n = text.count(" ") + 1
        share = b.linked / len(text)
        row = [
            *path_features(tuple([(x.tag, x.sure, x.weak, x.main and x.chars >= enough) for x in b.path])),
            f["words:0"] + (0 if n < 3 else 1 if n < 7 else 2 if n < 15 else 3 if n < 40 else 4 if n < 100 else 5),
            f["links:0"] + (0 if not b.linked else 1 if share < 0.3 else 2 if share < 0.8 else 3),
        ]
        if text.endswith(_STOPS):
            row.append(f["stop"])
        if "," in text:
            row.append(f["commas"])
        if "©" in text:
            row.append(f["mark:©"])
        if "|" in text or "»" in text or "·" in text:
            row.append(f["mark:bar"])
        if text[0].isupper():
            row.append(f["upper"])
        if not k:
            row.append(f["first"])
        if k == len(page) - 1:
            row.append(f["last"])
        rows.append(row)
    return rows
