"""Operator 1, HTML extraction: a linear-chain conditional random field over a page's leaf blocks.

Each block is content or boilerplate. Features are its ancestors' tags and what their class, id and role hint at, its length,
links and punctuation. The field is trained here on pages labelled by hand and on pages that a seeded generator writes (articles
in many kinds of containers with telling, neutral and misleading names, amid menus, notices, adverts, comments and so on, each
block with its label), by gradient ascent on the log-likelihood with forward-backward, and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices
from foliospark.llm.html_blocks import FEATURES, blocks, features
from foliospark.llm.labelled_pages import labelled_pages

#: Generated pages, and how often each page labelled by hand counts.
TRAINING_PAGES, BY_HAND = 400, 12


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and the labels (1 content) of its leaf blocks."""
    syllables = ["ba", "ren", "the", "mi", "tor", "al", "es", "ion", "qu", "eau", "ver", "sch", "ung", "dos", "ca", "li", "en", "an"]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3))))

    def sentence(low=4, high=18):
        return " ".join(word() + rng.choice(("", "", "", ",")) for _ in range(rng.randint(low, high))).rstrip(",").capitalize() + rng.choice("...?!")

    barred = rng.random() < 0.1  # some texts are lists of words between bars

    def prose():
        found = " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, 9))))
        return found.replace(" ", " | ").rstrip(".") if barred and rng.random() < 0.7 else found

    def phrase(low=1, high=4):
        return " ".join(word() for _ in range(rng.randint(low, high)))

    misleading = ("review", "legal", "social", "more", "related", "share", "ad", "notice", "side", "popular", "header", "search", "form", "tags", "alert")
    out: list[str] = []
    labels: list[int] = []

    def put(markup, label=None):
        out.append(markup)
        if label is not None:
            labels.append(label)

    def attr(group):
        names = {
            "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo-box", "banner"],
            "nav": ["nav", "menu", "main-menu", "breadcrumbs", "navbar", "pagination"],
            "head": ["header", "site-header", "masthead", "top-bar"],
            "foot": ["footer", "site-footer", "colophon", "imprint"],
            "side": ["sidebar", "widget", "related", "right-rail", "recommended", "popular"],
            "notice": ["notice", "cookie-notice", "consent", "newsletter", "alert", "subscribe", "paywall"],
            "comment": ["comments", "comment-list", "respond", "reader-comments", "discussion", "replies"],
            "form": ["search-form", "login", "contact-form", "signup"],
            "content": ["content", "post", "entry-content", "article-body", "main", "story", "post-body"],
        }[group]
        name = rng.choice(names)
        return rng.choice((f' class="{name}"', f' id="{name}"', f" class='{name} {word()}'"))

    def odd():
        """A name that tells nothing, or seems to tell what it does not."""
        name = rng.choice(("page", "site", "wrapper", "top", "row", word(), f"{word()}-{rng.choice(misleading)}", f"{rng.choice(misleading)}-{word()}"))
        return rng.choice(("", f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"'))

    def links(n):
        for _ in range(n):
            put(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>', 0)

    def junk(kind):
        if kind == "nav":
            tag = rng.choice(("nav", "div", "ul", "nav"))
            put(f"<{tag}{attr('nav') if tag != 'nav' or rng.random() < 0.3 else ''}><ul>")
            links(rng.randint(2, 8))
            put(f"</ul></{tag}>")
        elif kind == "head":
            put(rng.choice(("<header>", f"<div{attr('head')}>")) if rng.random() < 0.9 else "<div role='banner'>")
            tag = rng.choice(("h1", "p", "div", "h2"))
            put(f"<{tag}>{phrase()}</{tag}>", 0)
            if rng.random() < 0.5:
                put(f"<p>{sentence()}</p>", 0)
            put("</header></div>" if out[-1].startswith("<header") else "</header>" if any("<header>" in x for x in out[-3:]) else "</div>")
        elif kind == "foot":
            tag = rng.choice(("footer", "footer", "div"))
            put(f"<{tag}{attr('foot') if tag == 'div' else ''}>")
            for _ in range(rng.randint(1, 3)):
                put(rng.choice((f"<p>&copy; {phrase()} {sentence()}</p>", f"<div>{phrase()} | {phrase()}</div>", f"<p>{sentence()}</p>")), 0)
            put(f"</{tag}>")
        elif kind in ("ad", "notice"):
            tag = rng.choice(("div", "div", "p", "section", "aside"))
            put(f"<{tag}{attr(kind)}>{prose() if rng.random() < 0.6 else sentence()}", 0)
            if tag != "p" and rng.random() < 0.3:
                put(f"<p>{sentence()}</p>", 0)
            put(f"</{tag}>")
        elif kind == "side":
            tag = rng.choice(("aside", "div"))
            put(f"<{tag}{attr('side') if tag == 'div' or rng.random() < 0.5 else ''}>")
            put(f"<h3>{phrase()}</h3>", 0)
            for _ in range(rng.randint(1, 4)):
                put(rng.choice((f"<p>{prose()}</p>", f"<p><a href='#'>{phrase(2, 7)}</a></p>")), 0)
            put(f"</{tag}>")
        elif kind == "comment":
            tag = rng.choice(("section", "div", "ol", "ul"))
            put(f"<{tag}{attr('comment')}>")
            if rng.random() < 0.6:
                put(f"<h3>{phrase()}</h3>", 0)
            for _ in range(rng.randint(1, 5)):
                inner = rng.choice(("p", "li", "div", "p"))
                put(f"<{inner}>{prose()}</{inner}>", 0)
            put(f"</{tag}>")
        elif kind == "form":
            put(rng.choice(("<form>", f"<form{attr('form')}>")))
            for _ in range(rng.randint(1, 3)):
                put(rng.choice((f"<label>{phrase()}</label>", f"<p>{sentence()}</p>", f"<button>{phrase()}</button>", f"<div>{sentence()}</div>")), 0)
            put("</form>")

    put(f"<!DOCTYPE html><html><head><title>{phrase()}</title><style>p{{margin:0}}</style></head><body>")
    for kind in ("notice", "head", "nav", "nav", "ad", "side"):
        if rng.random() < 0.4:
            junk(kind)
    kind = rng.choice(("article", "article", "article", "main", "div", "section", "mixed", "plain"))
    begin, end = {
        "article": (f"<article{odd()}>", "</article>"), "main": (f"<main{odd()}>", "</main>"), "div": (f"<div{attr('content')}>", "</div>"), "section": (f"<section{attr('content')}>", "</section>"),
        "mixed": (f"<main{odd()}><article{odd()}>", "</article></main>"), "plain": (f"<div{odd()}>", "</div>"),
    }[kind]
    if rng.random() < 0.4:
        begin, end = f"<div{odd()}>{begin}", f"{end}</div>"
    if rng.random() < 0.3:
        begin, end = f"{begin}<div{odd()}>", f"</div>{end}"
    put(begin)
    if rng.random() < 0.7:
        title = f"<h1>{rng.choice((phrase(2, 8), sentence()))}</h1>"
        put(f"<header>{title}</header>" if "article" in kind and rng.random() < 0.3 else title, 1)
    for _ in range(rng.randint(1, 12)):
        style = rng.random()
        if style < 0.04:
            tag = rng.choice(("section", "div"))
            put(f"<{tag}{odd()}>")
            for _ in range(rng.randint(1, 3)):
                put(f"<p>{prose()}</p>", 1)
            put(f"</{tag}>")
        elif style < 0.62:
            linked = rng.random()
            inner = f"<a href='/{word()}'>{prose()}</a>" if linked < 0.04 else f"{prose()} <a href='/{word()}'>{phrase()}</a> {prose()}" if linked < 0.2 else prose()
            put(f"<p>{inner}</p>", 1)
        elif style < 0.72:
            put(f"<p><b>{prose()}<br>", 1)
        elif style < 0.78:
            put(f"<h2>{phrase(1, 6)}</h2>", 1)
        elif style < 0.82:
            put(f"<blockquote>{prose()}</blockquote>", 1)
        elif style < 0.87:
            put("<ul>")
            for _ in range(rng.randint(2, 4)):
                put(f"<li>{rng.choice((phrase(2, 6), sentence()))}</li>", 1)
            put("</ul>")
        elif style < 0.9:
            put(f"<p>{word().capitalize()}.</p>", 1)
        elif style < 0.93:
            put(f"<pre>{phrase(3, 9)}</pre>", 1)
        else:
            junk(rng.choice(("ad", "ad", "side", "notice", "form", "nav", "comment")))
    if kind in ("article", "mixed", "main") and rng.random() < 0.15:
        junk(rng.choice(("comment", "foot", "nav")))
    put(end)
    for kind in ("comment", "side", "form", "ad", "nav", "notice", "foot"):
        if rng.random() < 0.4:
            junk(kind)
    if rng.random() < 0.9:
        put("</body></html>")
    return "".join(out), labels


class Field:
    """Weights: features x 2 labels, 2 x 2 transitions, 2 starts."""

    def __init__(self):
        self.state, self.step, self.start = np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not rows:
            return []
        flat = np.concatenate(rows)
        emit = np.add.reduceat(self.state[flat], np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]), axis=0).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.start[0] + emit[0][0], self.start[1] + emit[0][1]
        back = []
        for e0, e1 in emit[1:]:
            from0, from1 = a + s00 < b + s10, a + s01 < b + s11
            back.append((from0, from1))
            a, b = max(a + s00, b + s10) + e0, max(a + s01, b + s11) + e1
        label = int(b > a)
        out = [label]
        for pointers in reversed(back):
            label = int(pointers[label])
            out.append(label)
        return out[::-1]


@functools.cache
def trained(pages: int = TRAINING_PAGES, rounds: int = 80, seed: int = 1) -> Field:
    """The field after `rounds` of Adam on the mean log-likelihood of so many labelled pages, less a small square penalty."""
    rng = random.Random(seed)
    made = [labelled_page(rng) for _ in range(pages)] + labelled_pages() * BY_HAND
    cut = [(features(blocks(page)), labels) for page, labels in made]
    cut = [(x, y) for x, y in cut if x and len(x) == len(y)]
    n, most = len(cut), max(len(y) for _, y in cut)
    x = np.zeros((n, most, len(FEATURES)))
    y, mask = np.zeros((n, most), int), np.zeros((n, most))
    for i, (rows, labels) in enumerate(cut):
        for t, row in enumerate(rows):
            x[i, t, row] = 1
        y[i, : len(labels)] = labels
        mask[i, : len(labels)] = 1
    flat = x.reshape(-1, len(FEATURES))
    gold = np.eye(2)[y] * mask[:, :, None]
    pair_mask = mask[:, 1:]
    gold_step = np.einsum("nta,ntb->ab", gold[:, :-1] * pair_mask[:, :, None], gold[:, 1:])
    field = Field()
    w = [field.state, field.step, field.start]
    m1, m2 = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    lse = lambda v, axis: np.logaddexp(v.take(0, axis), v.take(1, axis))
    for r in range(1, rounds + 1):
        emit = (flat @ w[0]).reshape(n, most, 2)
        fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = emit[:, 0] + w[2]
        for t in range(1, most):
            new = lse(fwd[:, t - 1, :, None] + w[1], 1) + emit[:, t]
            fwd[:, t] = np.where(mask[:, t, None] > 0, new, fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            new = lse(w[1] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
        total = lse(fwd[:, -1], 1)
        marginal = np.exp(fwd + bwd - total[:, None, None]) * mask[:, :, None]
        pairs = np.exp(fwd[:, :-1, :, None] + w[1] + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pair_mask[:, :, None, None]
        grads = [flat.T @ (gold - marginal).reshape(-1, 2), gold_step - pairs.sum(axis=(0, 1)), (gold - marginal)[:, 0].sum(axis=0)]
        for k, g in enumerate(grads):
            g = g / n - 1e-3 * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            w[k] += 0.15 * (m1[k] / (1 - 0.9**r)) / (np.sqrt(m2[k] / (1 - 0.99**r)) + 1e-8)
    return field


def main_text(page: str | None, field: Field) -> str:
    """The content blocks' texts, one a line; empty for null and where no block is content."""
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, field.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of pages: the id, the columns in keep, text and n_chars (its code points).

    Null html gives empty text; whole pages are read, however long; repeated rows stay repeated; an empty table gives no rows;
    columns not named are not read, so names cannot clash. The field is trained on the driver and broadcast (a few kB).
    """
    field = pages.sparkSession.sparkContext.broadcast(trained())
    base = pages.select(pages[html_col].cast("string").alias("__html"), pages[id_col], *[pages[c] for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:])
    names = [*base.columns[1:], "text"]

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(h, field.value) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=names)

    return base.mapInArrow(run, f"{fields}, text string").withColumn("n_chars", F.length("text").cast("long"))
