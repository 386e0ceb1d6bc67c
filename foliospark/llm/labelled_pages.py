"""Pages labelled by hand for operator 1: layouts of common publishing systems. A block's text begins with + (content) or - (not)."""

from __future__ import annotations

import re

_WORDS = "the committee had not expected so many visitors when it opened the old harbour hall last spring and nobody knew how long it would stay open or who would pay for repairs to its roof".split()


def _prose(k: int, n: int) -> str:
    words = [_WORDS[(k * 7 + j * (k % 5 + 1)) % len(_WORDS)] for j in range(n)]
    return " ".join(words).capitalize() + "."


#: {n} stands for prose of n words.
SOURCES = (
    # a weblog with a page wrapper
    """<body class="home blog"><div id="page" class="site"><a class="skip-link" href="#c">-Skip to content</a><header id="masthead" class="site-header"><p class="site-title"><a href="/">-Harbour notes</a></p>
    <p class="site-description">-Small things seen from the quay</p><nav id="site-navigation" class="main-navigation"><ul><li><a href="/">-Home</a></li><li><a href="/about">-About</a></li></ul></nav></header>
    <div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-12" class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">+The hall by the water</h1>
    <div class="entry-meta">-Posted on 3 May by admin</div></header><div class="entry-content"><p>+{40}</p><p>+{25} <a href="/x">{4}</a> {12}</p><h2>+A second floor</h2><p>+{60}</p><ul><li>+{5}</li><li>+{6}</li></ul><p>+{30}</p></div>
    <footer class="entry-footer">-Filed under <a href="/c">news</a> <a href="/t">harbour</a></footer></article><nav class="post-navigation"><a href="/p">-Previous: Rain</a></nav>
    <div id="comments" class="comments-area"><h2 class="comments-title">-2 thoughts on this</h2><ol class="comment-list"><li><article class="comment-body"><p>-{20}</p></article></li><li><article class="comment-body"><p>-{35}</p></article></li></ol>
    <div id="respond" class="comment-respond"><h3>-Leave a reply</h3><form id="commentform"><p>-Your address will not be published.</p><label>-Comment</label></form></div></div></main></div>
    <aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2>-Recent posts</h2><ul><li><a href="/1">-Rain at last</a></li><li><a href="/2">-The new crane</a></li></ul></section></aside></div>
    <footer id="colophon" class="site-footer"><div class="site-info">-Proudly powered by a press</div></footer></div></body>""",
    # a newspaper
    """<body><div class="cookie-banner"><p>-We use cookies. {15}</p><button>-Accept</button></div><header class="top"><div class="logo"><a href="/">-The Quay Times</a></div><nav><ul><li><a href="/w">-World</a></li><li><a href="/b">-Business</a></li><li><a href="/s">-Sport</a></li></ul></nav></header>
    <div class="wrapper site-main"><div class="breadcrumb"><a href="/">-Home</a> <a href="/w">World</a></div><article class="film-review"><h1>+A harbour hall reopens</h1><p class="standfirst">+{18}</p><div class="byline">-By Jo Reporter</div><div class="share-buttons"><a href="#">-Share</a> <a href="#">Tweet</a></div>
    <figure><img src=a><figcaption>+{9}</figcaption></figure><p>+{50}</p><div class="ad-slot">-Advertisement</div><p>+{45}</p><blockquote><p>+{22}</p></blockquote><p>+{35}</p><aside class="related"><h3>-Read more</h3><ul><li><a href="/r">-{7}</a></li><li><a href="/q">-{6}</a></li></ul></aside><p>+{41}</p><p>+{8}</p>
    <div class="newsletter-signup"><h4>-Get our newsletter</h4><p>-{14}</p></div></article><section class="most-popular"><h2>-Most read</h2><ol><li><a href="/1">-{8}</a></li><li><a href="/2">-{9}</a></li></ol></section></div>
    <footer><ul><li><a href="/t">-Terms</a></li><li><a href="/p">-Privacy</a></li></ul><p>-&copy; The Quay Times. All rights reserved.</p></footer></body>""",
    # an encyclopedia
    """<body><div id="mw-page-base"></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading">+Harbour hall</h1><div id="bodyContent"><div id="siteSub">+From the free handbook</div><div id="mw-content-text"><p>+{55}</p><div id="toc" class="toc"><h2>-Contents</h2><ul><li><a href="#1">-1 History</a></li><li><a href="#2">-2 Use</a></li></ul></div>
    <h2>+History</h2><section class="social-history"><p>+{70}</p><p>+{33}</p></section><h2>+Use</h2><table><tr><th>+Year</th><td>+1921</td></tr><tr><th>+Visitors</th><td>+12,400</td></tr></table><p>+{28}</p><h2>+See also</h2><div id="further-reading-more"><ul><li>+<a href="/a">Harbour</a></li><li>+<a href="/b">Hall</a></li></ul></div></div></div></div>
    <div id="mw-navigation"><h2>-Navigation menu</h2><ul><li><a href="/">-Main page</a></li><li><a href="/r">-Random page</a></li></ul><form id="searchform"><label>-Search</label></form></div><div id="footer"><ul><li>-This page was last edited in May.</li></ul></div></body>""",
    # a forum-like question
    """<body><div class="topbar"><ul><li><a href="/">-Questions</a></li><li><a href="/t">-Tags</a></li></ul></div><div class="container"><div class="content-wrapper"><h1>+How do I mend a slate roof?</h1><div class="post-body"><p>+{44}</p><pre><code>+sudo ladder --up</code></pre><p>+{19}</p></div>
    <div class="sidebar-right"><div class="widget"><h4>-Linked</h4><a href="/1">-{8}</a></div></div></div></div><footer class="site-footer"><p>-{12}</p></footer></body>""",
    # a site of one form around everything, with tables for layout
    """<body><form method="post" id="aspnetForm"><table><tr><td><a href="/">-Home</a></td><td><a href="/n">-News</a></td></tr></table><div class="legal-news"><h1>+Council and court</h1><div><p>+{60}</p><p>+{48}</p></div><div>+{30}</div></div><div class="footer">-Contact the webmaster | Imprint</div></form></body>""",
    # plain markup of the old kind
    """<body><center><a href="/">-Home</a> | <a href="/g">Guestbook</a></center><hr><h2>+Notes from the quay</h2><p>+{50}<p>+{24}<p>+{66}<hr><address>-Mail the author</address><p>-Last changed 1999</p></body>""",
    # documentation
    """<body><nav class="navbar"><a href="/">-Docs</a></nav><div class="row"><div class="docs-sidebar"><ul class="menu"><li><a href="/i">-Install</a></li><li><a href="/u">-Use</a></li></ul></div><main class="docs-main"><nav class="breadcrumbs"><a href="/">-Docs</a></nav><h1>+Install the pump</h1><p>+{30}</p><div class="alert alert-info">+{12}</div>
    <h2>+Before you begin</h2><ol><li>+{8}</li><li>+{11}</li></ol><pre>+pump --start</pre><p>+{21}</p><div class="pagination"><a href="/n">-Next</a></div></main></div><footer><p>-Built with a generator</p></footer></body>""",
    # sections without an article element, and a page of comments longer than the text
    """<body><div id="top"><div id="branding">-Quay club</div><ul id="menu"><li><a href="/">-Club</a></li><li><a href="/j">-Join</a></li></ul></div><div id="main-content"><section class="story"><h1>+Regatta results</h1><p>+{26}</p><p>+{17}</p></section><section id="comments"><h2>-Comments</h2><p>-{60}</p><p>-{50}</p><p>-{70}</p></section></div>
    <div id="bottom" class="footer-links"><a href="/c">-Contact</a> <a href="/l">Legal</a></div></body>""",
    # a shop's notice page with modals
    """<body><div class="modal newsletter-popup"><h3>-Ten percent off</h3><p>-{16}</p></div><div class="page-wrapper"><div class="promo-banner">-Free delivery this week</div><div class="article-body"><h1>+How we dry our tea</h1><p>+{37}</p><p>+{52}</p><div class="social-share"><a href="#">-Share</a></div><h3>+The second drying</h3><p>+{44}</p></div>
    <div class="related-posts"><h3>-You may also like</h3><p><a href="/1">-{5}</a></p><p>-{14}</p></div></div><div class="footer-menu"><a href="/r">-Returns</a></div></body>""",
)


def labelled_pages() -> list[tuple[str, list[int]]]:
    """The pages and the labels of their leaf blocks."""
    out = []
    for k, source in enumerate(SOURCES):
        count = iter(range(1000))
        page = re.sub(r"\{(\d+)\}", lambda m: _prose(k + 3 * next(count), int(m[1])), re.sub(r">\s+<", "><", source))  # noqa: B023
        labels = [int(m[1] == "+") for m in re.finditer(r">([+-])", page)]
        out.append((re.sub(r">[+-]", ">", page), labels))
    return out
