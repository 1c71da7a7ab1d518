"""Pages of fourteen layouts without ``article`` or ``main``, with their main text.

Tags, class names and remarks are written by hand, apart from those that the
extractor makes its training pages of.
"""

from __future__ import annotations

import random
from collections import Counter
from html import escape

MENU = ["Start", "News", "Sport", "Opinion", "Jobs", "Contact us", "Help", "Archive", "Sign up"]
REMARKS = ["I do not agree with this at all, but thank you for the link.", "First!", "We had the same trouble last year. It was the cable, as it always is.", "Could you say where the numbers are from?"]
NOTICE = ["This site stores cookies on your device. By going on you agree to our terms.", "Allow all", "Only what is needed"]
ADVERT = ["Save 40 % on all boots until Sunday. Free delivery!", "Sponsored"]
LEGAL = ["© 2020 The Site", "Imprint", "Privacy", "All rights reserved."]
RELATED = ["Ten bridges you must see", "What the minister did not say", "A short history of salt"]


def listed(items, tag="li"):
    return "".join(f"<{tag}><a href='/x'>{escape(t)}</a></{tag}>" for t in items)


def paragraphs(items, tag="p"):
    return "".join(f"<{tag}>{escape(t)}</{tag}>" for t in items)


def layouts(title, texts, rng):
    """Each layout's html around a title and paragraphs."""
    menu, remarks, related = rng.sample(MENU, 5), rng.sample(REMARKS, 2), rng.sample(RELATED, 2)
    body = f"<h1>{escape(title)}</h1>{paragraphs(texts)}"
    half = len(texts) // 2
    yield f'<table><tr><td colspan=2 id="header">{listed(menu, "span")}</td></tr><tr><td class="navcolumn">{listed(related, "p")}</td><td class="bodytext">{body}</td></tr><tr><td id="footer">{paragraphs(LEGAL, "div")}</td></tr></table>'
    yield f'<div id="page"><header id="masthead"><p class="site-title">The Site</p><nav id="site-navigation">{listed(menu)}</nav></header><div id="primary"><div class="hentry"><h1 class="entry-title">{escape(title)}</h1><div class="entry-content">{paragraphs(texts)}</div></div><div id="comments" class="comments-area"><ol>{paragraphs(remarks, "li")}</ol></div></div><aside id="secondary" class="widget-area">{listed(related)}</aside><footer>{paragraphs(LEGAL)}</footer></div>'
    yield f'<div class="navbar">{listed(menu)}</div><div class="blog-posts"><div class="post-body">{body}</div><div class="post-footer">{paragraphs(["Posted by the editor", "5 comments"], "span")}</div></div><div class="sidebar-container">{listed(related)}</div>'
    yield f'<div class="cookie-banner">{paragraphs(NOTICE, "div")}</div><ul class="topnav">{listed(menu)}</ul><section class="story-body">{body}</section><section class="related-stories"><h3>More</h3>{listed(related)}</section><footer>{paragraphs(LEGAL)}</footer>'
    yield f'<div class="page"><div class="article__body"><h1>{escape(title)}</h1>{paragraphs(texts[:half])}<div class="ad-container">{paragraphs(ADVERT)}</div>{paragraphs(texts[half:])}</div><div class="article__related">{listed(related)}</div></div><div class="site-footer">{paragraphs(LEGAL)}</div>'
    yield f'<div class="related" role="navigation"><ul>{listed(menu)}</ul></div><div class="document"><div class="documentwrapper"><div class="body">{body}</div></div></div><div class="sphinxsidebar" role="navigation"><h3>Contents</h3><ul>{listed(related)}</ul></div><div class="footer">{paragraphs(LEGAL, "span")}</div>'
    yield f'<div id="nav">{listed(menu)}</div><div class="post"><h2>{escape(title)}</h2>{paragraphs(texts)}</div><ol class="commentlist">' + "".join(f'<li class="comment"><p>{escape(t)}</p></li>' for t in remarks) + f'</ol><form id="searchform"><label>Search this site</label></form><div class="copyright">{paragraphs(LEGAL)}</div>'
    yield f'<ul class="nav">{listed(menu)}</ul>{body}<hr><div class="footer">{paragraphs(LEGAL)}</div>'
    yield f'<div class="wrap"><div class="left-rail">{listed(menu)}</div><div id="content"><div class="text">{body}</div></div><div class="right-rail"><div class="promo">{paragraphs(ADVERT)}</div>{listed(related)}</div></div>'
    yield f'<header>{listed(menu)}</header><div itemprop="articleBody">{body}<div class="social-share">{listed(["Send by mail", "Tell a friend"], "span")}</div></div><div class="newsletter-signup">{paragraphs(["Get our best stories every Friday.", "Your address"])}</div><footer>{paragraphs(LEGAL)}</footer>'
    yield f'<div class="content-wrapper two-column"><div class="main-column right"><h1>{escape(title)}</h1>' + "".join(f'<div class="paragraph">{escape(t)}</div>' for t in texts) + f'</div><div class="side-column left">{listed(menu)}{listed(related)}</div></div><div id="cookie-consent">{paragraphs(NOTICE)}</div>'
    yield f'<nav class="menu-haut">{listed(menu)}</nav><div class="contenu">{body}<ul>{paragraphs([t for t in texts[:2]], "li")}</ul></div><footer class="pied">{paragraphs(LEGAL)}</footer>'
    yield f'<div class="modal subscribe-overlay">{paragraphs(["Subscribe now and read on.", "No, thanks"])}</div><div class="breadcrumb">{listed(menu[:2], "span")}</div><div class="entry"><div class="inner"><h1>{escape(title)}</h1><blockquote>{escape(texts[0])}</blockquote>{paragraphs(texts[1:])}</div></div><div class="pagination">{listed(["1", "2", "Next"], "span")}</div>'
    yield f'<div role="banner">{listed(menu, "span")}</div><div role="article"><h1>{escape(title)}</h1>{paragraphs(texts[:half])}<figure><img src="x"></figure><h2>{escape(title.split()[0])}</h2>{paragraphs(texts[half:])}</div><div class="discussion">{paragraphs(remarks)}</div><div role="contentinfo">{paragraphs(LEGAL)}</div>'


def expected(nth, title, texts):
    """The main text of the layout of that number."""
    blocks = [title, *texts]
    if nth == 11:
        blocks += texts[:2]
    if nth == 13:
        blocks.insert(1 + len(texts) // 2, title.split()[0])
    return "\n\n".join(" ".join(b.split()) for b in blocks)


def token_f1(got, want):
    """Harmonic mean of precision and recall of words."""
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


def made(articles, seed=0):
    """(layout, html, main text) for each (title, texts) and layout."""
    rng = random.Random(seed)
    for title, texts in articles:
        for nth, page in enumerate(layouts(title, texts, rng)):
            yield nth, f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body>{page}</body></html>", expected(nth, title, texts)
