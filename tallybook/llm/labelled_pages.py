"""Labelled web pages that the content model is trained on, laid out by rule from the templates below.

An element's ``y`` attribute says whether the text in it (but in elements with an own ``y``) is main
text, 1, or not, 0. The words are invented; only layout, names of classes and lengths carry meaning.
"""

from __future__ import annotations

import random

PAGES = 400

_SYLLABLES = "ba co di fe gu lo ma ne pi ro su ta ve zi or an el ist une ter".split()

_MENUS = ["<nav y=0>{links}</nav>", '<ul class="menu" y=0>{links}</ul>', '<div class="navbar" y=0><ul>{links}</ul></div>', '<div id="navigation" y=0>{links}</div>', '<div role="navigation" y=0>{links}</div>', '<div class="breadcrumb" y=0>{links}</div>', '<div class="topmenu nav-links" y=0>{links}</div>']
_HEADERS = ["<header y=0><div>{short}</div></header>", '<div class="header" y=0><h2>{short}</h2><p>{medium}</p></div>', '<div id="masthead" y=0>{short}</div>', '<div role="banner" y=0><p>{medium}</p></div>', '<header class="site-header" y=0><h1>{short}</h1>{menu}</header>', '<header y=0><h1>{short}</h1><p>{long}</p></header>', '<header y=0><h1>{short}</h1><p>{medium}</p></header>']
_FOOTERS = ["<footer y=0>&copy; {medium}</footer>", '<div class="footer" y=0><p>{medium}</p><ul>{links}</ul></div>', '<div id="site-footer" y=0><p>{long}</p></div>', '<div role="contentinfo" y=0>{medium}</div>', '<div class="copyright" y=0>{medium}</div>', "<footer y=0><p>{long}</p><p>{medium}</p></footer>"]
_SIDES = ["<aside y=0><h3>{short}</h3><p>{long}</p></aside>", '<div class="sidebar" y=0><h3>{short}</h3><ul>{links}</ul><p>{medium}</p></div>', '<div class="widget" y=0><p>{long}</p></div>', '<div class="related-posts" y=0><h3>{short}</h3><ul>{links}</ul></div>', '<div id="right-rail" class="side" y=0><p>{medium}</p></div>', '<section class="related" y=0><h2>{short}</h2><p>{medium}</p></section>', '<div role="complementary" y=0><p>{long}</p></div>']
_ADS = ['<div class="ad" y=0>{medium}</div>', '<div class="advert" y=0><p>{long}</p></div>', '<div class="ads banner" y=0><a href="/x">{medium}</a></div>', '<div id="sponsored" y=0><p>{medium}</p></div>', '<section class="promo" y=0><h4>{short}</h4><p>{medium}</p></section>', '<div class="advertisement" y=0>{long}</div>', '<p class="ad-text" y=0>{medium}</p>', '<ins class="adsbygoogle" y=0>{medium}</ins>']
_NOTICES = ['<div class="cookie-notice" y=0><p>{long}</p><button>{short}</button></div>', '<div id="consent" y=0>{medium}</div>', '<div class="notice" y=0><p>{medium}</p></div>', '<div class="popup modal" y=0><p>{long}</p></div>', '<div role="alert" y=0>{medium}</div>', '<div class="gdpr-banner" y=0><p>{long}</p></div>', '<div class="alert" y=0><p>{medium}</p></div>', "<dialog y=0><p>{medium}</p></dialog>"]
_FORMS = ["<form y=0><label>{short}</label><input><p>{medium}</p></form>", '<div class="newsletter" y=0><p>{medium}</p><form><button>{short}</button></form></div>', '<div class="subscribe" y=0><h3>{short}</h3><p>{long}</p></div>', '<form class="search" y=0>{short}</form>', '<div class="login" y=0><p>{medium}</p></div>']
_COMMENTS = ['<section id="comments" y=0><h3>{short}</h3><div class="comment"><p>{long}</p></div><div class="comment"><p>{medium}</p><p>{long}</p></div></section>', '<div class="comments" y=0><p>{long}</p><p>{long}</p></div>', '<ol class="comment-list" y=0><li><p>{long}</p></li><li>{medium}</li></ol>', '<div class="user-reply" y=0><p>{long}</p></div>', '<div id="disqus_thread" y=0><p>{medium}</p></div>', '<div class="responses" y=0><article class="comment"><p>{long}</p></article></div>', '<div class="reader-comments" y=0><blockquote>{long}</blockquote><p>{medium}</p></div>', '<div class="reader-comments" y=0>{many}</div>', '<section class="comments" y=0>{many}</section>']
_SHARES = ['<div class="share" y=0><a href="/s">{short}</a></div>', '<ul class="social" y=0>{links}</ul>', '<div class="pagination" y=0>{links}</div>', '<div class="tags" y=0>{links}</div>', '<div class="author-bio" y=0><p>{medium}</p></div>']
_BODIES = ["<article y=1>{main}</article>", "<article y=1>{main}</article>", "<article y=1>{main}</article>", "<main y=1>{main}</main>", "<main y=1><article>{main}</article></main>", '<div id="content" y=1>{main}</div>', '<div class="post-body" y=1>{main}</div>', '<div class="entry-content" y=1>{main}</div>', '<section class="story" y=1>{main}</section>', "<div y=1>{main}</div>", "<div><div y=1>{main}</div></div>", "<table><tr><td y=1>{main}</td></tr></table>", '<div role="main" y=1>{main}</div>', '<div class="article-text" y=1><section>{main}</section></div>', '<article class="post" y=1><header>{head}</header>{rest}</article>']
_PARTS = ["<p>{long}</p>", "<p>{long}</p>", "<p>{medium}</p>", "<p>{short}</p>", "<h2>{short}</h2><p>{long}</p>", "<ul><li>{medium}</li><li>{short}</li></ul>", "<ol><li>{long}</li><li>{medium}</li></ol>", "<blockquote><p>{long}</p></blockquote>", "<blockquote>{medium}</blockquote>", "<pre>{medium}</pre>", "<p>{long} <a href='/x'>{short}</a> {medium}</p>", "<h3>{short}</h3>", "<div>{long}</div>", "<figure><figcaption>{medium}</figcaption></figure>", "<table><tr><td>{short}</td><td>{medium}</td></tr></table>", "<section><h2>{short}</h2><p>{long}</p></section>", "<dl><dt>{short}</dt><dd>{medium}</dd></dl>", "<p><a href='/y'>{short}</a></p>"]


def labelled_pages(n: int = PAGES, seed: int = 3) -> list[str]:
    """``n`` pages, the same for the same seed."""
    draw = random.Random(seed)

    def words(low: int, high: int) -> str:
        said = ["".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4))) for _ in range(draw.randint(low, high))]
        return " ".join(said).capitalize()

    def dot(chance: float) -> str:
        return draw.choice(".!?") if draw.random() < chance else ""

    def fill(template: str) -> str:
        while "{" in template:
            for name, text in (("short", lambda: words(1, 5) + dot(0.3)), ("medium", lambda: words(5, 18) + dot(0.7)), ("long", lambda: words(15, 70) + dot(0.8)), ("links", links), ("many", many), ("menu", lambda: draw.choice(_MENUS))):
                template = template.replace("{" + name + "}", text(), 1)
        return template

    def links() -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(draw.randint(2, 8)))

    def many() -> str:
        return draw.choice(["<p>{long}</p>", "<p>{medium}</p>", "<p>{long}</p><p>{short}</p>"]) * draw.randint(3, 12)

    def some(kinds: list[str], chance: float) -> str:
        return fill(draw.choice(kinds)) if draw.random() < chance else ""

    pages = []
    for _ in range(n):
        head = f"<h1>{words(1, 12)}{dot(0.4)}</h1>"
        brief = draw.random() < 0.2
        parts = [fill("<p>{short}</p>" if brief else draw.choice(_PARTS)) for _ in range(1 if brief else draw.randint(1, 12))]
        for kinds in (_ADS, _SHARES, _NOTICES, _SIDES, _FORMS):
            if draw.random() < 0.2:
                parts.insert(draw.randint(0, len(parts)), fill(draw.choice(kinds)))
        if draw.random() < 0.15:
            parts.append(fill(draw.choice(_COMMENTS)))
        rest = "".join(parts)
        body = draw.choice(_BODIES).replace("{main}", head + rest).replace("{head}", head).replace("{rest}", rest)
        before = [some(_HEADERS, 0.6), some(_MENUS, 0.8), some(_ADS, 0.4), some(_NOTICES, 0.3), some(_FORMS, 0.2)]
        after = [some(_SIDES, 0.5), some(_COMMENTS, 0.5), some(_ADS, 0.3), some(_SHARES, 0.3), some(_FORMS, 0.3), some(_NOTICES, 0.2)]
        draw.shuffle(after)
        frame = '<div id="page" class="wrapper container">{}</div>' if draw.random() < 0.3 else "{}"
        inner = "".join(before) + body + "".join(after)
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body y=0>{frame.format(inner)}{some(_FOOTERS, 0.9)}</body></html>")
    return pages
