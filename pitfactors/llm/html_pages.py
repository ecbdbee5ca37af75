"""Labelled pages for the extraction model.

Pages are drawn from a small grammar of layouts: the parts a page can have, the markup each
part comes in, and whether its blocks belong to the article.  The grammar states the labels,
so they are exact; the seed makes the set the same in every run.
"""

from __future__ import annotations

import random

Part = tuple[str, bool]  # markup of one leaf block with {} for its text, and whether it is article text

_SYLLABLES = "an be co da el fi ga ha in jo ka lu me no or pa qui ra so ti un ve wa xe yo za".split()


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))


def _sentence(r: random.Random, low: int = 4, high: int = 18) -> str:
    return _words(r, low, high).capitalize() + r.choice("...!?")


def _prose(r: random.Random) -> str:
    return " ".join(_sentence(r) for _ in range(r.choice((1, 1, 2, 3, 5, 8))))


def _wrap(r: random.Random, pairs: list[tuple[str, str]], inner: list) -> list:
    start, end = r.choice(pairs)
    return [start, *inner, end]


def _links(r: random.Random) -> list:
    item = r.choice(("<li><a href='/x'>{}</a></li>", "<p><a href='/x'>{}</a></p>", "<div><a href='#'>{}</a></div>"))
    return [(item.format(_words(r, 1, 3)), False) for _ in range(r.randint(2, 7))]


def _menu(r):
    return _wrap(r, [("<nav><ul>", "</ul></nav>"), ("<div class='menu'><ul>", "</ul></div>"), ("<div id='navbar'>", "</div>"), ("<ul class='breadcrumbs'>", "</ul>")], _links(r))


def _header(r):
    parts = [(f"<{r.choice(('h1', 'p', 'div'))} class='{r.choice(('logo', 'title', 'tagline'))}'>{_words(r, 1, 4)}</x>", False)]
    return _wrap(r, [("<header>", "</header>"), ("<div class='masthead'>", "</div>"), ("<div id='header'>", "</div>")], parts + (_menu(r) if r.random() < 0.4 else []))


def _advert(r):
    return _wrap(r, [("<div class='ad'>", "</div>"), ("<div class='advert banner'>", "</div>"), ("<aside class='sponsored'><p>", "</p></aside>"), ("<div id='promo'><p>", "</p></div>")], [(_sentence(r, 3, 14), False)])


def _sidebar(r):
    parts = [(f"<h3>{_words(r, 1, 3)}</h3>", False), *(_links(r) if r.random() < 0.7 else [(f"<p>{_prose(r)}</p>", False)])]
    return _wrap(r, [("<aside>", "</aside>"), ("<div class='sidebar'>", "</div>"), ("<div class='related widget'><ul>", "</ul></div>"), ("<section class='recommended'>", "</section>")], parts)


def _notice(r):
    return _wrap(r, [("<div class='cookie-consent'>", "</div>"), ("<div class='notice'><p>", "</p></div>"), ("<div role='alert' class='newsletter popup'><p>", "</p></div>"), ("<dialog><p>", "</p></dialog>")], [(_sentence(r, 5, 20), False)])


def _form(r):
    parts = [(f"<label>{_words(r, 1, 4)}</label><input type=text>", False), (f"<p>{_sentence(r)}</p>", False), (f"<button>{_words(r, 1, 2)}</button>", False)]
    return ["<form action='/s'>", *r.sample(parts, r.randint(1, 3)), "</form>"]


def _comments(r):
    inner = [(f"<h3>{_words(r, 1, 3)}</h3>", False)] if r.random() < 0.6 else []
    for _ in range(r.randint(1, 5)):
        inner += [*(["<div class='comment'>"]), (f"<p>{_prose(r)}</p>", False), "</div>"]
    return _wrap(r, [("<section class='comments'>", "</section>"), ("<div id='comments'>", "</div>"), ("<div class='discussion replies'>", "</div>"), ("<ol class='comment-list'>", "</ol>")], inner)


def _footer(r):
    parts = [(f"<p>© {_words(r, 1, 4)} · {_sentence(r)}</p>", False)] if r.random() < 0.7 else [(f"© {_words(r, 2, 9)}", False)]
    return _wrap(r, [("<footer>", "</footer>"), ("<div class='footer'>", "</div>"), ("<div id='colophon' class='legal'>", "</div>")], parts + (_links(r) if r.random() < 0.4 else []))


def _article(r):
    body: list = []
    if r.random() < 0.8:
        body.append((f"<h1>{_words(r, 2, 10)}</h1>", True))
    if r.random() < 0.2:
        body.append((f"<p class='byline'>{_words(r, 2, 5)}</p>", True))
    for _ in range(r.randint(1, 12)):
        kind = r.random()
        if kind < 0.7:
            body.append((r.choice(("<p>{}</p>", "<p><b>{}<br>", "<p>{}")).format(_prose(r)), True))
        elif kind < 0.8:
            body.append((f"<{(h := r.choice(('h2', 'h3')))}>{_words(r, 1, 7)}</{h}>", True))
        elif kind < 0.87:
            body += ["<ul>", *((f"<li>{_sentence(r)}</li>", True) for _ in range(r.randint(2, 4))), "</ul>"]
        elif kind < 0.91:
            body += ["<blockquote>", (f"<p>{_prose(r)}</p>", True), "</blockquote>"]
        elif kind < 0.94:
            body += ["<table><tr>", *((f"<td>{_words(r, 1, 4)}</td>", True) for _ in range(3)), "</tr></table>"]
        else:
            body += r.choice((_advert, _form, _sidebar, _notice))(r)
    if r.random() < 0.15:
        body += _comments(r)
    return _wrap(r, [("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div id='main' class='post entry'>", "</div>"), ("<div class='story-body'>", "</div>")], body)


def labelled_pages(count: int = 300, seed: int = 3) -> list[tuple[str, list[bool]]]:
    """(html, label of each leaf block in page order); True marks article text."""
    r = random.Random(seed)
    pages = []
    for _ in range(count):
        parts: list = []
        for make, chance in ((_notice, 0.3), (_header, 0.5), (_menu, 0.7), (_advert, 0.5), (_form, 0.2)):
            parts += make(r) if r.random() < chance else []
        parts += _article(r)
        for make, chance in ((_comments, 0.4), (_sidebar, 0.4), (_advert, 0.2), (_form, 0.2), (_footer, 0.85), (_notice, 0.1)):
            parts += make(r) if r.random() < chance else []
        html = "".join(p if isinstance(p, str) else p[0] for p in parts).replace("</x>", "</div>")
        pages.append((f"<html><head><title>{_words(r, 2, 5)}</title><style>p{{}}</style></head><body>{html}</body></html>", [p[1] for p in parts if not isinstance(p, str)]))
    return pages
