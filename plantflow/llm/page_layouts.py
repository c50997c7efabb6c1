"""Labelled pages for fitting the extractor: layouts of common kinds of sites, filled with words of a seeded generator.

A layout is a list of (html with {} for text, what stands there): T and P are a title and a paragraph of the article,
other letters are other parts. Which block holds what is known by construction, so labels are exact.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Ways to wrap the article, from pages with landmarks to plain divisions.
ARTICLE = [
    ("<article>", "</article>"),
    ("<main><article>", "</article></main>"),
    ("<main>", "</main>"),
    ('<div id="content">', "</div>"),
    ('<div class="post"><div class="entry-content">', "</div></div>"),
    ('<section class="article-body">', "</section>"),
    ('<div class="story text">', "</div>"),
    ('<td class="main">', "</td>"),
    ('<div role="main">', "</div>"),
    ("<div>", "</div>"),
]
#: Parts that are not the article: name, html around them, html of an item, items at least and at most, words of an item.
OTHERS = {
    "menu": [("<nav><ul>", "</ul></nav>", '<li><a href="/x">{}</a></li>', 3, 8, (1, 3)), ('<div class="menu nav"><ul>', "</ul></div>", '<li><a href="/x">{}</a>', 3, 8, (1, 2)), ('<div class="breadcrumb">', "</div>", '<span><a href="/x">{}</a> &gt; </span>', 2, 4, (1, 2))],
    "header": [("<header>", "</header>", "<div>{}</div>", 1, 3, (1, 5)), ('<div id="header" class="banner">', "</div>", "<p>{}</p>", 1, 2, (1, 6))],
    "advert": [('<div class="ad">', "</div>", "{}", 1, 1, (3, 12)), ('<div class="ads sponsored">', "</div>", "<p>{}</p>", 1, 2, (4, 20)), ('<aside class="promo">', "</aside>", '<a href="/x">{}</a>', 1, 2, (3, 9)), ('<div id="advert" class="advertisement">', "</div>", "<p>{}</p>", 1, 2, (4, 30))],
    "sidebar": [("<aside>", "</aside>", '<p>{}</p>', 1, 4, (3, 30)), ('<div class="sidebar widget"><h3>{}</h3><ul>', "</ul></div>", '<li><a href="/x">{}</a></li>', 2, 6, (2, 8)), ('<div class="related"><h2>{}</h2>', "</div>", '<div><a href="/x">{}</a></div>', 2, 5, (3, 9))],
    "notice": [('<div class="cookie notice">', "</div>", "<p>{}</p>", 1, 2, (6, 30)), ('<div class="banner consent" role="dialog">', "</div>", "{}", 1, 1, (6, 25)), ("<noscript>", "</noscript>", "<p>{}</p>", 1, 1, (4, 12)), ('<div class="disclaimer alert" role="alert">', "</div>", "<p>{}</p>", 1, 1, (5, 40))],
    "form": [("<form>", "</form>", "<label>{}</label>", 1, 3, (1, 4)), ('<form class="newsletter subscribe"><p>{}</p>', "<button>{}</button></form>", "<label>{}</label>", 0, 1, (2, 12)), ('<div class="search"><form>', "</form></div>", "<button>{}</button>", 1, 1, (1, 2)), ("<form><select>", "</select></form>", "<option>{}", 2, 5, (1, 2))],
    "comments": [('<section class="comments"><h2>{}</h2>', "</section>", '<div class="comment"><p>{}</p></div>', 1, 5, (4, 60)), ('<div id="comments"><ol class="comment-list">', "</ol></div>", '<li class="comment"><article><footer>{}</footer><p>{}</p></article></li>', 1, 4, (4, 50)), ('<div class="replies responses discussion">', "</div>", "<p>{}</p>", 1, 4, (4, 60)), ('<ul class="user-comments">', "</ul>", "<li><p>{}</p></li>", 1, 4, (5, 60))],
    "footer": [("<footer>", "</footer>", "<p>&copy; {}</p>", 1, 3, (2, 14)), ("<footer>", "</footer>", "{} &middot; {}", 1, 1, (1, 8)), ('<div id="footer" class="copyright">', "</div>", "<div>&copy; {}</div>", 1, 3, (2, 14)), ('<div class="share social">', "</div>", '<a href="/x">{}</a> ', 2, 5, (1, 1))],
}
INSIDE = ("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li><li>{}</li></ul>", "<ol><li>{}<li>{}</ol>", "<figure><figcaption>{}</figcaption></figure>", "<div>{}</div>", "<pre>{}</pre>", "<table><tr><td>{}</td><td>{}</td></tr></table>", '<p>{} <a href="/x">{}</a></p>', "<dl><dt>{}<dd>{}</dl>")
_LETTERS = "abcdefghijklmnopqrstuvwxyzéüñß"


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choices(_LETTERS, k=rng.randint(1, 9))) for _ in range(rng.randint(low, high))).capitalize()


def _text(rng: random.Random) -> str:
    """Sentences; some authors put signs after their words."""
    sign = rng.choice(("", "", "", "", "|", "%", "#", "*", "&amp;", " -", "$"))
    comma = rng.choice(("", ","))
    text = " ".join(_words(rng, 1, 18) + comma + " " + _words(rng, 1, 4).lower() + rng.choice(".....?!") for _ in range(rng.choice((1, 1, 2, 4, 8))))
    return (text[: text.find(" ")] + "." if rng.random() < 0.1 else text) + sign


def _filled(html: str, text) -> str:
    while "{}" in html:
        html = html.replace("{}", text(), 1)
    return html


def _other(rng: random.Random, kind: str) -> str:
    before, after, item, low, high, size = rng.choice(OTHERS[kind])
    stop = rng.choice(("", "", "."))
    return _filled(before + item * rng.randint(low, high) + after, lambda: _words(rng, *size) + stop)


def labelled_page(rng: random.Random) -> list[tuple[str, bool]]:
    """Pieces of a page's html in order, each with whether its texts are the article's."""
    some = lambda kinds, odds: [(_other(rng, k), False) for k in kinds if rng.random() < odds]
    open_, close = rng.choice(ARTICLE)
    title = _words(rng, 2, 12)
    parts = [(f'<!DOCTYPE html><html lang="x"><head><title>{title}</title><style>p{{}}</style><script>"</p>"</script></head><body>', False)]
    parts += some(("notice", "header", "menu", "advert", "form", "sidebar"), 0.45)
    parts.append((open_, False))
    if rng.random() < 0.85:
        head = rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"))
        parts.append((_filled(head, lambda: title), True))
    for _ in range(rng.choice((0, 1, 1, 2, 4, 8, 16))):
        parts.append((_filled(rng.choice(INSIDE), lambda: _text(rng)), True))
        if rng.random() < 0.12:
            parts += some(("advert", "sidebar", "form", "notice"), 0.4)
    if rng.random() < 0.15:
        parts += some(("comments", "form"), 0.6)
    parts.append((close, False))
    parts += some(("comments", "sidebar", "advert", "form", "footer", "menu", "footer"), 0.45)
    parts.append((rng.choice(("</body></html>", "")), False))
    return parts


def labelled_pages(n: int, seed: int = 5) -> Iterator[list[tuple[str, bool]]]:
    rng = random.Random(seed)
    for _ in range(n):
        yield labelled_page(rng)
