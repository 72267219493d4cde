"""Labelled pages for the block model: layouts whose blocks carry their label.

Each layout is a list of pieces (html with ``{}`` for text, label); label 1 marks
main text. Words are drawn from a seed, so that only structure and shape teach.
"""

from __future__ import annotations

import random

SYLLABLES = ("an", "ber", "ci", "do", "er", "fa", "gen", "hi", "in", "jo", "ka", "lo", "men", "no", "or", "pa", "que", "ra", "si", "ti", "un", "ver", "wi", "zu")


def words(rng: random.Random, n: int) -> str:
    text = " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))
    return text.capitalize()


def _sentence(rng: random.Random, least: int, most: int) -> str:
    return words(rng, rng.randint(least, most)) + rng.choice((".", ".", ".", "!", "?", ""))


def _menu(rng):
    links = "".join(f'<li><a href="/{i}">{words(rng, rng.randint(1, 2))}</a></li>' for i in range(rng.randint(3, 9)))
    return rng.choice((f"<nav><ul>{links}</ul></nav>", f'<div class="{rng.choice(("menu", "navbar", "topnav", "site-nav"))}"><ul>{links}</ul></div>', f'<ul id="menu">{links}</ul>', f'<nav class="breadcrumb"><ol>{links}</ol></nav>'))


def _aside(rng):
    body = f"<h3>{words(rng, 2)}</h3><p>{_sentence(rng, 4, 20)}</p>" + "".join(f'<li><a href="#">{words(rng, 4)}</a></li>' for _ in range(rng.randint(1, 5)))
    return rng.choice((f"<aside>{body}</aside>", f'<div class="{rng.choice(("sidebar", "side-bar", "related", "widget", "promo"))}">{body}</div>', f'<div id="sidebar"><div>{body}</div></div>', f'<section class="related"><ul>{body}</ul></section>'))


def _notice(rng):
    body = _sentence(rng, 6, 30)
    kind = rng.choice(("cookie", "cookie-banner", "notice", "consent", "popup", "alert", "banner", "newsletter", "modal"))
    button = rng.choice(("", "<button>OK</button>", f'<a href="#">{words(rng, 1)}</a>'))
    return rng.choice((f'<div class="{kind}"><p>{body}</p>{button}</div>', f'<div id="{kind}">{body}{button}</div>', f'<section class="{kind}"><p>{body}</p>{button}</section>', f'<div role="dialog" class="{kind}"><p>{body}</p></div>'))


def _advert(rng):
    kind = rng.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor"))
    return rng.choice((f'<div class="{kind}">{_sentence(rng, 3, 25)}</div>', f'<div class="{kind}"><p>{_sentence(rng, 3, 25)}</p></div>', f'<aside class="{kind}"><p>{_sentence(rng, 3, 25)}</p></aside>'))


def _form(rng):
    return f'<form action="/s"><label>{words(rng, 2)}</label><input name="q"><p>{_sentence(rng, 3, 12)}</p><select><option>{words(rng, 1)}</option><option>{words(rng, 1)}</option></select><button>{words(rng, 1)}</button></form>'


def _comments(rng):
    each = "".join(rng.choice((f'<div class="comment"><b>{words(rng, 1)}</b><p>{_sentence(rng, 3, 60)}</p></div>', f'<li class="comment"><p>{_sentence(rng, 3, 60)}</p></li>', f"<article><h4>{words(rng, 1)}</h4><p>{_sentence(rng, 3, 60)}</p></article>")) for _ in range(rng.randint(1, 5)))
    kind = rng.choice(("comments", "comment-list", "discussion", "responses", "replies"))
    return rng.choice((f'<section class="{kind}"><h2>{words(rng, 1)}</h2>{each}</section>', f'<div id="{kind}">{each}</div>', f'<ol class="{kind}">{each}</ol>'))


def _share(rng):
    kind = rng.choice(("share", "social", "tags", "byline-links", "pagination", "share-buttons"))
    return f'<div class="{kind}"><a href="#">{words(rng, 1)}</a> <a href="#">{words(rng, 1)}</a></div>'


def _footer(rng):
    body = rng.choice((f"&copy; {words(rng, 2)} {_sentence(rng, 3, 30)}", f"<p>&copy; 2020 {words(rng, 3)}</p><p>{_sentence(rng, 3, 25)}</p>", f'<a href="#">{words(rng, 2)}</a> <a href="#">{words(rng, 1)}</a><p>{_sentence(rng, 2, 20)}</p>'))
    return rng.choice((f"<footer>{body}</footer>", f'<div class="footer">{body}</div>', f'<div id="footer"><div>{body}</div></div>'))


def _top(rng):
    body = rng.choice((f"<h1>{words(rng, 2)}</h1><p>{_sentence(rng, 2, 8)}</p>", f'<a href="/">{words(rng, 2)}</a>', f"<div>{words(rng, 3)}</div>"))
    return rng.choice((f"<header>{body}</header>", f'<div class="header">{body}</div>', f'<div id="masthead" class="site-header">{body}</div>'))


def _text_block(rng):
    body = _sentence(rng, 1, 6) if rng.random() < 0.25 else _sentence(rng, 8, 90)
    link = f'<a href="#">{words(rng, 2)}</a>'
    return rng.choice((f"<p>{body}</p>",) * 8 + (f"<p><b>{body}<br>", f"<p>{body} {link} {body}</p>", f"<ul><li>{body}</li><li>{_sentence(rng, 2, 20)}</li></ul>", f"<h2>{words(rng, 4)}</h2>", f"<blockquote><p>{body}</p></blockquote>", f"<table><tr><td>{words(rng, 2)}</td><td>{words(rng, 3)}</td></tr></table>", f"<figure><img src=x><figcaption>{_sentence(rng, 3, 12)}</figcaption></figure>", f"<pre>{body}</pre>", f"<div>{body}</div>", f"<h3>{words(rng, 3)}</h3><ol><li>{body}</li></ol>"))


MARKED = (("<article>", "</article>"),) * 4 + (("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post">', "</div></div>"), ('<div class="article-body">', "</div>"), ('<section class="story">', "</section>"), ('<div class="entry-content">', "</div>"))
# Containers that say nothing: the text stands in plain divisions, a table cell or the body itself.
PLAIN = (("", ""), ("", ""), ("<div>", "</div>"), ('<div id="wrapper">', "</div>"), ('<div class="page">', "</div>"), ("<div><div>", "</div></div>"), ("<center><table><tr><td>", "</td></tr></table></center>"), ("<section>", "</section>"))


def _bare(rng) -> list[tuple[str, int]]:
    """Text without any tags but line breaks."""
    return [("<br>" + "<br>".join(_sentence(rng, 5, 60) for _ in range(rng.randint(1, 6))), 1)]


def page(rng: random.Random) -> list[tuple[str, int]]:
    """Pieces of one page with the label of all text in them."""
    if rng.random() < 0.03:
        return _bare(rng)
    boiler = lambda *kinds: [(rng.choice(kinds)(rng), 0)] if rng.random() < 0.55 else []
    out = [("<html><body>", 0), *boiler(_notice), *boiler(_top), *boiler(_menu), *boiler(_advert), *boiler(_form, _aside)]
    open_, close = rng.choice(PLAIN if rng.random() < 0.25 else MARKED)
    out.append((open_, 0))
    out.append((rng.choice((f"<h1>{words(rng, rng.randint(1, 12))}</h1>", f"<header><h1>{words(rng, 6)}</h1></header>", "")), 1))
    for _ in range(rng.randint(1, 14)):
        out.append((_text_block(rng), 1))
        if rng.random() < 0.12:
            out.append((rng.choice((_advert, _share, _aside, _notice, _form, _menu))(rng), 0))
    if rng.random() < 0.25:
        out.append((rng.choice((_comments, _share))(rng), 0))
    if close in ("", "</div>") and rng.random() < 0.1:
        out += _bare(rng)
    out.append((close, 0))
    out += [*boiler(_comments, _comments, _share), *boiler(_aside), *boiler(_form, _advert), *boiler(_footer)]
    if rng.random() < 0.5:
        out.append((_footer(rng), 0))
    return [*out, ("</body></html>", 0)]


def labelled(count: int, seed: int = 11) -> list[list[tuple[str, int]]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(count)]
