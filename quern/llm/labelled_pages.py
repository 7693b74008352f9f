"""Labelled pages to train on, put together from hand-written parts.

``data-label`` marks an element whose texts are content (1) or not (0); it holds for what lies below.
"""

from __future__ import annotations

import random

_WORDS = "river stone light winter market garden letter engine silver morning bridge harbour village signal window forest number paper music summer road field glass winding early distant careful open broken quiet narrow green heavy".split()


def _sentence(r: random.Random, least: int = 5, most: int = 18) -> str:
    words = [r.choice(_WORDS) for _ in range(r.randint(least, most))]
    return " ".join(words).capitalize() + r.choice("...!?")


def _prose(r: random.Random, least: int = 1, most: int = 6) -> str:
    if r.random() < 0.12:  # lists of words, or one word again and again, are content where they stand in an article
        return " ".join([r.choice(_WORDS).capitalize()] * r.randint(1, 60) if r.random() < 0.5 else r.choices(_WORDS, k=r.randint(1, 40)))
    text = " ".join(_sentence(r) for _ in range(r.randint(least, most)))
    return text.replace(" ", ' <a href="/x">', 1).replace(" ", "</a> ", 2) if r.random() < 0.15 else text


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{" ".join(r.choice(_WORDS) for _ in range(r.randint(1, 4)))}</a></li>' for i in range(n))


def _content(r: random.Random) -> str:
    parts = [f"<h1>{_sentence(r, 2, 9)}</h1>"] if r.random() < 0.8 else []
    if r.random() < 0.15:  # verse, dialogue, word lists: many short paragraphs
        parts += [f"<p>{_sentence(r, 1, 4)}</p>" for _ in range(r.randint(4, 40))]
    for _ in range(r.choice([1, 1, 2, 2, 3, 4, 6, 9])):
        kind = r.random()
        if kind < 0.62:
            parts.append(f"<p>{_prose(r)}</p>")
        elif kind < 0.7:
            parts.append(f"<p>{_sentence(r, 1, 3)}</p>")
        elif kind < 0.78:
            parts.append(f"<h{r.choice('23')}>{_sentence(r, 1, 5)}</h{2}>")
        elif kind < 0.84:
            parts.append("<ul>" + "".join(f"<li>{_sentence(r, 2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.89:
            parts.append(f"<blockquote><p>{_prose(r, 1, 2)}</p></blockquote>")
        elif kind < 0.92:
            parts.append(f"<pre>{_sentence(r)}\n{_sentence(r)}</pre>")
        elif kind < 0.95:
            parts.append("<table><tr><td>" + _sentence(r, 1, 4) + "</td><td>" + _sentence(r, 1, 4) + "</td></tr></table>")
        else:
            parts.append(f"<figure><img src=x><figcaption>{_sentence(r, 3, 9)}</figcaption></figure>")
    return "".join(parts)


def _small_content(r: random.Random) -> str:
    """An article of a few paragraphs, with or without a heading and with or without sentences."""
    parts = [f"<h{r.choice('112')}>{_sentence(r, 1, 6)}</h1>"] if r.random() < 0.4 else []
    for _ in range(r.choice([1, 1, 1, 2, 3])):
        parts.append(f"<p>{_prose(r, 1, 4) if r.random() < 0.7 else ' '.join(r.choices(_WORDS, k=r.choice([2, 6, 20, 80, 300])))}</p>")
    return "".join(parts)


def _junk(r: random.Random, n: int) -> list[str]:
    """Parts that aren't content."""
    makers = [
        lambda: f"<nav><ul>{_links(r, r.randint(3, 8))}</ul></nav>",
        lambda: f'<div class="{r.choice(["menu", "navbar", "main-menu", "breadcrumbs"])}"><ul>{_links(r, r.randint(2, 8))}</ul></div>',
        lambda: f'<header class="{r.choice(["site-header", "masthead", ""])}"><div class="logo"><a href="/">{_sentence(r, 1, 2)}</a></div><p>{_sentence(r, 2, 6)}</p></header>',
        lambda: f"<header><h1>{_sentence(r, 1, 3)}</h1></header>",
        lambda: f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "promo-box", "banner-ad"])}">{_prose(r, 1, 3)}</div>',
        lambda: f'<aside class="{r.choice(["sidebar", "", "widget-area"])}"><h3>{_sentence(r, 1, 3)}</h3><ul>{_links(r, r.randint(2, 6))}</ul><p>{_prose(r, 1, 2)}</p></aside>',
        lambda: f'<div id="{r.choice(["sidebar", "side", "related", "recommended", "popular-posts"])}"><h3>{_sentence(r, 1, 3)}</h3><p>{_prose(r, 1, 2)}</p></div>',
        lambda: f'<div class="{r.choice(["cookie-banner", "consent", "notice", "newsletter", "popup", "paywall-notice"])}" role="dialog"><p>{_prose(r, 1, 3)}</p><a href="#">{_sentence(r, 1, 2)}</a></div>',
        lambda: f'<form class="{r.choice(["search", "login-form", "", "subscribe"])}"><label>{_sentence(r, 1, 4)}</label><input><p>{_sentence(r, 3, 12)}</p><button>go</button></form>',
        lambda: f'<div class="{r.choice(["share", "social-links", "share-buttons"])}"><a href="#">{_sentence(r, 1, 2)}</a> <a href="#">{_sentence(r, 1, 2)}</a></div>',
        lambda: f'<footer>&copy; {_sentence(r, 1, 3)} &middot; {_prose(r, 1, 2)}</footer>',
        lambda: f'<div class="{r.choice(["footer", "site-footer", "copyright"])}"><p>&copy; 2024 {_sentence(r, 2, 8)} All rights reserved.</p></div>',
        lambda: _comments(r),
        lambda: f'<div style="display:none"><p>{_prose(r, 1, 2)}</p></div>',
    ]
    return [r.choice(makers)() for _ in range(n)]


def _comments(r: random.Random) -> str:
    each = "".join(f'<{t} class="{r.choice(["comment", "reply", "c-item"])}"><p>{_prose(r, 1, 4)}</p></{t}>' for t in [r.choice(["div", "li", "article"]) for _ in range(r.randint(1, 4))])
    tag, name = r.choice(["section", "div", "ol"]), r.choice(["comments", "comment-list", "discussion", "responses replies"])
    return f'<{tag} class="{name}" id="{r.choice(["comments", "respond", ""])}"><h3>{_sentence(r, 1, 3)}</h3>{each}</{tag}>'


def labelled_page(seed: int) -> str:
    """One page; pages of different seeds differ in parts, nesting and order."""
    r = random.Random(seed)
    zero = lambda parts: "".join(p.replace(">", ' data-label="0">', 1) for p in parts)
    small = r.random() < 0.3
    inner = [_small_content(r) if small else _content(r)]
    if small and r.random() < 0.5:
        tag = r.choice(["article", "article", "main", "div", "section", "body"])
        edges = [zero(_junk(r, r.choice([0, 0, 1]))) for _ in range(2)]
        return f'<body>{edges[0]}<{tag} data-label="1">{inner[0]}</{tag}>{edges[1]}' if tag != "body" else f'<body data-label="1">{inner[0]}</body>'
    for part in _junk(r, r.choice([0, 0, 1, 1, 2])):
        inner.insert(r.randint(0, len(inner)), zero([part]))
    if r.random() < 0.25:
        inner.append(zero([_comments(r)]))
    if r.random() < 0.15:
        inner.insert(0, f"<header>{'<h1>'}{_sentence(r, 2, 8)}</h1></header>")
    opening = r.choice(["<article", "<article", "<article", "<main", '<div class="content"', '<div class="post-body"', '<div id="article"', "<div", '<section class="story"'])
    tag = opening[1:].split(" ")[0]
    middle = f'{opening} data-label="1">{"".join(inner)}</{tag}>'
    for _ in range(r.choice([0, 0, 1, 2])):
        name = r.choice(["", ' class="wrapper"', ' id="page"', ' class="row"'])
        middle = f"<div{name}>{zero(_junk(r, r.choice([0, 1])))}{middle}{zero(_junk(r, r.choice([0, 1])))}</div>"
    end = r.choice(["</body></html>", ""])
    head = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>x</title><style>p{}</style><script>var t="</p>";</script></head>'
    return f"{head}<body>{zero(_junk(r, r.randint(0, 4)))}{middle}{zero(_junk(r, r.randint(0, 4)))}{end}"
