"""Labelled pages for the extraction model, made from layout rules.

The pages mark content with the attribute ``data-content``: 1 on the parts that belong to the article, 0 on other
parts inside it.  Anyone with pages labelled by hand trains on those instead.
"""

from __future__ import annotations

import random

CONTENT_CLASSES = ["content", "post-body", "entry-content", "article-text", "story", "top-story", "main-text", "prose", "page"]
LAYOUTS = ["<article{c}>{x}</article>", "<main><article{c}>{x}</article></main>", '<div class="{k}"{c}>{x}</div>', '<div id="{k}"><div{c}>{x}</div></div>',
           '<main{c}>{x}</main>', '<section class="{k}"{c}>{x}</section>', '<table><tr><td{c}>{x}</td></tr></table>', '<div><div><div{c}>{x}</div></div></div>']


STYLES = ["{}", "{}", "{}", "{}", "{}", "{}", "{}!!", "{}***", "{} |", "{}%%%"]  # how a page writes its words


def _words(r: random.Random, n: int, style: str = "{}") -> str:
    out = []
    for i in range(n):
        w = "".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiouéüñ") for _ in range(r.choice([1, 1, 2, 2, 3, 4])))
        out.append(w + (r.choice([",", ".", "."]) if r.random() < 0.12 else ""))
    if style == "{}":
        return " ".join(out).capitalize() + "."
    return " ".join([style.format(w.upper() if "!" in style else w) for w in out]).capitalize()


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))[:-1]}</a></li>' for i in range(n))


def _boiler(r: random.Random, kind: str) -> str:
    prose = _words(r, r.randint(3, 25))
    name = lambda *names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"'])
    return {
        "nav": lambda: f"<nav><ul>{_links(r, r.randint(3, 9))}</ul></nav>",
        "menu": lambda: f"<div{name('menu', 'navbar', 'topnav', 'breadcrumbs')}><ul>{_links(r, r.randint(3, 9))}</ul></div>",
        "header": lambda: f'<header><a href="/">{_words(r, 2)}</a><p>{_words(r, r.randint(2, 8))}</p></header>',
        "banner": lambda: f"<div{name('header', 'masthead', 'site-header')}><h1>{_words(r, 2)}</h1><p>{_words(r, 6)}</p></div>",
        "footer": lambda: f"<footer>&copy; {_words(r, r.randint(1, 3))} &middot; {prose}</footer>",
        "foot": lambda: f"<div{name('footer', 'site-footer', 'copyright')}><p>&copy; {prose}</p></div>",
        "aside": lambda: f"<aside><h3>{_words(r, 2)}</h3><ul>{_links(r, 4)}</ul><p>{prose}</p></aside>",
        "sidebar": lambda: f"<div{name('sidebar', 'widget', 'related', 'recommended')}><h2>{_words(r, 2)}</h2><p>{prose}</p><ul>{_links(r, 3)}</ul></div>",
        "ad": lambda: f"<div{name('ad', 'ads', 'advert', 'sponsored', 'promo')}>{prose}</div>",
        "notice": lambda: f"<div{name('cookie-notice', 'consent', 'notice', 'alert', 'newsletter')}><p>{prose}</p><button>OK</button></div>",
        "form": lambda: f'<form action="/s"><label>{_words(r, 3)}</label><input name="q"><button>Go</button></form>',
        "comments": lambda: f"<{(t := r.choice(['section', 'div']))}{name('comments', 'comment-list', 'responses', 'discussion')}><h3>{_words(r, 2)}</h3>" + "".join(
            f'<div class="{r.choice(["comment", "reply"])}"><b>{_words(r, 1)}</b><p>{_words(r, r.randint(5, 60))}</p></div>' for _ in range(r.randint(1, 5))) + f"</{t}>",
        "plain": lambda: r.choice(["<div><p>{}</p></div>", "<div>{}</div>", "<p>{}</p>"]).format(_words(r, r.randint(1, 9))),
        "share": lambda: f"<div{name('share', 'social')}><a href='#'>{_words(r, 1)}</a><a href='#'>{_words(r, 1)}</a></div>",
    }[kind]()


KINDS = ["nav", "menu", "header", "banner", "footer", "foot", "aside", "sidebar", "ad", "notice", "form", "comments", "share"]


def _paragraphs(r: random.Random) -> str:
    parts = [f"<h1>{_words(r, r.randint(1, 9))}</h1>"] if r.random() < 0.65 else []
    if parts and r.random() < 0.2:  # the article's own header
        parts = [f"<header{r.choice(['', ' class=\"entry-header\"', ' class=\"post-header\"'])}>{parts[0]}</header>"]
    style = r.choice(STYLES)
    for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 12, 40])):
        text = _words(r, r.choice([r.randint(1, 10), r.randint(8, 110), r.randint(8, 110), r.randint(8, 110), r.randint(100, 450)]), style)
        if r.random() < 0.2:
            words = text.split()
            at = r.randrange(len(words))
            words[at] = f'<a href="/x">{words[at]}</a>'
            text = " ".join(words)
        roll = r.random()
        if roll < 0.12:
            parts.append(f"<p><b>{text}<br>")
        elif roll < 0.17:
            parts.append(f"<h2>{_words(r, r.randint(1, 6))}</h2>")
        elif roll < 0.22:
            parts.append("<ul>" + "".join(f"<li>{_words(r, r.randint(2, 14))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif roll < 0.26:
            parts.append(f"<blockquote>{text}</blockquote>")
        elif roll < 0.29:
            parts.append(f"<pre>{text}</pre>")
        elif roll < 0.32:
            parts.append(f"<table><tr><td>{_words(r, 3)}</td><td>{_words(r, 4)}</td></tr></table>")
        elif roll < 0.36:
            parts.append(f"<div>{text}</div>")
        else:
            parts.append(f"<p>{text}</p>")
        if r.random() < 0.05:
            parts.append(_boiler(r, r.choice(["ad", "share", "notice", "sidebar", "form"])).replace(">", ' data-content="0">', 1))
    return "".join(parts)


def training_pages(n: int, seed: int = 5) -> list[str]:
    """``n`` labelled pages; the same for the same seed."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        layout = r.choice(LAYOUTS)
        if r.random() < 0.12:  # no container at all
            body = "".join(f'<p data-content="1">{_words(r, r.randint(12, 120))}</p>' for _ in range(r.randint(1, 6)))
        else:
            body = layout.format(c=' data-content="1"', k=r.choice(CONTENT_CLASSES), x=_paragraphs(r))
        kinds = KINDS + ["plain"] * 2 if layout.startswith(("<main", "<article")) and body[:2] != "<p" else KINDS
        before = [_boiler(r, r.choice(kinds)) for _ in range(r.randint(0, 4))]
        after = [_boiler(r, r.choice(kinds)) for _ in range(r.randint(0, 4))]
        inner = "".join([*before, body, *after])
        if r.random() < 0.05:  # nothing but the text
            pages.append(r.choice(['<body data-content="1">{}</body>', '<html data-content="1">{}</html>', '<div data-content="1">{}</div>']).format(r.choice([_words(r, r.randint(3, 60)), _paragraphs(r)])))
            continue
        if r.random() < 0.4:
            inner = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{inner}</div>'
        if r.random() < 0.1:  # a fragment
            pages.append(inner)
            continue
        head = f"<head><title>{_words(r, 5)}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.8 else ""
        pages.append(f"<!DOCTYPE html><html>{head}<body>{inner}</body></html>")
    return pages
