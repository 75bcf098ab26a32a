"""Labelled pages for the block tagger of op 11: invented pages of several layouts, each with the blocks of its article.

Every page is made anew from a seed: invented words, regions in varying order,
some of them missing, with element and class names drawn from lists of what
sites use. The same region appears under telling names, under opaque ones and
without any, so that a tagger has to weigh elements, names and text together.
"""

from __future__ import annotations

import html
import random

#: Class words of each kind of region; one or two of them name a region.
NAMES = {
    "article": "article post entry story content body text main page single hentry".split(),
    "menu": "menu nav navigation navbar topnav breadcrumb breadcrumbs links tabs pagination pager".split(),
    "header": "header masthead banner top branding site topbar".split(),
    "footer": "footer bottom colophon legal copyright site foot".split(),
    "sidebar": "sidebar side aside widget related recommended popular trending more secondary rail".split(),
    "notice": "cookie consent notice gdpr alert popup modal banner message subscribe newsletter paywall".split(),
    "advert": "ad ads advert advertisement sponsored promo promoted sponsor banner outbrain".split(),
    "form": "form search login signup contact subscribe newsletter".split(),
    "comments": "comments comment replies responses discussion disqus reply feedback thread".split(),
    "share": "share social sharing tags meta byline author author-box date".split(),
}
_ELEMENTS = {"menu": ("nav", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div"), "notice": ("div", "section", "dialog"), "advert": ("div", "aside", "section"), "form": ("form",), "comments": ("section", "div"), "share": ("div", "ul")}
_LABELS = "Home|About us|Contact|Sign in|Log in|News|Sport|Next|Previous|Read more|Search|Subscribe|Menu|Back to top|Share|Follow us|Reply|Help".split("|")
_SAYS = {
    "notice": ("We use cookies to improve this site.", "Accept all cookies", "Subscribe to our newsletter today.", "Please sign in to read on."),
    "footer": ("© 2020 All rights reserved.", "Terms of use and privacy policy", "Copyright by the owners.", "Powered by the site"),
    "advert": ("Advertisement", "Sponsored", "Buy one now and save!", "Promoted by a partner"),
    "share": ("Share this", "By a writer, 4 May 2019", "Tags: one, two", "5 min read"),
    "sidebar": ("Related stories", "Most read", "You may also like", "Trending now"),
    "comments": ("Comments (3)", "Leave a reply", "Reply", "2 hours ago"),
}


class _Page:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.main: list[str] = []
        self.named = self.rng.random() < 0.7  # else class names are opaque or absent
        self.semantic = self.rng.random() < 0.6  # elements such as nav and article
        self.syllables = ["".join(self.rng.choice(s) for s in ("bcdfglmnprstväéжк", "aeiouöиа", "nrstl" + " " * 3)).strip() for _ in range(40)]

    def words(self, n: int) -> str:
        out = ["".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(1, 3))) for _ in range(max(1, n))]
        return " ".join(w + ("," if self.rng.random() < 0.08 else "") for w in out[:-1]) + (" " if n > 1 else "") + out[-1]

    def prose(self, sentences: int) -> str:
        return " ".join(self.words(self.rng.randint(1, 16)).capitalize() + self.rng.choice("......!?") for _ in range(max(1, sentences)))

    def attributes(self, kind: str) -> str:
        roll = self.rng.random()
        if not self.named:
            return "" if roll < 0.5 else f' class="css-{self.rng.randint(100, 999)}x"'
        name = self.rng.choice(("-", " ", "_")).join(self.rng.sample(NAMES[kind], self.rng.choice((1, 1, 2))))
        return f' id="{name}"' if roll < 0.2 else f' class="{name}"' if roll < 0.9 else ""

    def wrap(self, kind: str, inner: str) -> str:
        e = self.rng.choice(_ELEMENTS[kind]) if self.semantic or kind == "form" else "div"
        return f"<{e}{self.attributes(kind)}>{inner}</{e}>"

    def text(self, s: str) -> str:
        s = html.escape(s, quote=False)
        if self.rng.random() < 0.2 and " " in s:
            first, rest = s.split(" ", 1)
            s = f"{self.rng.choice(('<b>', '<em>', '<a href=/x>'))}{first}{self.rng.choice(('</b>', '</em>', '</a>'))} {rest}"
        return s

    def links(self, n: int) -> str:
        items = [self.rng.choice(_LABELS) if self.rng.random() < 0.4 else self.words(self.rng.randint(1, 4)) for _ in range(n)]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{i}">{html.escape(x)}</a></li>' for i, x in enumerate(items)) + "</ul>"
        return " | ".join(f'<a href="/{i}">{html.escape(x)}</a>' for i, x in enumerate(items))

    def region(self, kind: str) -> str:
        rng, say = self.rng, lambda: self.text(rng.choice(_SAYS.get(kind, ("",))) if rng.random() < 0.6 else self.prose(rng.randint(1, 2)))
        if kind == "menu":
            inner = self.links(rng.randint(2, 8))
        elif kind == "header":
            inner = f"<h1>{self.words(2)}</h1>" if rng.random() < 0.5 else f"<div>{self.words(3)}</div>"
            inner += self.links(rng.randint(0, 4)) if rng.random() < 0.6 else ""
        elif kind == "sidebar":
            inner = "".join(f"<h3>{say()}</h3>{self.links(rng.randint(2, 5))}" + (f"<p>{self.prose(rng.randint(1, 3))}</p>" if rng.random() < 0.4 else "") for _ in range(rng.randint(1, 3)))
        elif kind == "form":
            inner = f"<label>{self.words(1)}</label><input name=q><p>{self.prose(1)}</p><button>{rng.choice(_LABELS)}</button>"
        elif kind == "comments":
            one = lambda: f"<{e}{self.attributes('comments')}><div>{self.words(2)}</div><p>{self.text(self.prose(rng.randint(1, 5)))}</p></{e}>"
            e = rng.choice(("li", "div", "div", "article") if self.named else ("li", "div"))
            inner = f"<h2>{say()}</h2>" + "".join(one() for _ in range(rng.randint(1, 6)))
        else:
            e = rng.choice(("p", "div", "span"))
            inner = "".join(f"<{e}>{say()}</{e}>" for _ in range(rng.randint(1, 2)))
            inner = say() if rng.random() < 0.3 else inner
        return self.wrap(kind, inner)

    def block(self, e: str, s: str) -> str:
        self.main.append(s)
        close = "" if e in ("p", "li") and self.rng.random() < 0.15 else f"</{e}>"
        return f"<{e}>{self.text(s)}{close}"

    def article(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.75:
            out.append(self.block(rng.choice(("h1", "h1", "h2")), self.words(rng.randint(2, 10)).capitalize()))
        if rng.random() < 0.3:
            out.append(self.region("share"))
        if self.semantic and rng.random() < 0.3:
            out = [f"<header{self.attributes('header') if rng.random() < 0.3 else ''}>{''.join(out)}</header>"]
        for _ in range(rng.choice((1, 1, 2, 4, 8, 14, 25))):
            roll = rng.random()
            if roll < 0.78:
                out.append(self.block("p", self.prose(rng.choice((1, 1, 2, 4, 8)))))
            elif roll < 0.86:
                out.append(self.block(rng.choice(("h2", "h3")), self.words(rng.randint(1, 6)).capitalize()))
            elif roll < 0.92:
                e = rng.choice(("ul", "ol"))
                out.append(f"<{e}>" + "".join(self.block("li", self.prose(1)) for _ in range(rng.randint(2, 5))) + f"</{e}>")
            elif roll < 0.96:
                out.append(f"<blockquote>{self.block('p', self.prose(2))}</blockquote>")
            else:
                out.append(self.region(rng.choice(("advert", "sidebar", "notice", "form"))))
        inner = "".join(out)
        if self.semantic and rng.random() < 0.3:
            inner = f"<section>{inner}</section>"
        if self.semantic and rng.random() < 0.15:
            inner += f"<footer>{self.words(rng.randint(1, 5))}</footer>"
        if rng.random() < 0.25:  # comments inside the article's element
            inner += self.region("comments")
        if self.semantic and rng.random() < 0.8:
            return f"<article{self.attributes('article')}>{inner}</article>"
        return f"<div{self.attributes('article')}>{inner}</div>"

    def html(self) -> str:
        rng = self.rng
        some = lambda kinds, share: "".join(self.region(k) for k in kinds if rng.random() < share)
        if rng.random() < 0.08:  # text without any element
            text = self.prose(rng.randint(1, 12))
            self.main.append(text)
            return f"<html><body>{self.text(text)}</body></html>" if rng.random() < 0.5 else self.text(text)
        few = rng.random() < 0.15
        before, after = "" if few else some(("notice", "header", "menu", "form", "advert"), 0.5), ["sidebar", "comments", "share", "notice", "advert", "footer"]
        if rng.random() < 0.3:
            before += self.region("sidebar")
        body = self.article()
        if rng.random() < 0.3:
            body = f"<main>{body}</main>" if self.semantic else f"<div{self.attributes('article')}>{body}</div>"
        rest = some(["footer"], 0.5) if few else some(after, 0.5)
        if rng.random() < 0.1:
            inner = f"<table><tr><td>{before}</td><td>{body}</td></tr></table>{rest}"
        else:
            inner = before + body + rest
        if rng.random() < 0.3:
            inner = f"<div>{inner}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(3)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{inner}</body></html>"


def labelled(pages: int, first: int = 0) -> list[tuple[str, str]]:
    """(html, text) of pages; text: the article's blocks, joined by two line feeds."""
    out = []
    for seed in range(first, first + pages):
        page = _Page(seed)
        out.append((page.html(), "\n\n".join(page.main)))
    return out
