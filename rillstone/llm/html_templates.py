"""Labelled pages from which the weights of main-text extraction are learnt, made from many templates by a seed.

A page is a frame, one place for its main text, and boilerplate before, beside, inside and after it. Each piece has
its element, classes and text drawn at random, many without any telling class, so that weights spread over
structure, links, lengths and punctuation too.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

# Class words of boilerplate by what it is, as site builders commonly name it
NAMES = {
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs toolbar topbar skip pager pagination tabs".split(),
    "header": "header masthead banner logo branding top".split(),
    "footer": "footer copyright legal imprint bottom colophon".split(),
    "side": "sidebar widget related recommended popular trending tags categories archive archives aside rail".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion promoted".split(),
    "notice": "cookie cookies consent gdpr notice notification popup modal alert overlay".split(),
    "form": "form search newsletter subscribe signup login".split(),
    "share": "share sharing social follow".split(),
    "comments": "comment comments replies disqus discussion respond".split(),
}
MAIN = "content post entry article story text body main main page single".split()
INNER = "section header title lead intro meta byline comment note figure caption highlight code box first last".split()
PLAIN = "row col wrap inner outer x1 box a1 c2 block left right container grid".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("bdfglmnprstvw") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.r.choice("...?!") for _ in range(self.r.randint(a, b)))

    def classes(self, names: list[str], sure: float) -> str:
        """A class or id, telling with chance `sure`."""
        r = self.r
        if r.random() >= sure:
            return r.choice(["", "", f' class="{r.choice(PLAIN)}"', f' class="{self.word()}"'])
        name = r.choice(names)
        if r.random() < 0.4:
            name = f"{r.choice([*PLAIN, 'site', 'page', 'js'])}{r.choice('-_')}{name}"
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def link(self, a: int = 1, b: int = 4) -> str:
        return f'<a href="/{self.word()}">{self.words(a, b).capitalize()}</a>'

    def links(self) -> str:
        r, n = self.r, self.r.randint(2, 9)
        if r.random() < 0.7:
            tag = r.choice(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.link()}{r.choice(['', '</li>'])}" for _ in range(n)) + f"</{tag}>"
        return r.choice([" ", " | ", "<br>"]).join(self.link() for _ in range(n))

    def boilerplate(self, kind: str) -> str:
        r, names = self.r, NAMES[kind]
        element = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "div", "section"]}
        tag = r.choice(element.get(kind, ["div", "div", "section", "aside", "p"] if kind in ("advert", "notice") else ["div", "section"]))
        attrs = self.classes(names, 0.3 if tag in ("nav", "header", "footer", "aside") else 0.8)
        if kind == "menu":
            inside = self.links()
            if tag == "ul":
                return f"<ul{attrs}>" + "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(3, 8))) + "</ul>"
        elif kind == "header":
            inside = r.choice([self.link(), f"<h1>{self.link()}</h1>", f"<h1>{self.words(1, 4).title()}</h1>", f"<p>{self.words(2, 9)}</p>"]) + r.choice(["", self.links()])
        elif kind == "footer":
            inside = r.choice(["", self.links(), f"<p>{self.links()}</p>"]) + f"<p>&copy; {self.words(2, 8)} &middot; {r.choice([self.words(2, 9), self.sentences(1, 2)])}</p>"
        elif kind == "side":
            inside = f"<h{r.randint(2, 4)}>{self.words(1, 3)}</h3>" + r.choice([self.links(), f"<p>{self.sentences(1, 2)} {self.link()}</p>", self.links()])
        elif kind == "advert":
            inside = r.choice([self.words(2, 9), self.sentences(1, 1), self.link(2, 7), f"<p>{self.sentences(1, 2)}</p>{self.link()}"])
        elif kind == "notice":
            inside = r.choice(["", "<p>"]) + self.sentences(1, 2) + r.choice(["", self.link()]) + f"<button>{self.words(1, 2)}</button>"
        elif kind == "form":
            if r.random() < 0.4:
                return f"<form{attrs}>{self.words(1, 3)} <input></form>"
            return f"<form{attrs}><label>{self.words(1, 3)}</label><input><p>{r.choice(['', self.words(1, 6)])}</p><button>{self.words(1, 2)}</button></form>"
        elif kind == "share":
            inside = self.words(1, 2) + " " + self.links()
        else:
            one = lambda: f"<{r.choice(['p', 'div', 'li'])}>{r.choice([self.words(1, 4) + '!', self.sentences(1, 4)])}"
            inside = f"<h3>{self.words(1, 3)}</h3>" + "".join(f"<div{self.classes(names, 0.6)}><b>{self.word()}</b> {one()}</div>" for _ in range(r.randint(1, 6)))
        if r.random() < 0.05:
            attrs += ' style="display:none"'
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def block(self) -> tuple[str, list[str]]:
        """A piece of main text and the text of its blocks."""
        r, k = self.r, self.r.random()
        attrs = self.classes(INNER, 1.0) if r.random() < 0.15 else ""
        if k < 0.6:
            t = self.sentences(1, 7) if r.random() < 0.7 else self.words(1, 4).capitalize() + "."
            if r.random() < 0.25:  # as it may end: cut short, or with a mark of another kind
                t = t[:-1] + r.choice(["", "", "|", "#", "***", " -", "&&", "%"])
            cut = t.split(" ")
            if r.random() < 0.4 and len(cut) > 3:
                i = r.randrange(len(cut) - 1)
                mark = r.choice([f'<a href="/{self.word()}">%s</a>', "<b>%s</b>", "<em>%s</em>", '<span class="hl-comment">%s</span>'])
                cut[i] = mark % cut[i]
            return f"<p{attrs}>{' '.join(cut)}{r.choice(['', '</p>', '</p>'])}", [t]
        if k < 0.75:
            t, n = self.words(1, 8).capitalize(), r.randint(2, 4)
            return f"<h{n}{attrs}>{t}</h{n}>", [t]
        if k < 0.85:
            items = [r.choice([self.words(1, 12), self.sentences(1, 2)]) for _ in range(r.randint(2, 6))]
            return "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>", items
        if k < 0.9:
            t = self.sentences(1, 3)
            return f"<blockquote{attrs}>{t}</blockquote>", [t]
        if k < 0.94:
            t = self.words(2, 14)
            return f"<pre{attrs}><code>{t}</code></pre>", [t]
        if k < 0.97:
            cells = [self.words(1, 3) for _ in range(4)]
            return "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2], strict=True)) + "</table>", cells
        t = self.words(2, 10).capitalize()
        return f"<figure><img src=x><figcaption{attrs}>{t}</figcaption></figure>", [t]

    def page(self) -> tuple[str, set[str]]:
        r = self.r
        if r.random() < 0.2:  # a page that is its main text, hardly marked up
            texts = [self.words(1, 6) for _ in range(r.choice([1, 1, 2, 3]))]
            tags = r.choice([("", ""), ("<p>", ""), ("<p>", "</p>"), ("<div>", "</div>")])
            texts = texts if tags[0] else texts[:1]
            return "".join(f"{tags[0]}{t}{tags[1]}" for t in texts), set(texts)
        main, texts = "", []
        if r.random() < 0.8:
            t = self.words(2, 12).capitalize()
            main, texts = f"<h1>{t}</h1>", [t]
        plain = r.random() < 0.1  # no paragraphs, only lines
        for _ in range(r.choice([1, 2, 3, 5, 9])):
            piece, own = self.block()
            if plain:
                t = self.sentences(1, 5)
                piece, own = f"{t}<br><br>" if r.random() < 0.5 else f"<div>{t}</div>", [t]
            main, texts = main + piece, texts + own
            if r.random() < 0.25:
                main += self.boilerplate(r.choice(["advert", "side", "share", "form", "notice"]))
        if plain:  # lines that breaks part are one block
            texts += [" ".join(texts[i:j]) for i in range(len(texts)) for j in range(i + 2, len(texts) + 1)]
        k = r.random()
        if k < 0.35:
            main = f"<article{r.choice(['', self.classes(MAIN, 0.7)])}>{main}{self.boilerplate('comments') if r.random() < 0.1 else ''}</article>"
        elif k < 0.5:
            main = f"<main>{main}</main>"
        elif k < 0.9:
            tag = r.choice(["div", "div", "div", "section", "td"])
            main = f"<{tag}{self.classes(MAIN, 0.65)}>{main}</{tag}>"
            main = f"<table><tr><td>{self.links()}</td>{main}</tr></table>" if tag == "td" else main
        before = [self.boilerplate(x) for x in ("menu", "header", "notice", "advert", "side", "form", "share") if r.random() < 0.3]
        after = [self.boilerplate(x) for x in ("comments", "side", "advert", "share", "form", "menu", "notice") if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        foot = self.boilerplate("footer") if r.random() < 0.7 else ""
        whole = "".join(before) + main + "".join(after) + foot
        if r.random() < 0.1:
            whole = f"<form id=page><div>{whole}</div></form>"
        if r.random() < 0.4:
            whole = f"<div{self.classes(PLAIN, 1.0)}>{whole}</div>"
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{whole}</body></html>", {" ".join(t.split()) for t in texts}


def labelled_pages(n: int = 800, seed: int = 1) -> Iterator[tuple[str, set[str]]]:
    """(page, texts of the blocks of its main text); other seeds give other pages."""
    make = Maker(seed)
    for _ in range(n):
        yield make.page()
