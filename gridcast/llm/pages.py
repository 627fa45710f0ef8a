"""Labelled pages for training the extractor: layouts composed by rule, every region with a known label.

The given tables label no page, so pages are put together from regions whose role is known when they are written: an
article body of headings, paragraphs, lists, quotes and tables, and around or inside it menus, headers, footers,
sidebars, notices, adverts, forms and reader comments. The attribute ``data-label`` carries the label (1 main text,
0 other) of an element and of what it holds; training reads it and never sees it as a feature.
"""

from __future__ import annotations

import random

# Names commonly given to regions of a page.
MAIN = ["article", "main", "content", "post", "entry", "story", "body", "text", "page", "blog", "single", "news", "prose", "copy"]
OTHER = {
    "menu": ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "links", "pagination", "pager", "tabs"],
    "header": ["header", "masthead", "topbar", "banner", "branding", "logo", "site", "head"],
    "footer": ["footer", "foot", "copyright", "legal", "bottom", "colophon", "credits"],
    "sidebar": ["sidebar", "aside", "widget", "rail", "related", "recommended", "popular", "trending", "more", "side", "tags", "author", "bio"],
    "notice": ["notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "warning", "privacy", "message", "disclaimer", "paywall"],
    "advert": ["ad", "ads", "advert", "advertisement", "adbox", "sponsor", "sponsored", "promo", "promotion", "promoted", "banner", "dfp", "adsense", "adslot", "affiliate"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "contact", "poll", "survey"],
    "comment": ["comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "responses", "reader", "feedback", "thread"],
    "share": ["share", "social", "sharing", "toolbar", "print", "follow", "buttons", "tools", "meta", "byline"],
}
TAGS = {
    "menu": ["nav", "nav", "div", "ul"],
    "header": ["header", "header", "div"],
    "footer": ["footer", "footer", "div"],
    "sidebar": ["aside", "aside", "div", "section"],
    "notice": ["div", "section", "aside", "dialog"],
    "advert": ["div", "div", "aside", "section", "ins", "figure"],
    "form": ["form", "form", "div", "section"],
    "comment": ["section", "div", "ol", "ul", "article"],
    "share": ["div", "ul"],
}
INLINE = ["b", "i", "em", "strong", "span", "a href='/x'", "code"]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        out = ["".join(self.rng.choice("aeioustnrlm") for _ in range(self.rng.randint(1, 8))) for _ in range(n)]
        if self.rng.random() < 0.3 and n > 3:
            tag = self.rng.choice(INLINE)
            out[1] = f"<{tag}>{out[1]}</{tag.split()[0]}>"
        return " ".join(out)

    def prose(self, low: int, high: int) -> str:
        """Words in sentences, now and then with an inline element."""
        out = self.words(low, high).split(" ")
        start = 0
        for at in range(len(out)):
            if at == len(out) - 1 or at - start > 3 and self.rng.random() < 0.12:
                out[at] += self.rng.choice(".....!?")
                start = at + 1
            elif self.rng.random() < 0.06:
                out[at] += ","
        return " ".join(out)

    def named(self, names: list[str], extra: str = "") -> str:
        """A class or id made of one of the names, now and then joined to a neutral word."""
        if self.rng.random() < 0.15:
            return ""
        name = self.rng.choice(names)
        name = self.rng.choice([name, name, f"{name}-{self.rng.choice(['inner', 'box', 'wrap', 'main1', 'x2', 'area', 'block'])}", f"c{self.rng.randint(1, 9)} {name}"])
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int) -> str:
        kind = self.rng.choice(["ul", "div", "p"])
        inner = "li" if kind == "ul" else "span"
        return f"<{kind}>" + "".join(f'<{inner}><a href="/{i}">{self.words(1, 3)}</a></{inner}>' for i in range(n)) + f"</{kind}>"

    def other(self, role: str) -> str:
        tag = self.rng.choice(TAGS[role])
        name = self.named(OTHER[role]) if tag in ("nav", "header", "footer", "aside", "form") else ""
        while not name and tag not in ("nav", "header", "footer", "aside", "form"):
            name = self.named(OTHER[role])
        if role in ("menu", "share"):
            inside = self.links(self.rng.randint(2, 8))
        elif role == "form":
            inside = f"<label>{self.words(1, 4)}</label><input name='q'><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><p>{self.words(2, 20)}</p><button>{self.words(1, 2)}</button>"
        elif role == "comment":
            one = self.rng.choice([("div", ' class="comment"'), ("li", ""), ("article", ' class="comment"'), ("p", "")]) if tag not in ("ul", "ol") else ("li", "")
            if one[0] == "li" and self.rng.random() < 0.5:
                inside = "".join(f"<li>{self.rng.choice([self.prose, self.words])(2, 40)}</li>" for _ in range(self.rng.randint(1, 5)))
                return f'<{tag}{name} data-label="0">{inside}</{tag}>'
            inside = self.rng.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(f"<{one[0]}{one[1]}>{self.rng.choice(['', f'<h4>{self.words(1, 2)}</h4>']) if one[0] != 'p' else ''}{self.words(2, 60) if one[0] == 'p' else f'<p>{self.words(2, 60)}</p>'}</{one[0]}>" for _ in range(self.rng.randint(1, 5)))
        else:
            top = self.rng.choice(["h1", "h1", "h2", "p"] if role == "header" else ["h2", "h3", "h4", "p"])
            title = f"<{top}>{self.words(1, 4)}</{top}>"
            inside = self.rng.choice(
                [self.words(1, 40), f"<p>{self.rng.choice([self.prose, self.words])(2, 60)}</p>", title, f"{title}{self.links(self.rng.randint(2, 6))}", f"{title}<p>{self.words(3, 50)}</p><p>{self.words(3, 30)}</p>"]
            )
        return f'<{tag}{name} data-label="0">{inside}</{tag}>'

    def block(self) -> str:
        pick = self.rng.random()
        if pick < 0.62:
            return f"<p>{self.rng.choice([self.prose, self.prose, self.words])(1, self.rng.choice([2, 6, 25, 80]))}" + self.rng.choice(["</p>", "</p>", f"<br>{self.words(1, 10)}", ""])
        if pick < 0.72:
            return f"<h2>{self.words(1, 8)}</h2>"
        if pick < 0.80:
            kind = self.rng.choice(["ul", "ol"])
            return f"<{kind}>" + "".join(f"<li>{self.words(1, 25)}</li>" for _ in range(self.rng.randint(1, 5))) + f"</{kind}>"
        if pick < 0.85:
            return f"<blockquote><p>{self.words(2, 40)}</p></blockquote>"
        if pick < 0.90:
            return f"<table><tr><th>{self.words(1, 3)}</th><td>{self.words(1, 6)}</td></tr></table>"
        if pick < 0.93:
            return f"<figure><img src='a'><figcaption>{self.words(2, 15)}</figcaption></figure>"
        if pick < 0.95:
            return f"<pre>{self.words(2, 20)}</pre>"
        if pick < 0.985:
            return f"<section>{self.rng.choice(['', f'<h3>{self.words(1, 5)}</h3>'])}{''.join(f'<p>{self.words(1, 40)}</p>' for _ in range(self.rng.randint(1, 3)))}</section>"
        return f"<div{self.rng.choice(['', self.named(['section', 'row', 'part', 'column', 'chapter', 'inner'])])}>{self.rng.choice([self.words(2, 40), f'<p>{self.words(2, 40)}</p>'])}</div>"

    def main(self, bare: bool) -> str:
        parts = [f"<h1>{self.words(1, 12)}</h1>"] * (self.rng.random() < 0.85)
        for _ in range(self.rng.choice([1, 2, 3, 5, 8, 12])):
            parts.append(self.block())
            if self.rng.random() < 0.08:
                parts.append(self.other(self.rng.choice(["advert", "sidebar", "form", "share", "notice"])))
        if self.rng.random() < 0.35:
            parts.append(self.other(self.rng.choice(["comment", "comment", "comment", "share", "sidebar", "footer"])))
        if self.rng.random() < 0.1:
            parts.insert(0, self.other("header"))
        if bare:
            return "".join(parts)
        tag = self.rng.choice(["article", "article", "main", "div", "section"])
        name = self.named(MAIN) if tag in ("article", "main") and self.rng.random() < 0.5 else ""
        while not name and tag in ("div", "section"):
            name = self.named(MAIN)
        return f'<{tag}{name} data-label="1">{"".join(parts)}</{tag}>'

    def html(self) -> str:
        before = [self.other(r) for r in ("notice", "header", "menu", "advert", "form") if self.rng.random() < 0.5]
        after = [self.other(r) for r in ("comment", "sidebar", "advert", "form", "menu") if self.rng.random() < 0.35]
        after += [self.other("footer")] * (self.rng.random() < 0.8)
        bare = self.rng.random() < 0.08  # the article stands in the body itself
        body = "".join(before) + self.main(bare) + "".join(after)
        if not bare and self.rng.random() < 0.3:
            body = f'<div{self.named(["wrapper", "container", "layout", "row", "page", "root"])}>{body}</div>'
        if self.rng.random() < 0.2:  # some sites wrap the article once more
            body = body.replace("<h1>", '<div class="inner"><h1>', 1)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{}}</style></head><body{' data-label="1"' * bare}>{body}<script>x('<p>')</script></body></html>"


class _Nameless(_Page):
    """Pages whose names say nothing, from bare text to nested boxes; what is main text shows in the text itself."""

    def box(self, inside: str, label: int, deep: int = 1) -> str:
        for _ in range(deep):
            code = "".join(self.rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=self.rng.randint(2, 6)))
            name = self.rng.choice([f' class="css-{code}"', f' class="{code}"', f' id="{code}"', "", f' class="{code} sc-{code}"'])
            inside = f'<{self.rng.choice(["div", "div", "div", "section", "td"])}{name} data-label="{label}">{inside}</div>'
        return inside

    def text(self) -> str:
        """Main text of paragraphs, with the elements that go between them."""
        parts = [f"<h{self.rng.randint(1, 3)}>{self.words(1, 10)}</h1>"] * (self.rng.random() < 0.5)
        for _ in range(self.rng.choice([1, 2, 2, 3, 5, 9])):
            pick, low = self.rng.random(), self.rng.choice([1, 3, 8, 20])
            if pick < 0.75:
                parts.append(f"<p>{self.rng.choice([self.prose, self.prose, self.words])(low, low * 5)}</p>")
            elif pick < 0.85:
                parts.append(self.box(self.prose(low, low * 6), 1))
            else:
                parts.append(self.block())
        return "".join(parts)

    def aside(self) -> str:
        """What stands around it: link lists, short lines, forms, footers."""
        pick = self.rng.random()
        if pick < 0.45:
            inside = self.links(self.rng.randint(3, 9))
        elif pick < 0.6:
            inside = f"<input name='q'><button>{self.words(1, 2)}</button>"
        elif pick < 0.8:
            inside = f"<a href='/'>{self.words(1, 3)}</a> <a href='/'>{self.words(1, 2)}</a>"
        else:
            inside = f"&copy; {self.words(1, 3)} <a href='/'>{self.words(1, 2)}</a>"
        tag = self.rng.choice(["div", "div", "nav", "footer", "header", "aside", "form"])
        return f'<{tag} data-label="0">{inside}</{tag}>' if tag != "div" else self.box(inside, 0)

    def html(self) -> str:
        pick = self.rng.random()
        if pick < 0.1:  # a few words in a few plain elements
            low = self.rng.randint(1, 4)
            parts = [self.rng.choice([f"<p>{self.words(low, low * 2)}</p>", f"<p>{self.words(low, low * 2)}</p>", f"<h2>{self.words(1, 3)}</h2>", self.box(self.words(low, low * 2), 1)]) for _ in range(self.rng.randint(1, 4))]
            return self.rng.choice(['<!DOCTYPE html data-label="1">', '<body data-label="1">']) + "".join(parts)
        if pick < 0.25:  # no markup at all
            return '<!DOCTYPE html data-label="1">' + self.rng.choice(["\n", "\n\n", " "]).join(self.rng.choice([self.prose, self.words])(1, self.rng.choice([2, 5, 60])) for _ in range(self.rng.randint(1, 4)))
        if pick < 0.45:
            return self.rng.choice(['<body data-label="1">', '<html><body data-label="1">', '<!DOCTYPE html data-label="1">']) + self.text()
        parts = [self.box(self.text(), 1, self.rng.randint(1, 4))]
        parts = [self.aside() for _ in range(self.rng.randint(0, 3))] + parts + [self.aside() for _ in range(self.rng.randint(0, 3))]
        body = "".join(parts)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title></head><body>{self.box(body, 0) if self.rng.random() < 0.3 else body}</body></html>"


#: Share of training pages without telling names
NAMELESS = 0.4


def labelled_pages(n: int = 1200, seed: int = 5, nameless: float = NAMELESS) -> list[str]:
    """``n`` pages with ``data-label`` on the elements whose role is known; the same for the same seed."""
    rng = random.Random(seed)
    return [(_Nameless if rng.random() < nameless else _Page)(rng).html() for _ in range(n)]
