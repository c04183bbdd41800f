"""Labelled pages on which the block labeller of html_extract is trained.

Pages are composed by seeded chance from the parts that sites are made of: menus, headers, notices, adverts, side
columns, articles with and without semantic tags, forms, reader comments, footers; tidy and broken markup.  Main text
carries data-y="1", which only training reads.  Words are random letters, so nothing is learnt of any language.
"""

from __future__ import annotations

import random

# Class and id names that sites give to their parts, by part.
NAMES = {
    "menu": "nav navbar menu main-menu topnav site-nav navigation breadcrumbs breadcrumb pagination tabs nav-links toc",
    "header": "header site-header masthead top-bar topbar branding logo tagline page-header hero-bar",
    "notice": "notice cookie-notice cookie-banner cookies consent gdpr alert announcement warning message modal popup overlay paywall",
    "advert": "ad ads advert advertisement adsbox sponsored sponsor promo promotion banner ad-slot ad-container teaser",
    "side": "sidebar side aside widget related related-posts popular recommended recommendations trending most-read more-stories see-also right-column",
    "share": "share sharing social social-links share-buttons follow tools toolbar tags",
    "form": "form search search-form login signup subscribe subscription newsletter contact-form survey poll",
    "comments": "comments comment-list comment reader-comments responses replies reply discussion respond disqus thread user-comments",
    "footer": "footer site-footer page-footer copyright legal bottom colophon credits imprint foot",
    "article": "article post content entry entry-content story post-body article-body main-content text body-text page-content article-text blog-post news-text",
}


class Composer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.lexicon = ["".join(self.r.choice("aeiounrtslmdkp") for _ in range(self.r.randint(2, 9))) for _ in range(400)]

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = [self.r.choice(self.lexicon) for _ in range(n)]
        text = ""
        for i, w in enumerate(out):
            first = i == 0 or text.endswith(". ")
            text += (w.capitalize() if first else w) + ("" if i == n - 1 else self.r.choice([" "] * 8 + [", ", ". "]))
        return text

    def prose(self) -> str:
        size = self.r.choice([(1, 4), (5, 20), (20, 60), (60, 160)])
        text = self.words(*size) + "."
        if self.r.random() < 0.2:
            cut = text.split(" ")
            k = self.r.randrange(len(cut))
            cut[k] = self.r.choice([f"<a href='/{k}'>{cut[k]}</a>", f"<b>{cut[k]}</b>", f"<em>{cut[k]}</em>", "&amp;", cut[k] + "<br>"])
            text = " ".join(cut)
        return text

    def name(self, part: str) -> str:
        value = self.r.choice(NAMES[part].split())
        if self.r.random() < 0.2:
            value += " " + self.r.choice(["clearfix", "row", "wide", "box", "block", "inner", "wrapper", "container"])
        return f'{self.r.choice(["class", "class", "id"])}="{value}"'

    def box(self, part: str, tags: str, inner: str) -> str:
        """inner in a tag of its own meaning, or in a plain one that its name tells."""
        own = tags.split()
        tag = self.r.choice(own) if own and self.r.random() < 0.55 else self.r.choice(["div", "div", "section", "p" if "<" not in inner else "div"])
        named = tag not in own or self.r.random() < 0.5
        return f"<{tag}{' ' + self.name(part) if named else ''}>{inner}</{tag}>"

    def menu(self) -> str:
        links = "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.r.randint(3, 9)))
        if self.r.random() < 0.3:
            return self.box("menu", "nav", " | ".join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(5)))
        return self.box("menu", "nav", f"<ul>{links}</ul>")

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<a href='/'>{self.words(1, 3)}</a><p>{self.words(3, 12)}</p>", f"<span>{self.words(1, 4)}</span>", f"<p>{self.words(2, 14)}</p>"])
        return self.box("header", "header", inner + (self.menu() if self.r.random() < 0.3 else ""))

    def plain(self, part: str, tags: str = "") -> str:
        """A part of one to three running texts of any length."""
        inner = "".join(f"<p>{self.prose()}</p>" for _ in range(self.r.randint(1, 3))) if self.r.random() < 0.6 else self.words(2, 30) + self.r.choice(["", "."])
        if self.r.random() < 0.2:
            inner += f"<button>{self.words(1, 2)}</button>"
        return self.box(part, tags, inner)

    def side(self) -> str:
        rows = "".join(f'<li><a href="/{i}">{self.words(3, 9)}</a></li>' for i in range(self.r.randint(2, 6)))
        inner = f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([f"<ul>{rows}</ul>", f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p><ul>{rows}</ul>"])
        return self.box("side", "aside", inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name='q'>" + self.r.choice(["", f"<p>{self.prose()}</p>", f"<select><option>{self.words(1, 2)}</option></select>"]) + f"<button>{self.words(1, 2)}</button>"
        return f"<form action='/s' {self.name('form')}>{inner}</form>" if self.r.random() < 0.7 else self.box("form", "form", f"<form>{inner}</form>")

    def comments(self) -> str:
        one = [self.r.choice([f"<div class='comment'><b>{self.words(1, 2)}</b><p>{self.prose()}</p></div>", f"<li><p>{self.prose()}</p></li>", f"<p>{self.prose()}</p>", f"<article class='comment'><p>{self.prose()}</p></article>"]) for _ in range(self.r.randint(1, 5))]
        inner = f"<h3>{self.words(1, 3)}</h3>" * (self.r.random() < 0.6) + "".join(f"<ol>{x}</ol>" if x.startswith("<li") else x for x in one)
        tag = self.r.choice(["div", "section"])
        return f"<{tag} {self.name('comments')}>{inner}</{tag}>"

    def footer(self) -> str:
        return self.box("footer", "footer", self.r.choice([f"&copy; {self.words(2, 20)}", f"&copy; {self.r.randint(1990, 2030)} {self.words(1, 5)} &middot; {self.words(2, 20)}.", f"<p>{self.prose()}</p>", f"<ul><li><a href='/a'>{self.words(1, 2)}</a></li><li><a href='/b'>{self.words(1, 2)}</a></li></ul>"]))

    def article(self) -> str:
        parts = [f"<{self.r.choice(['h1', 'h1', 'h2'])}>{self.words(3, 14)}</h1>"] if self.r.random() < 0.8 else []
        parts = [p.replace("</h1>", "</h2>") if p.startswith("<h2") else p for p in parts]
        broken = self.r.random() < 0.4
        for _ in range(self.r.randint(1, 12)):
            x = self.r.random()
            if x < 0.75:
                parts.append(f"<p><b>{self.prose()}<br>" if broken and x < 0.1 else f"<p>{self.prose()}" + ("" if broken and x < 0.3 else "</p>"))
            elif x < 0.82:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif x < 0.88:
                parts.append("<ul>" + "".join(f"<li>{self.words(1, 20)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif x < 0.93:
                parts.append(f"<blockquote>{self.r.choice(['<p>%s</p>', '%s']) % self.prose()}</blockquote>")
            elif x < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<pre>{self.words(3, 20)}</pre>")
        parts = [p.replace(">", ' data-y="1">', 1) for p in parts]
        if self.r.random() < 0.35:
            other = self.r.choice([lambda: self.plain("advert"), lambda: self.plain("share"), self.comments, self.form, self.side, lambda: self.plain("notice")])()
            parts.insert(self.r.randint(1, len(parts)), other)
        if self.r.random() < 0.15:
            parts.append(self.comments())
        kind = self.r.random()
        inner = "".join(parts)
        if kind < 0.45:
            return f"<article>{inner}</article>"
        if kind < 0.6:
            return f"<main>{inner}</main>"
        if kind < 0.9:
            return f"<div {self.name('article')}>{inner}</div>"
        return f"<div>{inner}</div>"

    def page(self) -> str:
        def maybe(p: float, f, *a) -> list[str]:
            return [f(*a)] if self.r.random() < p else []

        before = maybe(0.5, self.header) + maybe(0.8, self.menu) + maybe(0.3, self.plain, "notice") + maybe(0.4, self.plain, "advert", "aside") + maybe(0.2, self.form) + maybe(0.25, self.side)
        if self.r.random() < 0.3:
            self.r.shuffle(before)
        after = maybe(0.25, self.plain, "share") + maybe(0.35, self.comments) + maybe(0.35, self.side) + maybe(0.3, self.plain, "advert") + maybe(0.25, self.form) + maybe(0.75, self.footer) + maybe(0.1, self.plain, "notice")
        body = "".join(before) + (self.article() if self.r.random() < 0.97 else "") + "".join(after)
        if self.r.random() < 0.3:
            body = f'<div class="{self.r.choice(["wrapper", "container", "page", "site", "layout"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var t='</p>';</script></head><body>{body}<!-- {self.words(1, 3)} --></body></html>"


def labelled_pages(n: int, seed: int = 4) -> list[str]:
    composer = Composer(seed)
    return [composer.page() for _ in range(n)]
