"""Labelled web pages, made from a seed, for fitting and testing the extractor.

A page is a list of (html, is content) runs in page order; the labels come from the construction.
"""

from __future__ import annotations

import html as entities
import random

#: Names that page authors give to the parts of a page.
CONTENT_NAMES = ("content", "main", "main-content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "story-body", "page-content", "body-text", "text")
NAV_NAMES = ("nav", "navbar", "menu", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip-links")
HEADER_NAMES = ("header", "site-header", "masthead", "top-bar", "topbar", "branding", "logo", "page-header")
FOOTER_NAMES = ("footer", "site-footer", "bottom", "copyright", "colophon", "legal", "credits")
SIDE_NAMES = ("sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "trending", "tags", "author-bio", "share", "social", "share-buttons", "archive-list", "more-stories")
NOTICE_NAMES = ("notice", "cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "banner", "popup", "modal", "newsletter", "subscribe", "signup", "paywall", "disclaimer", "warning", "overlay", "toast")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "ad-slot", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "dfp", "banner-ad", "ad-container")
COMMENT_NAMES = ("comments", "comment", "comment-list", "reader-comments", "replies", "reply", "discussion", "disqus", "respond", "thread", "feedback", "responses")
FORM_NAMES = ("search", "search-form", "login", "login-form", "contact-form", "form", "newsletter-form", "signup-form", "poll")

#: Roles that stand for these parts.
ROLES = {NAV_NAMES: ("navigation",), HEADER_NAMES: ("banner",), FOOTER_NAMES: ("contentinfo",), SIDE_NAMES: ("complementary",), NOTICE_NAMES: ("dialog", "alert"), FORM_NAMES: ("search",), CONTENT_NAMES: ("main", "article")}

Run = tuple[str, bool]


class PageMaker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.longest = 60

    def words(self, least: int, most: int) -> str:
        r, out = self.rng, []
        for k in range(r.randint(least, most)):
            word = "".join(r.choice(("an", "the", "ti", "on", "er", "re", "qu", "ou", "sch", "ei", "ó", "ñ", "be", "lo")) for _ in range(r.randint(1, 4)))
            out.append(word.capitalize() if k == 0 or r.random() < 0.05 else word)
            if r.random() < 0.1:
                out[-1] += r.choice((".", ",", "!", " &", ";"))
        return " ".join(out)

    def sentence(self, least: int = 1, most: int = 40) -> str:
        return self.words(least, most) + self.rng.choice((".", ".", ".", "", "!", "?"))

    def inline(self, text: str) -> str:
        r, shown = self.rng, []
        for word in text.split(" "):
            word = entities.escape(word)
            if r.random() < 0.03:
                tag = r.choice(("b", "i", "em", "strong", "span", "code", "a", "u"))
                word = f'<a href="/{len(word)}">{word}</a>' if tag == "a" else f"<{tag}>{word}</{tag}>"
            shown.append(word)
        return " ".join(shown)

    def attributes(self, names: tuple[str, ...]) -> str:
        r = self.rng
        if names in ROLES and r.random() < 0.15:
            return f' role="{r.choice(ROLES[names])}"'
        name = r.choice(names)
        name += r.choice(("", "", "", "-1", "_wrap", " clearfix", " box col"))
        return f' {r.choice(("class", "class", "id"))}="{name}"' + (' data-x="1"' if r.random() < 0.1 else "")

    def block(self) -> list[Run]:
        r = self.rng
        kind = r.choice(("p",) * 12 + ("h2", "h3", "ul", "ol", "blockquote", "pre", "table", "div", "section", "bare", "loose", "loose", "figure", "dl"))
        text = lambda a=1, b=60: (self.inline(self.sentence(min(a, self.longest), min(b, self.longest))), True)
        if kind in ("p", "div", "blockquote", "pre"):
            return [(f"<{kind}>", True), text(), (f"</{kind}>", True)]
        if kind in ("h2", "h3"):
            return [(f"<{kind}>", True), text(1, 8), (f"</{kind}>", True)]
        if kind in ("ul", "ol"):
            return [(f"<{kind}>", True)] + [x for _ in range(r.randint(1, 6)) for x in (("<li>", True), text(1, 20), ("</li>" * r.randint(0, 1), True))] + [(f"</{kind}>", True)]
        if kind == "table":
            return [("<table>", True)] + [x for _ in range(r.randint(1, 4)) for x in (("<tr><td>", True), text(1, 10), ("</td><td>", True), text(1, 10), ("</td></tr>", True))] + [("</table>", True)]
        if kind == "section":
            return [("<section>", True), ("<h2>", True), text(1, 6), ("</h2><p>", True), text(), ("</p></section>", True)]
        if kind == "figure":
            return [('<figure><img src="x.png"><figcaption>', True), text(1, 15), ("</figcaption></figure>", True)]
        if kind == "dl":
            return [("<dl><dt>", True), text(1, 4), ("</dt><dd>", True), text(1, 20), ("</dd></dl>", True)]
        if kind == "loose":
            return [x for _ in range(r.randint(1, 4)) for x in self.loose(text())]
        return [text(2, 40), ("<p>", True), text(), ("</p>", True)]

    def loose(self, text: Run) -> list[Run]:
        """A block by an author who closes tags at whim: inline ones left open, line breaks anywhere."""
        r = self.rng
        tag, inner = r.choice(("p", "p", "p", "div", "li", "blockquote", "h3")), r.choice(("", "", "b", "i", "em", "strong", "span", "u", "font"))
        head = f"<{tag}>" + (f"<{inner}>" if inner else "")
        tail = r.choice(("", f"</{inner}>")) if inner else ""
        tail += "<br>" * r.choice((0, 0, 1, 2)) + (f"</{tag}>" if r.random() < 0.5 else "")
        return [(head, True), text, (tail, True)]

    def markup(self) -> str:
        """Tags around words, as they stand in scripts, comments and templates, whole or cut off."""
        r = self.rng
        tag = r.choice(("p", "div", "li", "a", "span", "h2", "article", "td", "b"))
        return r.choice((f"<{tag}>{self.words(0, 4)}</{tag}>", f"</{tag}>", f"<{tag}>", f"<{tag} class='x'>{self.words(1, 3)}"))

    def script(self) -> str:
        """A script of a few statements: calls, assignments, comparisons, and markup in quotes."""
        r = self.rng
        name = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(1, 6)))
        quoted = lambda: r.choice(('"{}"', "'{}'", "`{}`")).format(self.markup().replace("'", "") if r.random() < 0.5 else self.words(1, 3))
        lines = [r.choice((f"{name()}({quoted()})", f"var {name()}={quoted()}", f"if({name()}<{r.randint(0, 9)}){{{name()}()}}", f"{name()}.{name()}=[{r.randint(0, 99)},{quoted()}]")) for _ in range(r.randint(1, 5))]
        return ";".join(lines)

    def styles(self) -> str:
        r = self.rng
        rule = lambda: f"{r.choice(('p', 'div', '.box', '#top', 'a:hover', 'ul>li', 'body'))}{{{r.choice(('color', 'width', 'display', 'padding'))}:{r.choice(('red', '1px', 'none', 'auto'))}}}"
        return "".join(rule() for _ in range(r.randint(1, 4)))

    def junk(self, kind: str) -> list[Run]:
        r = self.rng
        off = lambda s: (s, False)
        line = lambda a=1, b=25: off(self.inline(self.sentence(a, b)))
        links = lambda n: [x for _ in range(n) for x in (off(r.choice(('<li><a href="/x">', '<li class="item"><a href="#">'))), off(entities.escape(self.words(1, 3))), off("</a></li>"))]

        def boxed(tag: str, names: tuple[str, ...], inner: list[Run]) -> list[Run]:
            plain = tag not in ("div", "section", "ul", "table", "span") and r.random() < 0.6
            return [off(f"<{tag}{'' if plain else self.attributes(names)}>"), *inner, off(f"</{tag}>")]

        paragraphs = lambda a, b: [x for _ in range(r.randint(a, b)) for x in ((off("<p>"), line(), off("</p>")) if r.random() < 0.7 else (off("<div>"), line(), off("</div>")))]
        def title(most: int) -> list[Run]:
            tag = r.choice(("h2", "h3", "h3", "h4", "p", "div", "span"))
            return [off(f"<{tag}>"), line(1, most), off(f"</{tag}>")]

        if kind == "nav":
            if r.random() < 0.2:  # links without a list
                inner = [x for _ in range(r.randint(2, 8)) for x in (off('<a href="/y">'), off(entities.escape(self.words(1, 3))), off(r.choice(("</a> ", "</a><br>", "</a> | "))))]
                return boxed(r.choice(("nav", "div", "p")), NAV_NAMES, inner)
            tag = r.choice(("nav", "nav", "div", "ul"))
            inner = links(r.randint(2, 10))
            return boxed(tag, NAV_NAMES, inner if tag == "ul" else [off("<ul>"), *inner, off("</ul>")])
        if kind == "header":
            tag = r.choice(("h1", "h2", "p", "div", "span", "a href='/'"))
            return boxed(r.choice(("header", "header", "div")), HEADER_NAMES, [off(f"<{tag}>"), line(1, 8), off(f"</{tag.split()[0]}>"), *(paragraphs(0, 1) if r.random() < 0.5 else [])])
        if kind == "footer":
            inner = [off("&copy; "), line(1, 20)] if r.random() < 0.6 else paragraphs(1, 3)
            return boxed(r.choice(("footer", "footer", "div")), FOOTER_NAMES, inner + (links(r.randint(1, 4)) if r.random() < 0.3 else []))
        if kind == "side":
            inner = [*title(4), off("<ul>"), *links(r.randint(1, 6)), off("</ul>")] if r.random() < 0.5 else paragraphs(1, 3)
            return boxed(r.choice(("aside", "aside", "div", "section")), SIDE_NAMES, inner)
        if kind == "notice":
            return boxed(r.choice(("div", "div", "section", "aside")), NOTICE_NAMES, [line()] if r.random() < 0.5 else paragraphs(1, 2) + [off("<button>"), line(1, 2), off("</button>")])
        if kind == "ad":
            return boxed(r.choice(("div", "div", "div", "section", "aside")), AD_NAMES, [line()] if r.random() < 0.6 else paragraphs(1, 2))
        if kind == "comments":
            inner = [x for _ in range(r.randint(1, 4)) for x in (off(f'<{r.choice(("li", "li", "div", "div", "article"))} class="{r.choice(COMMENT_NAMES)}">'), line(), off("<p>"), line(), off("</p></div></article>"))]
            return boxed(r.choice(("section", "div", "div", "ol")), COMMENT_NAMES, [*title(3), *inner])
        if kind == "hidden":
            return [off(r.choice(("<p hidden>", '<p style="display:none">', '<div aria-hidden="true">', '<div class="hidden">'))), line(), off("</p></div>")]
        if kind == "form":
            inner = [off("<label>"), line(1, 3), off('</label><input name="q"><select><option>'), line(1, 2), off("</option></select><button>"), line(1, 2), off("</button>")]
            return boxed("form", FORM_NAMES, ([off("<p>"), line(1, 12), off("</p>")] if r.random() < 0.5 else []) + inner)
        kinds = {
            "script": lambda: f"<script{r.choice(('', ' async', ' type=module'))}>{self.script()}</script>", "style": lambda: f"<style>{self.styles()}</style>",
            "noscript": lambda: f"<noscript>{self.markup()}</noscript>", "comment": lambda: f"<!--{self.markup()} {self.words(0, 5)}-->",
            "iframe": lambda: f'<iframe src="{self.words(1, 1)}"></iframe>', "template": lambda: f"<template>{self.markup()}</template>",
        }
        return [off(kinds[r.choice(("script", "script", "style", "noscript", "comment", "comment", "iframe", "template"))]())]

    def _inside(self) -> list[Run]:
        """The article: a heading, blocks, and junk among them."""
        r = self.rng
        heading: list[Run] = [(f"<h{r.choice((1, 1, 1, 2))}>", True), (self.inline(self.words(1, 10)), True), ("</h1></h2>", True)] if r.random() < 0.8 else []
        if heading and r.random() < 0.1:
            heading = [("<header>", True), *heading, ("</header>", True)]
        out = heading
        blocks = r.choice((1, 1, 2, 2, 3, 4, 6, 9, 14, 40, 90))
        self.longest = 3 if r.random() < 0.2 else 60
        for _ in range(blocks):
            if r.random() < min(0.25, 1.5 / blocks):
                out += self.junk(r.choice(("ad", "ad", "notice", "side", "side", "form", "code", "nav", "hidden")))
            out += self.block()
        if r.random() < 0.15:
            out += self.junk(r.choice(("comments", "footer", "side", "form")))
        return out

    def _some(self, chances: dict[str, float]) -> list[str]:
        return [k for k, p in chances.items() if self.rng.random() < p]

    def runs(self) -> list[Run]:
        """The runs of one page."""
        r = self.rng
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td", "body", "bare"))
        named = tag in ("div", "section", "td") or (tag in ("article", "main") and r.random() < 0.3)
        opened, closed = f"<{tag}{self.attributes(CONTENT_NAMES) if named else ''}>", f"</{tag}>"
        if tag == "td":
            beside = [(f"<td{self.attributes(r.choice((NAV_NAMES, SIDE_NAMES)))}>", False), *self.junk(r.choice(("nav", "nav", "side"))), ("</td>", False)] if r.random() < 0.6 else []
            table, closed = [("<table><tr>", True), *beside, (opened, True)], "</td></tr></table>"
        if tag == "article" and r.random() < 0.3:
            opened, closed = f"<main>{opened}", f"{closed}</main>"
        if tag == "bare":
            opened, closed = "<div>", "</div>"
        before = self._some({"header": 0.35, "nav": 0.7, "code": 0.3, "notice": 0.25, "ad": 0.5, "side": 0.15, "form": 0.15})
        after = self._some({"side": 0.3, "ad": 0.2, "comments": 0.3, "form": 0.15, "nav": 0.1, "notice": 0.15, "code": 0.2, "footer": 0.8})
        r.shuffle(before)
        head = "".join(x for x in (f"<title>{self.words(1, 6)}</title>", f"<style>{self.styles()}</style>", f"<script>{self.script()}</script>", '<meta charset="utf-8">') if r.random() < 0.6)
        out: list[Run] = [(f"{r.choice(('<!DOCTYPE html>', '<!doctype html>', ''))}<html><head>{head}</head>", False), ("<body>", tag == "body")]
        wrapped = tag != "body" and r.random() < 0.3
        out += [(r.choice(('<div id="wrapper" class="page container">', '<div class="container"><div class="row">', '<div id="page">')), False)] if wrapped else []
        for k in before:
            out += self.junk(k)
        inside = self._inside()
        out += inside if tag == "body" else [*(table if tag == "td" else [(opened, True)]), *inside, (closed, True)]
        for k in after:
            out += self.junk(k)
        out += [("</div>", False)] if wrapped else []
        return out + ([("</body></html>", False)] if r.random() < 0.9 else [])
