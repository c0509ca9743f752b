"""Labelled pages: articles named by their markup, and the same texts in other layouts."""

from __future__ import annotations

import html as entities
import random
from collections.abc import Callable

from .dom import HINT, TAG, TAGS, Tree, parse

_APART = {TAG[t] for t in ("nav", "aside", "footer", "form")}
_ASIDE = sum(1 << HINT.index(h) for h in ("ad", "comment", "share", "related", "notice", "menu"))
_COMMENT = 1 << HINT.index("comment")
_OWN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd figcaption".split())


def named_article(tree: Tree) -> Tree | None:
    """``tree`` with labels, if its markup names one article: its texts are content, but for
    parts that are named as something else."""
    inside: list[int] = []  # 0: outside, 1: in an article, 2: in a part of it set apart
    articles = 0
    for at, up in enumerate(tree.parent):
        above = inside[up] if up >= 0 else 0
        if above == 0 and tree.tag[at] == TAG["article"] and not tree.hints[at] & _COMMENT:
            articles += 1
            above = 1
        elif above == 1 and (tree.tag[at] in _APART or tree.hints[at] & _ASIDE):
            above = 2
        inside.append(above)
    if articles != 1 or not any(i == 1 and t for i, t in zip(inside, tree.texts)):
        return None
    tree.label = [int(i == 1) for i in inside]
    return tree


def laid_out(tree: Tree, rng: random.Random) -> str:
    """The texts of a labelled tree as a page of another layout, labelled in ``data-label``."""
    content, other = [], []
    for label, said, up in zip(tree.label, tree.texts, tree.parent):
        if said and label == 1:
            name = TAGS[tree.tag[up]]
            content.append((name if name in _OWN else "p", said))
        elif said:
            other.append(said)
    return _Layout(content, " ".join([*(t for _, t in content), *other]).split(), rng).page()


def invented_page(rng: random.Random) -> Tree:
    """A labelled page of invented words."""
    words = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    layout = _Layout([], words, rng)
    layout.content = [("h1", layout.words(5)), *(("p", layout.prose(rng.randint(1, 6))) for _ in range(rng.randint(2, 12)))]
    return parse(layout.page())


class _Layout:
    def __init__(self, content: list[tuple[str, str]], words: list[str], rng: random.Random) -> None:
        self.content, self.rng, self.vocabulary = content, rng, words or ["word"]

    # -- texts ------------------------------------------------------------------

    def words(self, n: int) -> str:
        return " ".join(self.rng.choice(self.vocabulary) for _ in range(max(1, n)))

    def prose(self, sentences: int) -> str:
        some = (self.words(self.rng.randint(4, 18)).rstrip(".,:;").capitalize() for _ in range(sentences))
        return ". ".join(some) + "."

    def links(self, n: int, size: int = 2) -> list[str]:
        return [f'<a href="/{i}">{entities.escape(self.words(self.rng.randint(1, size)))}</a>' for i in range(n)]

    # -- elements ---------------------------------------------------------------

    def named(self, choices: str, bare: float, inner: str, label: int = 0) -> str:
        """``inner`` in one of the elements of ``choices`` (tag.class or tag#id), or without a
        name in a share ``bare`` of the cases."""
        tag, mark, name = self._split(self.rng.choice(choices.split()))
        if mark == "." and self.rng.random() < 0.3:
            name += " " + self.rng.choice(["x1", "clearfix", "col-md-8", "inner", "box", "wrap"])
        attribute = {"": "", ".": f' class="{name}"', "#": f' id="{name}"', "@": f' role="{name}"'}[mark]
        if self.rng.random() < bare:
            tag, attribute = "div" if tag in ("nav", "header", "footer", "aside") else tag, ""
        return f'<{tag}{attribute} data-label="{label}">{inner}</{tag}>'

    @staticmethod
    def _split(choice: str) -> tuple[str, str, str]:
        for mark in ".#@":
            if mark in choice:
                tag, name = choice.split(mark)
                return tag, mark, name
        return choice, "", ""

    def listed(self, items: list[str]) -> str:
        if self.rng.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.rng.choice([" ", " | ", " &middot; "]).join(items)

    def menu(self) -> str:
        inner = self.listed(self.links(self.rng.randint(3, 12)))
        return self.named("nav nav nav.menu div.nav ul.menu div#navigation div.topnav div.breadcrumbs div@navigation", 0.25, inner)

    def header(self) -> str:
        inner = f"<{(h := self.rng.choice(['h1', 'h2', 'p', 'div']))}>{self.words(2)}</{h}>"
        inner += f"<p>{self.words(self.rng.randint(3, 8))}</p>" if self.rng.random() < 0.5 else self.listed(self.links(3))
        return self.named("header header div.header div#masthead div.site-header div@banner div.topbar", 0.15, inner)

    def footer(self) -> str:
        said = self.rng.choice(["&copy; ", "", "Copyright "]) + self.words(self.rng.randint(2, 5))
        said += self.rng.choice([" &middot; ", " | ", ". "]) + self.prose(self.rng.randint(1, 2))
        if self.rng.random() < 0.4:
            said = f"<p>{said}</p>" + self.listed(self.links(4))
        return self.named("footer footer footer div.footer div#footer div.copyright div@contentinfo", 0.1, said)

    def side(self) -> str:
        inner = f"<h3>{self.words(2)}</h3>"
        for _ in range(self.rng.randint(1, 4)):
            inner += self.rng.choice([f"<p>{self.prose(2)}</p>", self.listed(self.links(4, 6))])
        return self.named("aside aside div.sidebar div#sidebar div.widget section.sidebar div.right-column div@complementary", 0.05, inner)

    def advert(self) -> str:
        said = self.prose(self.rng.randint(1, 3))
        said = self.rng.choice([said, f"<p>{said}</p>", f"<div>{said}</div>", f'<a href="/x">{said}</a>'])
        return self.named("div.ad div.ad div.ads div.advert ins.adsbygoogle div.sponsored aside.promo p.advertisement div.ad-banner", 0, said)

    def notice(self) -> str:
        inner = f"<p>{self.prose(self.rng.randint(1, 3))}</p><button>{self.words(1)}</button>"
        return self.named("div.cookie-notice div@alert div#consent section.newsletter div.popup div.notice div@dialog", 0, inner)

    def form(self) -> str:
        inner = f"<label>{self.words(2)}</label><input name=q><p>{self.prose(1)}</p><button>{self.words(1)}</button>"
        return self.named("form form.search form#login form.subscribe", 0, inner)

    def comments(self) -> str:
        one = self.rng.choice(["div.comment", "li.comment", "article.comment", "div.reply"])
        inner = f"<h3>{self.words(2)}</h3>"
        for _ in range(self.rng.randint(1, 5)):
            inner += self.named(one, 0, f"<p>{self.words(2)}</p><p>{self.prose(self.rng.randint(1, 4))}</p>")
        return self.named("section#comments div.comments div#disqus_thread ol.commentlist section.responses div.reader-comments", 0, inner)

    def share(self) -> str:
        return self.named("div.share ul.social div.share-buttons div.sharing", 0.3, self.listed(self.links(4)))

    def related(self) -> str:
        inner = f"<h3>{self.words(2)}</h3>" + self.listed(self.links(self.rng.randint(3, 6), 8))
        if self.rng.random() < 0.3:
            inner += f"<p>{self.prose(1)}</p>"
        return self.named("div.related section.related-posts div.recommended aside.more div.read-next", 0.1, inner)

    # -- the page ---------------------------------------------------------------

    def article(self, inside: list[str]) -> str:
        out = []
        # Some articles are short, or written without marks, in short lines, or as one long run.
        odd, few, brief, long = (self.rng.random() < share for share in (0.15, 0.15, 0.15, 0.05))
        content = self.content[: self.rng.randint(1, 3)] if few else self.content
        if brief:
            content = [(t, " ".join(said.split()[: self.rng.randint(1, 5)])) for t, said in content * self.rng.randint(1, 4)]
        if long:
            content = [("p", " ".join(said for _, said in content * 9))]
        for i, (tag, said) in enumerate(content):
            if odd:
                said = "".join(c for c in said if c.isalnum() or c == " ") or said
            said = entities.escape(said, quote=False)
            if self.rng.random() < 0.1:
                said = f'<a href="/y">{said}</a>' if len(said) < 30 else said.replace(" ", f" {self.links(1)[0]} ", 1)
            if tag == "p" and self.rng.random() < 0.15:
                tag = self.rng.choice(["li", "blockquote", "td", "pre", "div", "figcaption", "dd"])
            around = {"li": "ul", "td": "table", "figcaption": "figure", "dd": "dl"}.get(tag)
            said = f"<{tag}>{said}</{tag}>"
            out.append(f"<{around}>{said}</{around}>" if around else said)
            if i and self.rng.random() < 0.1:
                out.append(f"<h2>{self.words(self.rng.randint(1, 6))}</h2><p>{self.words(self.rng.randint(1, 3))}</p>")
        for extra in inside:
            out.insert(self.rng.randint(1, len(out)), extra)
        if self.rng.random() < 0.2 and out[0].startswith("<h1>"):
            out[0] = f"<header>{out[0]}</header>"
        containers = (
            "article article article.post main main#content div#content div.post-body div.entry-content section.article "
            "div.article-text section div div td div.story div.main-content div@main"
        )
        inner = self.named(containers, 0.1, "".join(out), 1)
        if inner.startswith("<td"):
            inner = f"<table><tr>{inner}</tr></table>"
        for _ in range(self.rng.randint(0, 2)):
            inner = self.named("div#wrapper div.container main div.page section div.row", 0.3, inner, -1).replace(' data-label="-1"', "")
        return inner

    def some(self, makers: list[Callable[[], str]], share: float) -> list[str]:
        out = [make() for make in makers if self.rng.random() < share]
        self.rng.shuffle(out)
        return out

    def page(self) -> str:
        before = self.some([self.header, self.menu, self.menu, self.notice, self.advert, self.form, self.side], 0.5)
        inside = self.some([self.advert, self.share, self.related, self.form, self.notice, self.side], 0.15)
        after = self.some([self.share, self.related, self.comments, self.side, self.advert, self.notice, self.form, self.footer], 0.5)
        return f'<html><body data-label="0">{"".join(before)}{self.article(inside)}{"".join(after)}</body></html>'
