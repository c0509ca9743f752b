"""Pages as trees of block elements with runs of text as leaves.

Inline elements belong to the text around them, and only links are remembered, by how much of a
text they hold. Elements that never show text of their own (scripts, styles, fields of forms) are
passed over. Missing end tags are supplied as browsers do: a new block ends a paragraph, a list
item the one before it, and the end of an element all that is open inside it. An unclosed script,
style or comment reaches to the end of the page.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

# Kinds of elements, as HTML names them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font head html i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var".split()
)
UNSEEN = frozenset(
    "script style title textarea iframe noscript template svg select button object canvas audio video datalist".split()
)
ENDLESS = frozenset(["script", "style"])
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = frozenset("ul ol dl table menu body".split())

# Tags told apart by the model; any other is "other".
TAGS = (
    "text page other body main article section div p h1 h2 h3 h4 h5 h6 ul ol menu li dl dt dd table thead tbody tr td "
    "th blockquote pre figure figcaption header footer nav aside form fieldset address details summary center"
).split()
TAG = {name: i for i, name in enumerate(TAGS)}

# Words in class, id, role and itemprop, by what they say of an element.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs skip topnav subnav links",
    "head": "header head masthead topbar logo site brand branding banner title tagline toolbar",
    "foot": "footer foot bottom copyright legal colophon contentinfo imprint",
    "side": "sidebar side aside widget widgets rail column secondary complementary",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense adslot "
    "commercial outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay newsletter subscribe subscription signup "
    "paywall dialog message notification announcement disclaimer",
    "form": "form search searchbox login signin register contact field input",
    "comment": "comment comments commentlist disqus respond reply replies discussion reviews review feedback responses",
    "share": "share sharing social addthis follow facebook twitter like buttons tools print email",
    "related": "related recommended recommendations more popular trending latest recent also next previous tags tag cloud archive "
    "category categories teaser teasers",
    "content": "content article articlebody post entry story text body main page blog hentry prose copy maincontent bodytext "
    "paragraph single detail",
}
HINT = list(HINTS) + ["hidden"]
_WORDS: dict[str, int] = {}
for _bit, (_, _words) in enumerate(HINTS.items()):
    for _word in _words.split():
        _WORDS[_word] = _WORDS.get(_word, 0) | 1 << _bit

_TOKEN = re.compile(r"""<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_HIDDEN = re.compile(r"""(?i)(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""")
_LABEL = re.compile(r'data-label="([01])"')
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SENTENCE_END = (".", "!", "?", "…", "。", "！", "？", ":", ";", '"', "”", "»", ")")
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？]")
_SIGNS = ("©", "|", "·", "»", "›", "•", "→")


@dataclass
class Tree:
    """Nodes in page order; ``parent`` of the first is -1. Figures of texts are 0 for elements."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    hints: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    points: list[int] = field(default_factory=list)
    flags: list[int] = field(default_factory=list)  # 1: ends like a sentence, 2: holds a sign
    label: list[int] = field(default_factory=list)  # 1, 0, or -1 where not said
    texts: list[str | None] = field(default_factory=list)

    def add(self, parent: int, tag: int, hints: int, label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.hints.append(hints)
        self.label.append(label)
        self.texts.append(None)
        for figures in (self.chars, self.words, self.linked, self.points, self.flags):
            figures.append(0)
        return len(self.parent) - 1


_known_hints: dict[str, int] = {}


def hints_of(attributes: str) -> int:
    """What the names in a start tag say, as bits."""
    found = _known_hints.get(attributes)
    if found is None:
        found = 0
        for _, *values in _ATTRIBUTE.findall(attributes):
            for word in re.split(r"[^a-z0-9]+", _CAMEL.sub(" ", "".join(values)).lower()):
                found |= _WORDS.get(word, 0)
        if _HIDDEN.search(_ATTRIBUTE.sub("", attributes)):
            found |= 1 << (len(HINT) - 1)
        if len(_known_hints) >= 50_000:
            _known_hints.clear()
        if len(attributes) < 500:
            _known_hints[attributes] = found
    return found


def parse(page: str) -> Tree:
    tree = Tree()
    tree.add(-1, TAG["page"], 0, -1)
    stack = [(0, "")]  # node and name of the open elements
    parts: list[str] = []
    linked = 0
    link: int | None = None  # how many elements were open where the open link began

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if link is not None:
                linked += len(raw)

    def finish() -> None:
        """The run of text so far is a leaf."""
        nonlocal linked
        if parts:
            raw = "".join(parts)
            said = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if said:
                up = stack[-1][0]
                at = tree.add(up, 0, 0, tree.label[up])
                tree.texts[at] = said
                tree.chars[at] = len(said)
                tree.words[at] = said.count(" ") + 1
                tree.linked[at] = min(len(said), round(linked * len(said) / len(raw)))
                tree.points[at] = len(_PUNCTUATION.findall(said))
                tree.flags[at] = said.endswith(_SENTENCE_END) + 2 * any(s in said for s in _SIGNS)
            parts.clear()
        linked = 0

    def close_to(level: int) -> None:
        nonlocal link
        finish()
        del stack[level:]
        if link is not None and link > len(stack):
            link = None

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at, name = m.end(), m.group(2)
        if name is None:
            end = page.find("-->" if m.group() == "<!--" else ">", at)
            at = len(page) if end < 0 else page.index(">", end) + 1
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                link = None
            elif name not in INLINE:
                for level in range(len(stack) - 1, 0, -1):
                    if stack[level][1] == name:
                        close_to(level)
                        break
            continue
        if name in UNSEEN:
            if not m.group(3).endswith("/"):
                end = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page) if name in ENDLESS else at
            text(" ")
            continue
        if name in VOID:
            if name == "hr":
                finish()
            text(" ")
            continue
        if name in INLINE:
            if name == "a":
                link = len(stack)
            continue
        if name in ENDS_PARAGRAPH and stack[-1][1] == "p":
            close_to(len(stack) - 1)
        if name in SIBLINGS:
            for level in range(len(stack) - 1, 0, -1):
                if stack[level][1] in SCOPES:
                    break
                if stack[level][1] in SIBLINGS[name]:
                    close_to(level)
        if name == "body":  # a second one adds nothing
            continue
        finish()
        attributes = m.group(3)
        said = _LABEL.search(attributes) if "data-label" in attributes else None
        up = stack[-1][0]
        label = int(said.group(1)) if said else tree.label[up]
        node = tree.add(up, TAG.get(name, TAG["other"]), hints_of(attributes) if attributes else 0, label)
        stack.append((node, name))
    text(page[at:])
    finish()
    return tree
