"""A small DOM for text extraction: forgiving parsing, blocks of text, and node features."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

# Element kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "head", "title", "template", "noscript", "iframe", "svg", "canvas", "object", "select", "option", "textarea", "button", "datalist"}
#: Silent elements that hold text alone: only their own end tag ends them.
RAW = {"script", "style", "title", "textarea"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input", "nobr",
}
#: Elements whose open sibling a new one closes.
CLOSES_ITSELF = {"li", "dt", "dd", "tr", "td", "th", "option", "p"}
SCOPES = {"article", "aside", "blockquote", "body", "div", "dl", "fieldset", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "ul"}
# Words of class, id and role attributes, by what they speak for.
TOKENS = {
    "content": {"article", "content", "post", "entry", "main", "story", "body", "text", "prose", "page", "single"},
    "menu": {"nav", "navigation", "menu", "navbar", "breadcrumb", "breadcrumbs", "toolbar", "tabs", "toc", "skip", "pagination", "pager"},
    "frame": {"header", "footer", "masthead", "banner", "foot", "copyright", "contentinfo", "bottom", "top", "colophon", "site", "legal"},
    "side": {"sidebar", "side", "aside", "related", "widget", "widgets", "rail", "recommended", "trending", "popular", "complementary", "more", "teaser"},
    "advert": {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "adslot", "offer", "affiliate"},
    "notice": {"notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "warning", "message", "toast", "dialog"},
    "comment": {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "reader", "readers", "feedback", "thread", "review", "reviews"},
    "form": {"form", "search", "login", "signup", "signin", "register", "contact", "input"},
    "social": {"share", "sharing", "social", "follow", "tags", "tag", "meta", "byline", "author", "date"},
}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "dl", "body", "#text"]
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?;:](?=\s|$)")


class Node:
    """An element that isn't inline, or a block of text (tag ``#text``)."""

    __slots__ = ("tag", "tokens", "parent", "children", "parts", "link_chars", "n_inline", "text", "index")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[str] = frozenset()):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.link_chars = self.n_inline = 0
        self.text = ""
        if parent is not None:
            parent.children.append(self)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("body", None)
        self.open: list[tuple[str, Node]] = [("body", self.root)]  # inline elements stay with their block
        self.silent = 0
        self.silent_tag = ""
        self.inside: list[str] = []  # blocks open inside a silent element
        self.links = 0

    def parse_marked_section(self, i, report=1):
        """A section of no known kind is a comment up to the next '>', as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag not in VOID and tag not in INLINE:
                self.silent += tag == self.silent_tag
                self.inside.append(tag)
            return
        if tag in SILENT:
            # A head that is never closed must not swallow the page.
            if tag != "head":
                self.silent, self.silent_tag, self.inside = 1, tag, []
            return
        block = self.open[-1][1]
        if tag in INLINE:
            block_text(block).n_inline += 1
            if tag in VOID:
                if tag == "br":
                    block_text(block).parts.append(" ")
                return
            self.open.append((tag, block))
            self.links += tag == "a"
            return
        if tag in ("html", "body"):
            return
        self._close_for(tag)
        if tag in VOID:
            return
        parent = self.open[-1][1]
        tokens = frozenset(t for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for t in _SPLIT.split(v.lower()) if t)
        self.open.append((tag, Node(tag, parent, tokens)))

    def _close_for(self, tag: str) -> None:
        """A new block ends an open paragraph, and an item ends the item before it."""
        ends = {"p", tag} if tag in CLOSES_ITSELF else {"p"}
        if tag in ("td", "th", "tr"):
            ends |= {"td", "th"}
        if tag in ("dt", "dd"):
            ends |= {"dt", "dd"}
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name in ends:
                self._pop_to(i)
                return
            if name in SCOPES or name in ("td", "th"):
                return
        return

    def _pop_to(self, i: int) -> None:
        self.links -= sum(name == "a" for name, _ in self.open[i:])
        del self.open[i:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not (tag in SILENT and not self.silent):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.silent and (tag in self.inside or tag == self.silent_tag or tag in INLINE or self.silent_tag in RAW):
            if tag in self.inside:
                at = len(self.inside) - 1 - self.inside[::-1].index(tag)
                self.silent -= self.inside[at:].count(self.silent_tag)
                del self.inside[at:]
            elif tag == self.silent_tag:
                self.silent = 0
            return
        if self.silent:
            # The end of a block around it ends an element that was never closed.
            if all(name != tag for name, _ in self.open[1:]):
                return
            self.silent = 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._pop_to(i)
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return

    def handle_data(self, data):
        if self.silent:
            return
        node = self.open[-1][1]
        if data.isspace() and not (node.children and node.children[-1].tag == "#text"):
            return
        t = block_text(node)
        t.parts.append(data)
        if self.links:
            t.link_chars += len(data)


def block_text(node: Node) -> Node:
    """The block of text that is open at the end of ``node``."""
    if not node.children or node.children[-1].tag != "#text":
        Node("#text", node)
    return node.children[-1]


def parse(html: str | None) -> list[Node]:
    """The nodes of a page in page order, the body first; blocks of text are trimmed and blocks without text dropped."""
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except AssertionError:  # the parser's own answer to some broken declarations: what was read so far stands
        pass
    out: list[Node] = []
    stack = [b.root]
    while stack:
        n = stack.pop()
        if n.tag == "#text":
            n.text = _SPACE.sub(" ", "".join(n.parts)).strip()
            n.parts = []
            if not n.text:
                continue
        n.index = len(out)
        out.append(n)
        stack.extend(reversed(n.children))
    for n in out:
        n.children = [c for c in n.children if c.tag != "#text" or c.text]
    return out


FEATURES = (
    ["depth", "from_top", "from_end", "log_chars", "page_share", "parent_share", "link_share", "inline_density", "block_density", "sentences", "mean_block", "max_block", "n_text_children", "n_children"]
    + ["sibling_place", "n_siblings", "log_before", "log_after", "same_tag_siblings", "log_words", "ends_as_sentence"]
    + [f"tag_{t}" for t in TAGS]
    + [f"token_{t}" for t in TOKENS]
    + [f"above_{t}" for t in TOKENS]
    + ["above_nav", "above_aside", "above_header", "above_footer", "above_form", "above_article", "above_list", "any_token"]
)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_KINDS = list(TOKENS)
_KINDS_OF = {w: [i for i, k in enumerate(_KINDS) if w in TOKENS[k]] for k in TOKENS for w in TOKENS[k]}
_ABOVE = {"nav": 0, "aside": 1, "header": 2, "footer": 3, "form": 4, "article": 5, "main": 5, "ul": 6, "ol": 6}


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row for each node of a page: subtree density, attribute words, depth, and how it stands among its siblings."""
    n = len(nodes)
    chars, links, inline, blocks, leaves, longest, sentences = (np.zeros(n) for _ in range(7))
    depth = np.zeros(n)
    for i, x in enumerate(nodes):
        if x.parent is not None:
            depth[i] = depth[x.parent.index] + 1
        if x.tag == "#text":
            chars[i] = longest[i] = len(x.text)
            links[i] = min(x.link_chars, len(x.text))
            inline[i] = x.n_inline
            leaves[i] = 1
            sentences[i] = len(_SENTENCE.findall(x.text))
        else:
            blocks[i] = 1
    start = np.r_[0.0, np.cumsum(chars)[:-1]] if n else chars
    total = max(1.0, chars.sum())
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        for a in (chars, links, inline, blocks, leaves, sentences):
            a[p] += a[i]
        longest[p] = max(longest[p], longest[i])
    f = np.zeros((n, len(FEATURES)), dtype=np.float32)
    base, tok, above, names = 21, 21 + len(TAGS), 21 + len(TAGS) + len(_KINDS), 21 + len(TAGS) + 2 * len(_KINDS)
    place, of = np.zeros(n), np.ones(n)
    before, after, same = np.zeros(n), np.zeros(n), np.zeros(n)
    for x in nodes:
        k = [c.index for c in x.children]
        if k:
            same_tags: dict[str, int] = {}
            for c in x.children:
                same_tags[c.tag] = same_tags.get(c.tag, 0) + 1
            for at, i in enumerate(k):
                place[i], of[i] = at, len(k)
                before[i] = chars[k[at - 1]] if at else 0
                after[i] = chars[k[at + 1]] if at + 1 < len(k) else 0
                same[i] = same_tags[nodes[i].tag]
    f[:, 0] = depth
    f[:, 1] = start / total
    f[:, 2] = 1 - np.minimum(1.0, (start + chars) / total)
    f[:, 3] = np.log1p(chars)
    f[:, 4] = chars / total
    f[:, 6] = links / np.maximum(1, chars)
    f[:, 7] = inline / np.maximum(1, chars) * 100
    f[:, 8] = blocks / np.maximum(1, chars) * 100
    f[:, 9] = sentences / np.maximum(1, chars) * 100
    f[:, 10] = np.log1p(chars / np.maximum(1, leaves))
    f[:, 11] = np.log1p(longest)
    f[:, 12] = leaves
    f[:, 14] = place / np.maximum(1, of - 1)
    f[:, 15] = of
    f[:, 16] = np.log1p(before)
    f[:, 17] = np.log1p(after)
    f[:, 18] = same
    for i, x in enumerate(nodes):
        p = x.parent
        f[i, 5] = chars[i] / max(1.0, chars[p.index]) if p is not None else 1
        f[i, 13] = len(x.children)
        if x.text:
            f[i, 19] = np.log1p(x.text.count(" ") + 1)
            f[i, 20] = x.text[-1] in ".!?:;\"'”’)"
        if x.tag in _TAG_AT:
            f[i, base + _TAG_AT[x.tag]] = 1
        for t in x.tokens:
            for k in _KINDS_OF.get(t, ()):
                f[i, tok + k] = 1
        if p is not None:
            q = p.index
            f[i, above : above + len(_KINDS)] = np.maximum(f[q, above : above + len(_KINDS)], f[q, tok : tok + len(_KINDS)])
            f[i, names : names + 7] = f[q, names : names + 7]
            if p.tag in _ABOVE:
                f[i, names + _ABOVE[p.tag]] = 1
        f[i, names + 7] = bool(x.tokens)
    return f
