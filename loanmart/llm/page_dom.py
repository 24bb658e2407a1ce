"""Elements and text blocks of one HTML page, read in one pass.

A small reader of tags: it closes elements whose end tags may be left out, passes over scripts, styles and comments, and
takes any text.  Inline elements without attributes belong to the block around them.  An element's ``node`` is a hash
of its path, tags with class, id and role (long numbers count as one), so that pages of a site agree on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

MOST_DEPTH = 64  # elements further down count as part of the one at this depth

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</[^>]*>", re.S
)
_BEGUN = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d{3,}")  # numbers of items, not of columns

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math canvas audio video object select".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_IN_HEAD = frozenset("title meta link style script base noscript template head html".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
_NO_BREAK = frozenset(("td", "th"))  # the cells of a row are one block

# fixed values: what markup says about an element's part in a page
_NOISE_TAGS = frozenset("head nav aside footer form button dialog menu fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu
    breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter
    subscribe subscription signup login share sharing social comment comments disqus respond reply replies related recommended
    recommendations widget toolbar footer header masthead topbar copyright""".split()
)
_ARTICLE_NOISE = frozenset("comment comments reply replies ad ads advert promo sponsored related".split())
_CONTENT_WORDS = frozenset("article post entry content story".split())
_STATES = ("has", "with", "no", "is", "without")
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption hr center".split())

NORMAL, NOISE, ARTICLE, MAIN = range(4)


def _words(value: str) -> set[str]:
    out: set[str] = set()
    for name in value.split():
        parts = [w.lower() for w in _WORD.findall(name)]
        if parts and parts[0] not in _STATES:
            if "header" in parts and not _CONTENT_WORDS.isdisjoint(parts):
                parts = [p for p in parts if p != "header"]
            out.update(parts)
    return out


def _judged(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(signature, part, whether markup alone settles the part) of an element."""
    found = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'"))
    names, role = f"{found.get('class', '')} {found.get('id', '')}".strip(), found.get("role", "").lower()
    signature = tag
    if names or role:
        signature = f"{tag} {_DIGITS.sub('0', ' '.join(sorted(names.split())))} {role}"
    if tag in ("html", "body"):
        return signature, NORMAL, True
    if tag in ("article", "main") or role in ("article", "main"):
        if not _ARTICLE_NOISE.isdisjoint(_words(names)):
            return signature, NOISE, True
        return signature, ARTICLE if "article" in (tag, role) else MAIN, True
    if tag in _NOISE_TAGS and tag != "form" or role in _NOISE_ROLES or "hidden" in found:
        return signature, NOISE, True
    if tag in ("form", "header") or not _NOISE_WORDS.isdisjoint(_words(names)):
        return signature, NOISE, False
    return signature, NORMAL, True


@dataclass
class Page:
    """Elements by number, parents first; the last two lists go by block."""

    parent: list[int] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    part: list[int] = field(default_factory=list)
    settled: list[bool] = field(default_factory=list)
    plain: list[bool] = field(default_factory=list)
    block_of: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def open(self, parent: int, tag: str, attributes: str, known: dict) -> int:
        key = (tag, attributes)
        judged = known.get(key)
        if judged is None:
            judged = known[key] = _judged(tag, attributes)
        signature, part, settled = judged
        above = self.node[parent] if parent >= 0 else 0
        node = known.get((above, signature))
        if node is None:
            node = known[above, signature] = xxhash.xxh3_64_intdigest(f"{above}/{signature}") - (1 << 63)
        self.parent.append(parent)
        self.node.append(node)
        self.tag.append(tag)
        self.part.append(part)
        self.settled.append(settled)
        self.plain.append(tag in _PLAIN and signature == tag)
        return len(self.parent) - 1

    def finish(self) -> None:
        """Set ``noise``, ``inside`` (the article, if it is marked, else all but noise) and ``exempt`` (never pruned)."""
        n = len(self.parent)
        # an element that only looks like noise is none if it holds an article
        holds = [False] * n
        for i in range(n - 1, -1, -1):
            if (self.part[i] in (ARTICLE, MAIN) or holds[i]) and self.parent[i] >= 0 and not (self.part[i] == NOISE and self.settled[i]):
                holds[self.parent[i]] = True
        noise, article, main = [False] * n, [False] * n, [False] * n
        for i in range(n):
            p = self.parent[i]
            up = p >= 0
            own = self.part[i] == NOISE and (self.settled[i] or not holds[i])
            if own and self.tag[i] == "header" and up and (article[p] or main[p]):
                own = False
            noise[i] = (up and noise[p]) or own
            article[i] = not noise[i] and ((up and article[p]) or self.part[i] == ARTICLE)
            main[i] = not noise[i] and ((up and main[p]) or self.part[i] == MAIN)
        sizes = [0, 0, 0]
        for i, text in zip(self.block_of, self.texts):
            if not noise[i]:
                sizes[0] += len(text)
                sizes[1] += len(text) if article[i] else 0
                sizes[2] += len(text) if main[i] else 0
        articles = sum(self.part[i] == ARTICLE and article[i] for i in range(n))
        if sizes[1] and (articles == 1 or 2 * sizes[1] >= sizes[0]):
            self.inside, self.marked = article, True
        elif sizes[2] and 2 * sizes[2] >= sizes[0]:
            self.inside, self.marked = main, True
        else:
            self.inside, self.marked = [not x for x in noise], False
        # inside a marked article plain paragraphs, lists and tables are no template
        self.exempt = [self.tag[i] in ("html", "body") for i in range(n)]
        if self.marked:
            for i in range(n):
                if self.inside[i]:
                    p = self.parent[i]
                    top = p < 0 or not self.inside[p]
                    self.exempt[i] = top or (self.exempt[p] and self.plain[i])
        self.noise = noise


def parse(html: str, known: dict) -> Page:
    """``known`` keeps what was found out about tags; callers share it between pages."""
    page = Page()
    root = page.open(-1, "html", "", known)
    stack: list[tuple[str, int]] = [("html", root)]
    opened: dict[str, int] = {"html": 1}
    buffer: list[str] = []
    block = root

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                page.block_of.append(block)
                page.texts.append(text)

    def pop_to(at: int) -> None:
        for name, _ in stack[at:]:
            opened[name] -= 1
        del stack[at:]

    def close(tags, scope) -> None:
        if any(opened.get(t) for t in tags):
            at = len(stack) - 1
            lowest = None
            while at > 0 and stack[at][0] not in scope:
                if stack[at][0] in tags:
                    lowest = at
                at -= 1
            if lowest is not None:
                pop_to(lowest)

    at, end = 0, len(html)
    last = html.rfind(">")
    for match in iter(lambda: _TAG.search(html, at) if at <= last else None, None):
        if match.start() > at:
            piece = html[at : match.start()]
            if not buffer:
                block = stack[-1][1]
            buffer.append(unescape(piece) if "&" in piece else piece)
        at = match.end()
        slash, tag, attributes = (match.group(1), match.group(2), match.group(3)) if match.group(2) else (match.group(4), match.group(5), match.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag in _INLINE:
                # only those with attributes were put on the stack
                if opened.get(tag):
                    k = len(stack) - 1
                    while k > 0 and stack[k][0] in _INLINE and stack[k][0] != tag:
                        k -= 1
                    if stack[k][0] == tag:
                        if page.part[stack[k][1]] == NOISE:
                            flush()
                        pop_to(k)
            elif tag == "br":
                buffer.append(" ")
            elif tag not in _VOID and tag not in _RAW:
                if tag in _NO_BREAK:
                    buffer.append(" ")
                else:
                    flush()
                if opened.get(tag) and tag not in ("html", "body"):
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    pop_to(k)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in _RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                stop = _RAW_END[tag].search(html, at)
                at = stop.end() if stop else end
                last = last if stop else -1
            continue
        if tag in _INLINE:
            if attributes.strip() and len(stack) < MOST_DEPTH:
                key = (tag, attributes)
                judged = known.get(key)
                if judged is None:
                    judged = known[key] = _judged(tag, attributes)
                if judged[1] == NOISE:
                    # inline adverts and the like leave their block
                    flush()
                    stack.append((tag, page.open(stack[-1][1], tag, attributes, known)))
                    opened[tag] = opened.get(tag, 0) + 1
            continue
        if tag in _NO_BREAK:
            buffer.append(" ")
        else:
            flush()
        if opened.get("head") and tag not in _IN_HEAD:
            close({"head"}, ())
        if tag in ("html", "body"):
            if tag == "html" or opened.get("body"):
                continue
        elif tag in _CLOSES:
            close(*_CLOSES[tag])
        elif opened.get("p"):
            close({"p"}, ("button", "td", "th", "caption"))
        if len(stack) >= MOST_DEPTH or tag in _NO_BREAK:
            element = stack[-1][1]
        else:
            element = page.open(stack[-1][1], tag, attributes, known)
        stack.append((tag, element))
        opened[tag] = opened.get(tag, 0) + 1
    # a tag or comment the page ends in is no text
    cut = _BEGUN.search(html, at)
    end = cut.start() if cut else end
    if at < end:
        piece = html[at:end]
        if not buffer:
            block = stack[-1][1]
        buffer.append(unescape(piece) if "&" in piece else piece)
    flush()
    page.finish()
    return page
