"""A small tolerant reader of HTML: a flat list of nodes, parents before children."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video".split())
RAW = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in ("script", "style", "textarea", "title")}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
# Start tags that end an open element of these kinds, up to the nearest of the second list.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul li dd dt".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}


class Page:
    """Nodes by number: ``tag`` ("" for a text), ``parent``, ``words`` (of class, id, role), ``text``."""

    def __init__(self):
        self.tag, self.parent, self.words, self.text, self.attributes = ["html"], [-1], [()], [""], [""]

    def add(self, tag: str, parent: int, words: tuple = (), text: str = "", attributes: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.text.append(text)
        self.attributes.append(attributes)
        return len(self.tag) - 1


def named_words(attributes: str) -> tuple[str, ...]:
    found = []
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role", "aria-label"):
            found += dict.fromkeys(NAME.findall((m[2] or m[3] or m[4] or "").lower()))
        elif name == "hidden":
            found.append("hidden")
    return tuple(found)


def read(source: str | None) -> Page:
    """Unclosed elements end with their parents; end tags without a start are passed over."""
    page, open_ = Page(), [0]
    if not source:
        return page
    at = 0
    while at < len(source):
        m = TOKEN.search(source, at)
        if m is None:
            _text(page, open_, source[at:])
            break
        if m.start() > at:
            _text(page, open_, source[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if m[0].startswith("</"):
            _end(page, open_, tag)
            continue
        if tag == "html" or tag == "body" and "body" in (page.tag[n] for n in open_):
            continue
        _before(page, open_, tag)
        node = page.add(tag, open_[-1], named_words(m[2]) if m[2] else (), "", m[2])
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW[tag].search(source, at)
            if tag not in UNSEEN and end.start() > at:
                page.add("", node, (), html.unescape(source[at : end.start()]))
            at = end.end()
        elif not m[2].rstrip().endswith("/"):
            open_.append(node)
    return page


def _text(page: Page, open_: list[int], raw: str) -> None:
    page.add("", open_[-1], (), html.unescape(raw) if "&" in raw else raw)


def _end(page: Page, open_: list[int], tag: str) -> None:
    for k in range(len(open_) - 1, 0, -1):
        if page.tag[open_[k]] == tag:
            del open_[k:]
            return


def _before(page: Page, open_: list[int], tag: str) -> None:
    """Ends what a start tag implies the end of."""
    if tag == "body":
        del open_[1:]
        return
    if tag in ENDS_P:
        for k in range(len(open_) - 1, 0, -1):
            name = page.tag[open_[k]]
            if name == "p":
                del open_[k:]
                break
            if name not in INLINE:
                break
    if tag in CLOSES:
        kinds, bounds = CLOSES[tag]
        for k in range(len(open_) - 1, 0, -1):
            name = page.tag[open_[k]]
            if name in bounds:
                break
            if name in kinds:
                del open_[k:]
                break


def hidden(page: Page) -> list[bool]:
    """Nodes below elements that are never shown as text."""
    out = []
    for n, parent in enumerate(page.parent):
        out.append(page.tag[n] in UNSEEN or parent >= 0 and out[parent])
    return out


def blocks(page: Page, shown: list[bool]) -> list[str]:
    """Texts of the shown text nodes, joined within a block, white space collapsed."""
    # A block is the run of texts with the same nearest element that isn't inline, with
    # nothing but inline elements between.
    holder = []
    for n, parent in enumerate(page.parent):
        holder.append(n if parent < 0 or page.tag[n] not in INLINE and page.tag[n] not in ("", "br") else holder[parent])
    out, run, last = [], [], -1
    for n in range(1, len(page.tag)):
        if holder[n] != last:
            out.append(run)
            run, last = [], holder[n]
        if page.tag[n] == "br":
            run.append(" ")
        elif not page.tag[n] and shown[n]:
            run.append(page.text[n])
    out.append(run)
    texts = (" ".join("".join(r).split()) for r in out)
    return [t for t in texts if t]
