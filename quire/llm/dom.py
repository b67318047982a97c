"""A tolerant reader of HTML that keeps what text extraction needs: the tree of
block elements and, as its leaves, the runs of text between their borders."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TEXT = "#text"
# fixed values: element names by role
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("audio button canvas datalist head iframe math noscript object script select style svg template "
                    "textarea title video xmp".split())
RAW = frozenset("iframe script style textarea title xmp".split())   # without an end tag these take the rest
# an element that a start tag ends, and the elements beyond which it is not looked for
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)),
        "tfoot": (("thead", "tbody", "tfoot"), ("table",))}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """Nodes in page order, parents before children: ``tags`` (``#text`` for
    runs), ``parents`` (-1 for the root), ``names`` (words of class, id and
    role), ``texts`` of runs with white space collapsed, and the characters
    and linked characters of runs."""
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, names: tuple[str, ...] = (), text: str | None = None, linked: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.texts.append(text)
        self.linked.append(linked)
        return len(self.tags) - 1


def name_words(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id and role, and ``hidden``."""
    words: list[str] = []
    for _, a, b, c in _NAMES.findall(attributes):
        words += [w.lower() for w in _WORD.findall(a or b or c)]
    if _HIDDEN.search(attributes):
        words.append("hidden")
    return tuple(dict.fromkeys(words))


def parse(source: str) -> Page:
    """The page's blocks and runs. Character references are decoded; comments,
    scripts, styles and other elements without readable text are skipped;
    omitted end tags are supplied; nothing is too broken to be read."""
    page = Page()
    stack = [page.add("html", -1)]
    pieces: list[str] = []      # of the open run
    links: list[str] = []
    in_link = False

    def close_run() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(TEXT, stack[-1], (), text, min(len("".join(links).strip()), len(text)))
            pieces.clear()
        links.clear()

    def pop_to(names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            tag = page.tags[stack[at]]
            if tag in names:
                del stack[at:]
                return
            if tag in until:
                return

    pos, n, last = 0, len(source), source.rfind(">")
    tag_at = _TAG
    while pos < n:
        at = source.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            piece = source[pos:at]
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if in_link:
                links.append(piece)
        if at >= n:
            break
        pos = at
        if source.startswith("<!--", at):
            if source.startswith(("<!-->", "<!--->"), at):
                pos = source.find(">", at) + 1
                continue
            end = source.find("-->", at + 4)
            pos = end + 3 if end >= 0 else n
            continue
        after = source[at + 1:at + 2]
        if after in ("!", "?") or (after == "/" and not source[at + 2:at + 3].isalpha()):
            end = source.find(">", at)
            pos = end + 1 if end >= 0 else n
            continue
        if not (after == "/" or after.isascii() and after.isalpha()):
            pieces.append("<")
            pos = at + 1
            continue
        if at > last:           # a tag that never ends
            break
        m = tag_at.match(source, at)
        if m is None:           # a quote that never ends: from here on quotes mean nothing
            tag_at = _PLAIN_TAG
            m = tag_at.match(source, at)
            if m is None:
                pieces.append("<")
                pos = at + 1
                continue
        pos = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag == "hr":
            close_run()
        elif tag in SKIPPED:
            if not closing:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, pos)
                if end is None:
                    if tag in RAW:
                        break
                else:
                    close = source.find(">", end.end())
                    pos = close + 1 if close >= 0 else n
        elif tag in BLOCKS or "-" in tag:
            close_run()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if page.tags[stack[depth]] == tag:
                        del stack[depth:]
                        break
                continue
            if tag == "html":
                continue
            if page.tags[stack[-1]] == "p":
                stack.pop()
            if tag in ENDS:
                pop_to(*ENDS[tag])
            if not attributes.endswith("/"):
                stack.append(page.add(tag, stack[-1], name_words(attributes) if attributes else ()))
    close_run()
    return page
