"""A page's text blocks in order, each with its role by the elements around it."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

CONTENT, NEUTRAL, BOILERPLATE = "content", "neutral", "boilerplate"

#: Elements that begin and end a block (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is not markup, and of these and others, elements that never hold an article's text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = RAW | frozenset("head nav footer aside form noscript template button select dialog svg menu object canvas audio video".split())
LANDMARKS = frozenset(("article", "main"))
#: Words in class and id that mark menus, adverts, notices and comments.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)
LISTS = frozenset(("ul", "ol", "menu"))
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu".split())
#: An opening tag of these ends an open p.
CLOSES_P = BLOCKS - {"body", "head", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "summary"}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.DOTALL)
_PLAIN = re.compile(r"[^'\">]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=)", re.IGNORECASE)


@dataclass(slots=True)
class TextBlock:
    element: str
    role: str
    text: str


def _marked(name: str, attributes: str, inside_content: bool) -> bool:
    """Whether an element is boilerplate by its name, class, id or role. A header inside an article belongs to it."""
    if name in NEVER or (name == "header" and not inside_content):
        return True
    if not attributes.strip(" /"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and name not in LANDMARKS | {"body", "html"} and not HINTS.isdisjoint(_WORDS.findall(value)):
            return True
    return bool(_HIDDEN.search(_ATTRIBUTE.sub("", re.sub(r"""("[^"]*"|'[^']*')""", "''", attributes))))


class _Tags:
    """Ends of tags, in time linear in the page: a quote that nothing closes is looked for once."""

    def __init__(self, page: str) -> None:
        self.page, self.closed = page, {'"': True, "'": True}

    def end(self, at: int) -> int:
        """The place of the > that ends a tag, -1 if none does. A quote without an end is an ordinary character."""
        page, n = self.page, len(self.page)
        while True:
            at = _PLAIN.match(page, at).end()
            if at >= n:
                return -1
            if page[at] == ">":
                return at
            quote = page[at]
            shut = page.find(quote, at + 1) if self.closed[quote] else -1
            if shut < 0:
                self.closed[quote] = False
            at = max(at, shut) + 1


def blocks_of(page: str) -> list[TextBlock]:
    """The page's blocks that hold text. Character references are decoded, white space runs are one space."""
    out: list[TextBlock] = []
    stack: list[tuple[str, str, str]] = []  # element, role inside it, nearest block
    open_: Counter[str] = Counter()
    pieces: list[str] = []
    tags = _Tags(page)

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append(TextBlock(stack[-1][2], stack[-1][1], text) if stack else TextBlock("body", NEUTRAL, text))

    def close(i: int) -> None:
        for name, *_ in stack[i:]:
            open_[name] -= 1
        del stack[i:]

    def close_to(name: str, stops: frozenset[str]) -> None:
        """Close the nearest open element of the name, if none of the stops is opened inside it."""
        for i in range(len(stack) - 1, -1, -1) if open_[name] else ():
            if stack[i][0] == name:
                close(i)
                break
            if stack[i][0] in stops:
                break

    at, n = 0, len(page)
    while at < n:
        found = _MARKUP.search(page, at)
        if found is None:
            pieces.append(page[at:])
            break
        if found.start() > at:
            pieces.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        stop = tags.end(at)
        if stop < 0:  # a tag that does not end is text
            pieces.append(page[found.start() :])
            break
        attributes, at = page[at:stop], stop + 1
        if found[1]:
            if name in BLOCKS:
                flush()
            # a stray inline end tag does not end a block
            close_to(name, frozenset() if name in BLOCKS else BLOCKS)
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSES_P:
                close_to("p", BLOCKS)
            elif name == "li":
                close_to("li", LISTS)
        if name == "br":
            pieces.append(" ")
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        role = stack[-1][1] if stack else NEUTRAL
        if role != BOILERPLATE:
            if _marked(name, attributes, role == CONTENT):
                role = BOILERPLATE
            elif name in LANDMARKS:
                role = CONTENT
        stack.append((name, role, name if name in BLOCKS else stack[-1][2] if stack else "body"))
        open_[name] += 1
    flush()
    return out
