"""An HTML page as a list of text blocks with their places in the element tree, by one pass over its tags.

Tags, comments and raw-text elements are told apart as browsers do; tags that are left open are closed where the
next block of their kind begins, end tags without a start are ignored, and whatever is cut off at the end of the
page ends there. Text between two block boundaries is one block: character references are decoded, white space
becomes single spaces. Linear in the length of the page; nothing recurses.
"""
from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of the HTML standard, by what they mean for the flow of text.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("template svg object canvas audio video".split())  # skipped where they end
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search "
    "section select summary table caption colgroup tbody tfoot thead tr ul".split())
CELL = frozenset(("td", "th"))
CLOSES_P = BLOCK - frozenset("body caption colgroup dd dt head html legend li optgroup option tbody tfoot thead tr".split())
#: An element of the first kind ends an open one of the second kinds, up to an element that bounds it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
        "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot"),
        "thead": ("td", "th", "tr", "tbody", "thead", "tfoot"), "tfoot": ("td", "th", "tr", "tbody", "thead", "tfoot"),
        "body": ("head",)}
BOUNDS = frozenset("ul ol dl table select menu html".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_OTHER = re.compile(r"<[!?/][^>]*(?:>|\Z)")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW | SKIPPED}
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@dataclass(slots=True)
class Element:
    name: str
    parent: int
    depth: int
    attributes: str


@dataclass(slots=True)
class Block:
    text: str
    element: int        # the nearest block element around it
    linked: int         # characters of its text inside links
    controls: int       # characters inside buttons and labels


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    """The attributes that tell what an element is for, names in lower case."""
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)}


def parse(source: str) -> Page:
    """The page's elements (in order of their start tags; the root first) and its blocks (in page order)."""
    page = Page([Element("#root", -1, 0, "")])
    elements, stack, opened = page.elements, [0], {}
    pieces: list[tuple[str, bool, bool]] = []
    links = controls = 0
    tag = _TAG

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(p for p, _, _ in pieces).split())
        if text:
            at = next(e for e in reversed(stack) if elements[e].name in BLOCK or not e)
            page.blocks.append(Block(text, at, sum(len(p.strip()) for p, a, _ in pieces if a), sum(len(p.strip()) for p, _, c in pieces if c)))
        pieces.clear()

    def pop() -> None:
        nonlocal links, controls
        name = elements[stack.pop()].name
        opened[name] -= 1
        links -= name == "a"
        controls -= name in ("button", "label")

    def close(name: str) -> None:
        while elements[stack[-1]].name != name:
            pop()
        pop()

    position, end = 0, len(source)
    while position < end:
        at = source.find("<", position)
        if at < 0:
            at = end
        if at > position:
            piece = source[position:at]
            pieces.append((html.unescape(piece) if "&" in piece else piece, links > 0, controls > 0))
        if at == end:
            break
        match = tag.match(source, at)
        if match is None and tag is _TAG and _LOOSE_TAG.match(source, at):
            tag = _LOOSE_TAG  # a quote that nothing closes: quotes no longer count on this page
            match = tag.match(source, at)
        if match is None:
            ahead = source[at + 1:at + 2]
            if source.startswith("<!--", at):
                position = _COMMENT.match(source, at).end()
            elif ahead in ("!", "?", "/") and ahead:
                position = _OTHER.match(source, at).end()
            elif ahead.isascii() and ahead.isalpha():
                break  # the page ends inside a tag
            else:
                pieces.append(("<", links > 0, controls > 0))
                position = at + 1
            continue
        position = match.end()
        name = match[2].lower()
        if match[1]:  # an end tag
            if name in BLOCK:
                flush()
                if opened.get(name):
                    close(name)
            elif name in CELL:
                pieces.append((" ", False, False))
                if opened.get(name):
                    close(name)
            elif opened.get(name):
                for e in reversed(stack):
                    if elements[e].name == name:
                        close(name)
                        break
                    if elements[e].name in BLOCK or elements[e].name in CELL:
                        break
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                pieces.append((" ", False, False))
            continue
        if name in RAW or name in SKIPPED:
            over = None if match[3].endswith("/") and name == "svg" else _END[name].search(source, position)
            position = over.end() if over else end if name in RAW else position
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P and opened.get("p"):
                close("p")
        elif name in CELL:
            pieces.append((" ", False, False))
        ends = ENDS.get(name)
        if ends:
            for e in reversed(stack):
                if elements[e].name in BOUNDS:
                    break
                if elements[e].name in ends:
                    last = e
                    while stack[-1] != last:
                        pop()
                    pop()
                    if name not in ("tr", "tbody", "thead", "tfoot", "optgroup"):
                        break
        if name == "a" and links:  # links do not nest
            for e in reversed(stack):
                if elements[e].name == "a":
                    close("a")
                    break
                if elements[e].name in BLOCK:
                    break
        elements.append(Element(name, stack[-1], elements[stack[-1]].depth + 1, match[3]))
        stack.append(len(elements) - 1)
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
        controls += name in ("button", "label")
    flush()
    return page
