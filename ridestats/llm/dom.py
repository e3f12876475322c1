"""HTML as a tree of elements with their own texts.

A small tolerant reader: end tags may be missing or stray, attributes unquoted, the page
cut off anywhere. As in browsers, quotes hold a value together only behind an equals sign,
an unquoted value goes on to the next blank or ``>`` (also over a slash), and ``/>`` ends an
element at once only in drawings and formulas. Contents of scripts, styles and the like,
comments and markup are not text, nor is what ended drawings, templates, menus of choices
and noscript hold; where such an element is never ended, its content stays. Elements more
than ``DEPTH`` deep become children of the last one that is not.

One pass over the page without recursion or backtracking: the work for a page grows with
its length, whatever its markup.
"""

from __future__ import annotations

import re
from html import unescape

# Elements without content, with content that is not text, and that stand inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
NO_TEXT = frozenset("noscript template svg select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
# Elements that an opening tag of the same group ends.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav"
    " ol p pre section table ul".split()
)
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
# Drawings and formulas; elements inside them that hold ordinary markup; what cannot stand in them or in a select.
_FOREIGN = frozenset("svg math".split())
_INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_LEAVES_FOREIGN = _ENDS_P | frozenset("b big body br center code dd dt em embed head i img li nobr ruby s small span strong strike sub sup tt u var".split())
_LEAVES_SELECT = (_ENDS_P - {"hr", "div"}) | {"select", "input", "textarea", "li"}
_SCOPE = frozenset("svg math object template select ul ol dl table div section article aside nav main header footer form blockquote body html".split())
DEPTH = 512
# Quantifiers that never give back keep the scan linear. A value is what follows "=".
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:{_VALUE}|[\s/]++|[^\s/>=]++|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?+|'([^']*+)'?+|([^\s>\"'][^\s>]*+)))?+|=")
_NAMING = frozenset(("class", "id", "role"))


_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "names", "parent", "parts", "number", "region")

    def __init__(self, tag: str, names: str, parent: Node | None, number: int):
        self.tag, self.names, self.parent, self.number = tag, names, parent, number
        self.parts: list = []  # texts and nodes in order
        # The innermost template or select, or outermost drawing or formula, that it stands in or is.
        region = parent.region if parent else None
        if tag in _INTEGRATION and region and region.tag in _FOREIGN:
            region = None
        elif tag in ("template", "select") or tag in _FOREIGN and not (region and region.tag in _FOREIGN):
            region = self
        self.region = region


def parse(html: str | None) -> list[Node]:
    """Nodes in page order, the root first; a parent comes before its children."""
    root = Node("#root", "", None, 0)
    nodes, stack, at, html = [root], [root], 0, html or ""
    while True:
        found = _TAG.search(html, at)
        text = html[at : found.start()] if found else html[at:]
        if text:
            stack[-1].parts.append(unescape(text))
        if not found:
            return nodes
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            ended = _close(stack, tag)
            if ended and tag in NO_TEXT:
                _leave_out(ended, nodes)
            continue
        region = stack[-1].region
        if region and (tag in _LEAVES_FOREIGN if region.tag in _FOREIGN else region.tag == "select" and tag in _LEAVES_SELECT):
            del stack[stack.index(region) :]
            if region.tag in NO_TEXT:
                _leave_out(region, nodes)
        if tag in _ENDS_P:
            _close(stack, "p")
        for sibling in _SIBLINGS.get(tag, ()):
            _close(stack, sibling)
        node = Node(tag, _names(found[3]) if "=" in found[3] else "", stack[-1], len(nodes))
        nodes.append(node)
        stack[-1].parts.append(node)
        region = node.region
        foreign = tag in _FOREIGN or region and region.tag in _FOREIGN
        if foreign and _self_closed(found[3]):
            continue
        if tag in RAW:
            end = _END[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and len(stack) <= DEPTH:
            stack.append(node)


def _names(attributes: str) -> str:
    """Words of class, id and role."""
    return " ".join(m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1] and m[1].lower() in _NAMING).lower()


def _self_closed(attributes: str) -> bool:
    """Whether the slash in front of the ``>`` is not the end of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    end = 0
    for found in _ATTRIBUTE.finditer(attributes):
        end = found.end()
    return end < len(attributes)


def _leave_out(ended: Node, nodes: list[Node]) -> None:
    """Forget what an element holds that ends here: all nodes since it began."""
    del nodes[ended.number + 1 :]
    ended.parts.clear()


def _close(stack: list[Node], tag: str) -> Node | None:
    """End the innermost open element of that name, and what is open inside it; the element.

    A paragraph or list item that is ended by the next one is not looked for beyond the
    container that it would have to stand in.
    """
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            ended = stack[i]
            del stack[i:]
            return ended
        if tag in ("p", *_SIBLINGS) and stack[i].tag in _SCOPE:
            return None
    return None
