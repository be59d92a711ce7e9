"""XML by expat, passed through as it is; HTML by a recovering tokenizer, as a DOM-like tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from xml.parsers import expat

from ..tree import Node, Positions

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: An opening tag closes an open element of these, unless a boundary stands between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_TAG = re.compile(r"<!--(.*?)(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def xml(text: str) -> Node:
    """Elements, attributes, text, comments and instructions of a well-formed document; no positions."""
    doc = Node("document")
    now = [doc]
    p = expat.ParserCreate()
    p.buffer_text = True
    p.ordered_attributes = True

    def start(name: str, attrs: list[str]) -> None:
        now.append(now[-1].element(name))
        now[-1].attrs.update(zip(attrs[::2], attrs[1::2], strict=True))

    def characters(data: str) -> None:
        if len(now) > 1:
            now[-1].add_text(data)

    p.StartElementHandler = start
    p.EndElementHandler = lambda name: now.pop()
    p.CharacterDataHandler = characters
    p.CommentHandler = lambda data: now[-1].add(Node("comment", text=data))
    p.ProcessingInstructionHandler = lambda target, data: now[-1].add(Node("pi", target, data))
    p.Parse(text.encode("utf-8"), True)
    return doc


def raw_html(text: str) -> Node:
    """The tree of html() with texts and attributes as they are written."""
    return html(text, str)


def html(text: str, decoded: Callable[[str], str] = entities.unescape) -> Node:
    """Elements with lower-cased names, decoded text and attributes, comments; unclosed elements end where others begin."""
    where, doc = Positions(text), Node("document")
    stack: list[Node] = [doc]

    def finish(node: Node, offset: int) -> None:
        node.end_line, node.end_column = where.at(offset)

    def close(names: tuple[str, ...], limits: tuple[str, ...], offset: int) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                while len(stack) > k:
                    finish(stack.pop(), offset)
                return
            if stack[k].name in limits:
                return

    def words(start: int, end: int) -> None:
        if end > start:
            stack[-1].add_text(decoded(text[start:end]))

    at, n = 0, len(text)
    pending = 0
    while True:
        lt = text.find("<", at)
        if lt < 0:
            words(pending, n)
            break
        m = _TAG.match(text, lt)
        if m is None:
            at = lt + 1
            continue
        words(pending, lt)
        at = pending = m.end()
        tag = m.group(3) or m.group(6)
        if tag is None:
            if m.group(1) is not None:
                stack[-1].add(Node("comment", text=m.group(1))).at(where.span(lt, at))
            continue
        end, raw = (m.group(2), m.group(4)) if m.group(3) else (m.group(5), m.group(7))
        tag = tag.lower()
        if end:
            close((tag,), (), at)
            continue
        if tag in CLOSE_P:
            close(("p",), ("table", "td", "button"), lt)
        if tag in CLOSES:
            close(*CLOSES[tag], lt)
        e = stack[-1].element(tag).at(where.span(lt, at))
        for a in _ATTRIBUTE.finditer(raw or ""):
            value = a.group(2) or ""
            e.attrs.setdefault(a.group(1).lower(), decoded(value[1:-1] if value[:1] in "\"'" and value else value))
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, at)
            stop = over.start() if over else n
            if stop > at:
                e.add_text(text[at:stop] if tag in ("script", "style") else decoded(text[at:stop]))
            at = pending = over.end() if over else n
            finish(e, at)
        elif tag not in VOID and not (raw or "").rstrip().endswith("/"):
            stack.append(e)
    while len(stack) > 1:
        finish(stack.pop(), n)
    return doc

