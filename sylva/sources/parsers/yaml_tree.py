"""YAML by the composed node graph of PyYAML, whose marks give offsets."""

from __future__ import annotations

import yaml

from ..tree import Node, Positions, document, keyed

_KINDS = {"tag:yaml.org,2002:int": "number", "tag:yaml.org,2002:float": "number", "tag:yaml.org,2002:bool": "boolean", "tag:yaml.org,2002:null": "null"}


def _compose(text: str) -> list:
    return [n for n in yaml.compose_all(text, Loader=yaml.SafeLoader) if n is not None]


def _kind(n) -> str:
    return _KINDS.get(n.tag, "string")


def _text(n, text: str) -> str:
    """Scalar text; numbers, booleans and null as they are written; folded blocks keep their line breaks."""
    if n.style in ("|", ">"):
        lines = text[n.start_mark.index : n.end_mark.index].split("\n")[1:]
        while lines and not lines[-1].strip():
            lines.pop()
        indent = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
        return "\n".join(x[indent:] for x in lines)
    if n.style is None:
        return text[n.start_mark.index : n.end_mark.index].strip() if n.start_mark.index < n.end_mark.index else ""
    return n.value


def data(text: str) -> Node:
    """stream/document; keys become elements, sequences repeat the element of their key."""
    where, root = Positions(text), Node("element", "stream")
    root.at(where.span(0, len(text)))
    for top in _compose(text):
        d = root.element("document").at(_span(where, top))
        if isinstance(top, yaml.SequenceNode):
            for item in top.value:
                _pair(d, "item", item, where, text)
        else:
            _fill(d, top, where, text)
    return document(root)


def _span(where: Positions, n) -> tuple[int, int, int, int]:
    return where.span(n.start_mark.index, n.end_mark.index)


def _fill(parent: Node, n, where: Positions, text: str) -> None:
    if isinstance(n, yaml.MappingNode):
        for k, v in n.value:
            _pair(parent, k.value if isinstance(k, yaml.ScalarNode) else "item", v, where, text)
    elif isinstance(n, yaml.ScalarNode):
        parent.add_text(_text(n, text))


def _pair(parent: Node, key: str, n, where: Positions, text: str) -> None:
    if isinstance(n, yaml.SequenceNode):
        for item in n.value:
            _pair(parent, key, item, where, text)
        return
    e = keyed(parent, str(key)).at(_span(where, n))
    e.attrs["field"] = e.name
    if isinstance(n, yaml.ScalarNode):
        e.attrs["kind"] = _kind(n)
    _fill(e, n, where, text)


def structure(text: str) -> Node:
    """document per YAML document, with the vocabulary of JSON structure trees."""
    where, root = Positions(text), Node("element", "stream")
    root.at(where.span(0, len(text)))

    def put(parent: Node, n) -> None:
        span = _span(where, n)
        if isinstance(n, yaml.MappingNode):
            e = parent.element("object").at(span)
            for k, v in n.value:
                p = e.element("property").at(where.span(k.start_mark.index, v.end_mark.index))
                put(p.element("key").at(_span(where, k)), k)
                put(p.element("value").at(_span(where, v)), v)
        elif isinstance(n, yaml.SequenceNode):
            e = parent.element("array").at(span)
            for item in n.value:
                put(e, item)
        else:
            kind = _kind(n)
            parent.element("bool" if kind == "boolean" else kind).at(span).add_text(_text(n, text))

    for top in _compose(text):
        put(root.element("document").at(_span(where, top)), top)
    return document(root)
