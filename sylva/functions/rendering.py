"""Rendering: a tree back to source text, in JSON, YAML or C#."""

from __future__ import annotations

import json

from ..sources.parsers import markup
from ..sources.tree import Node
from .items import data_to_xml


class RenderError(ValueError):
    pass


def from_xml(text: str) -> Node:
    """The element of an XML text."""
    return next(c for c in markup.xml(text).children if c.kind == "element")


def from_json(text: str) -> Node:
    """The element that plain JSON data stands for."""
    return data_to_xml(json.loads(text))


def _scalar(n: Node):
    text, kind = n.string_value(), n.attrs.get("kind")
    if kind in ("number", "boolean", "true", "false", "null"):
        try:
            return json.loads(text)
        except ValueError:
            return None if kind == "null" else text
    return text


def _value(n: Node):
    inner = [c for c in n.children if c.kind == "element"]
    if not inner:
        return _scalar(n) if n.children or n.attrs.get("kind") else {}
    out: dict = {}
    repeated = {c.name for c in inner if sum(d.name == c.name for d in inner) > 1}
    if {c.name for c in inner} == {"item"}:
        return [_value(c) for c in inner]
    for c in inner:
        key = c.attrs.get("key", c.name)
        if c.name in repeated:
            out.setdefault(key, []).append(_value(c))
        else:
            out[key] = _value(c)
    return out


def to_json(n: Node, indent: int = 2) -> str:
    return json.dumps(_value(n), indent=indent, ensure_ascii=False)


def to_yaml(n: Node) -> str:
    """YAML of a data tree; several documents are parted by three dashes."""
    import yaml

    tops = [c for c in n.children if c.kind == "element" and c.name == "document"] if n.name == "stream" else [n]
    return "---\n".join(yaml.safe_dump(_value(t), sort_keys=False, allow_unicode=True) for t in tops)


_MODIFIERS = "public private protected internal static abstract sealed virtual override readonly partial async const".split()


def to_csharp(n: Node, level: int = 0) -> str:
    """C# of the declaration elements: unit, import, namespace, class, struct, interface, property, field, method, comment."""
    pad = "    " * level
    part = lambda name: next((c.string_value() for c in n.children if c.kind == "element" and c.name == name), "")
    marks = [c.name for c in n.children if c.kind == "element" and not c.children and c.name in _MODIFIERS]
    head = " ".join([*marks, ""])
    bodies = [c for c in n.children if c.kind == "element" and c.name in ("body", "members")] or [n]
    members = [c for b in bodies for c in b.children if c.kind == "element" and c.name in _DECLARED]
    if n.name == "unit":
        return "\n".join(to_csharp(c, level) for c in n.children if c.kind == "element")
    if n.name == "import":
        return f"{pad}using {part('name') or n.string_value()};"
    if n.name == "comment":
        return "\n".join(pad + row for row in n.string_value().split("\n"))
    if n.name in ("namespace", "class", "struct", "interface", "enum", "record"):
        inner = "\n".join(to_csharp(c, level + 1) for c in members)
        return f"{pad}{head}{n.name} {part('name')}\n{pad}{{\n{inner}{chr(10) if inner else ''}{pad}}}"
    if n.name == "property":
        return f"{pad}{head}{part('type')} {part('name')} {{ get; set; }}"
    if n.name == "field":
        return f"{pad}{head}{part('type')} {part('name')};"
    if n.name == "method":
        params = ", ".join(p.string_value() for c in n.children if c.name in ("params", "parameters") for p in c.children if p.kind == "element")
        return f"{pad}{head}{part('returns') or 'void'} {part('name')}({params})\n{pad}{{\n{pad}}}"
    raise RenderError(f"cannot render {n.name}")


_DECLARED = frozenset("namespace class struct interface enum record property field method comment import".split())


def render(text: str, source: str, language: str) -> str:
    """A tree given as XML or JSON text, in the asked language."""
    n = from_xml(text) if source == "xml" else from_json(text)
    makers = {"json": to_json, "yaml": to_yaml, "csharp": to_csharp}
    if language not in makers:
        raise RenderError(f"no renderer for {language}")
    return makers[language](n)
