"""Result items as values and as JSON: what a match shows of a node, a value, a map or an array."""

from __future__ import annotations

import json
import math

from ..plans.evaluate import FUNCTIONS, Array, Function, Map, Untyped, string_of
from ..plans.moments import Moment, Span
from ..sources.tree import Node, subtree_text


def item_type(x) -> str:
    return "node" if isinstance(x, Node) else "map" if isinstance(x, Map) else "array" if isinstance(x, Array) else "function" if isinstance(x, Function) else "atomic"


def item_value(x, quoted: bool = True) -> str | None:
    """A node's string value; atomic text in XPath quotes unless quoted is off; nothing for maps and arrays."""
    if isinstance(x, (Map, Array, Function)):
        return None
    if isinstance(x, str) and not isinstance(x, Untyped) and quoted:
        return '"' + x.replace('"', '""') + '"'
    return string_of(x)


def item_to_xml(x, indent: int | None = None, depth: int | None = None, meta: bool = False) -> str:
    return subtree_text(x, indent, depth, meta)


def node_to_data(n: Node, depth: int | None = None, level: int = 0):
    """A subtree as plain data: empty children are flags, children with a field are properties, others stand in children."""
    if n.kind == "document":
        inner = [node_to_data(c, depth, level) for c in n.children if c.kind == "element"]
        return inner[0] if len(inner) == 1 else inner
    if n.kind != "element":
        return (n.text or "").strip() or None
    cut = depth is not None and level + 1 >= depth
    elements = [c for c in n.children if c.kind == "element"]
    text = " ".join(t for c in n.children if c.kind == "text" and (t := (c.text or "").strip()))
    flags = [] if cut else [c.name for c in elements if not c.children]
    inner = [] if cut else [(c.attrs.get("field"), node_to_data(c, depth, level + 1)) for c in elements if c.children]
    field = n.attrs.get("field")
    if text and not flags and not inner and not (cut and elements):
        return text if field else {n.name: text}
    out: dict = {} if field else {"$type": n.name}
    out.update(dict.fromkeys(flags, True))
    rest = []
    for name, value in inner:
        if name is None:
            rest.append(value)
        elif name in out and name != "$type":
            out[name] = [*out[name], value] if isinstance(out[name], list) else [out[name], value]
        else:
            out[name] = value
    if rest:
        out["children"] = rest
    elif text and not inner and not (cut and elements):
        out["text"] = text
    return out


def data_to_xml(value, name: str = "document") -> Node:
    """The element that plain data stands for: the inverse of node_to_data."""
    if isinstance(value, dict):
        value = dict(value)
        e = Node("element", value.pop("$type", name))
        children = value.pop("children", [])
        text = value.pop("text", None)
        for k, v in value.items():
            if v is True:
                e.element(k)
            else:
                for x in v if isinstance(v, list) else [v]:
                    c = e.add(data_to_xml(x, k))
                    c.attrs["field"] = k
        for c in children:
            if isinstance(c, dict) and "$type" not in c and len(c) == 1:
                k, v = next(iter(c.items()))
                e.add(data_to_xml(v, k))
            else:
                e.add(data_to_xml(c, "item"))
        if text is not None:
            e.add_text(str(text))
        return e
    e = Node("element", name)
    if isinstance(value, list):
        for x in value:
            e.add(data_to_xml(x, "item"))
    elif value is not None:
        e.add_text(json.dumps(value) if isinstance(value, bool) else str(value))
    return e


def item_to_data(x, depth: int | None = None, sequences: list | None = None, path: str = ""):
    """Plain data of an item. Map entries of one item are bare, of several an array (noted in sequences), of none null."""
    if isinstance(x, Node):
        return string_of(x) if path else node_to_data(x, depth)
    if isinstance(x, Map):
        order = {False: 0, True: 1}
        out = {}
        for k, v in x.items():
            key = f"{path}.{string_of(k)}" if path else string_of(k)
            if len(v) > 1 and sequences is not None and key not in sequences:
                sequences.append(key)
            values = [item_to_data(y, depth, sequences, key) for y in v]
            out[string_of(k)] = values[0] if len(values) == 1 else values or None
        return dict(sorted(out.items(), key=lambda kv: (1 if isinstance(kv[1], dict) else 2 if isinstance(kv[1], list) else order[False], kv[0])))
    if isinstance(x, Array):
        return [item_to_data(m[0], depth, sequences, path or "array") if len(m) == 1 else [item_to_data(y, depth, sequences, path or "array") for y in m] for m in x]
    if isinstance(x, float) and (math.isnan(x) or math.isinf(x)):
        return None
    if isinstance(x, float) and x == int(x):
        return int(x)
    return str(x) if isinstance(x, (str, Moment, Span)) else x


def item_to_json(x, depth: int | None = None, sequences: list | None = None) -> str:
    return json.dumps(item_to_data(x, depth, sequences), ensure_ascii=False)


def sequence_warnings(x) -> list[str]:
    """What to say about map entries that became arrays because they held several items."""
    found: list[str] = []
    item_to_data(x, None, found)
    return [f'"{k.rpartition(".")[2]}" matched several values and became an array; write array {{ ... }} to have one always, or (...)[1] for a single value' for k in found]


def _serialize(_c, seq: list, _options=None) -> list:
    """fn:serialize: nodes as XML, maps and arrays as JSON, values as text."""
    return ["".join(item_to_xml(x) if isinstance(x, Node) else item_to_json(x) if isinstance(x, (Map, Array)) else string_of(x) for x in seq)]


FUNCTIONS["serialize"] = (1, 2, _serialize)
