"""Expressions from examples: nodes picked in a tree become a path with predicates.

Picked ancestors of the target are steps of the path, picked nodes below it are predicates, and picked
nodes beside it are predicates of the lowest node that holds both.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..sources.tree import Node, document, number


@dataclass(frozen=True)
class Pick:
    node: Node
    condition: str | None = None
    target: bool = False


def _line(n: Node) -> list[Node]:
    """A node and its ancestors, the node first."""
    out = [n]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _inside(a: Node, b: Node) -> bool:
    return a is not b and b.pre < a.pre <= b.post


def common(nodes: Sequence[Node]) -> Node:
    """The lowest node that holds all of them."""
    shared = _line(nodes[0])
    for n in nodes[1:]:
        line = set(map(id, _line(n)))
        shared = [x for x in shared if id(x) in line]
    return shared[0]


def target_of(picks: Sequence[Pick]) -> Node:
    """The flagged node; else the only one, the lowest of one line, or what holds them all."""
    for p in picks:
        if p.target:
            return p.node
    nodes = [p.node for p in picks]
    lowest = max(nodes, key=lambda n: n.depth)
    if all(n is lowest or _inside(lowest, n) for n in nodes):
        return lowest
    return common(nodes)


def build_query(picks: Sequence[Pick]) -> str:
    """The expression of picked nodes of one numbered tree, or nothing without any."""
    if not picks:
        return ""
    target = target_of(picks)
    said = {id(p.node): p.condition for p in picks}
    chosen = sorted({id(p.node): p.node for p in picks}.values(), key=lambda n: n.pre)
    spine = {id(n): n for n in chosen if _inside(target, n)}
    hung: dict[int, list[Node]] = {}
    for n in chosen:
        if n is target or id(n) in spine:
            continue
        holder = target if _inside(n, target) else common([n, target])
        spine.setdefault(id(holder), holder)
        hung.setdefault(id(holder), []).append(n)
    steps = sorted({**spine, id(target): target}.values(), key=lambda n: n.pre)

    def own(n: Node) -> str:
        return n.name + (f"[{said[id(n)]}]" if said.get(id(n)) else "")

    def tops(nodes: list[Node]) -> list[Node]:
        return [n for n in nodes if not any(_inside(n, m) for m in nodes)]

    def below(n: Node, holder: Node, rest: list[Node], first: bool) -> str:
        """A predicate's path to n, with what is picked inside it."""
        step = own(n) if n.parent is holder else (".//" if first else "/") + own(n)
        inner = [m for m in rest if _inside(m, n)]
        heads = tops(inner)
        if len(heads) == 1:
            return step + "/" + below(heads[0], n, inner, False)
        return step + "".join(f"[{below(h, n, inner, True)}]" for h in heads)

    out = ""
    for k, n in enumerate(steps):
        out += "//" if not k or n.parent is not steps[k - 1] else "/"
        rest = hung.get(id(n), [])
        out += own(n) + "".join(f"[{below(h, n, rest, True)}]" for h in tops(rest))
    return out


@dataclass(frozen=True)
class PathPick:
    """A picked path of element names, as a schema shows it."""

    path: tuple[str, ...]
    condition: str | None = None
    target: bool = False


def build_query_from_paths(picks: Sequence[PathPick]) -> str:
    """The expression of picked paths: that of the nodes of a tree in which every path is there once."""
    doc = document()
    nodes: dict[tuple[str, ...], Node] = {(): doc}
    for p in picks:
        for k in range(1, len(p.path) + 1):
            if p.path[:k] not in nodes:
                nodes[p.path[:k]] = nodes[p.path[: k - 1]].element(p.path[k - 1])
    number(doc)
    return build_query([Pick(nodes[p.path], p.condition, p.target) for p in picks if p.path])
