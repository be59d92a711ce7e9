"""Parsers: text of one language to a numbered tree.

parse() picks the parser by language and tree mode. register() adds one for another language, for
instance where a grammar library is installed.
"""

from __future__ import annotations

from collections.abc import Callable

from xml.parsers.expat import ExpatError

import yaml

from ..languages import canonical, default_mode, supports_data_mode
from ..tree import Node, number
from . import braces, ini_env, json_tree, markdown, markup, plain, python_code, sql, toml_tree, yaml_tree

_PARSERS: dict[tuple[str, str], Callable[[str], Node]] = {
    ("json", "data"): json_tree.data,
    ("json", "structure"): json_tree.structure,
    ("json", "raw"): json_tree.raw,
    ("yaml", "data"): yaml_tree.data,
    ("yaml", "structure"): yaml_tree.structure,
    ("toml", "structure"): toml_tree.structure,
    ("ini", "structure"): ini_env.ini,
    ("env", "structure"): ini_env.env,
    ("markdown", "structure"): markdown.structure,
    ("xml", "structure"): markup.xml,
    ("html", "structure"): markup.html,
    ("html", "raw"): markup.raw_html,
    ("python", "structure"): python_code.structure,
    ("tsql", "structure"): sql.structure,
    ("text", "structure"): plain.lines,
}


class ParseError(ValueError):
    """The text cannot be parsed in the asked language and mode."""


#: What a text that its language does not allow raises.
BAD_TEXT = (ValueError, SyntaxError, RecursionError, IndexError, yaml.YAMLError, ExpatError)


def register(language: str, mode: str, parser: Callable[[str], Node]) -> None:
    _PARSERS[canonical(language), mode] = parser


def resolve_mode(language: str, mode: str | None) -> str:
    """An asked mode wins, data only where the language has a data tree; else the language's own."""
    if mode is None:
        return default_mode(language)
    if mode == "data" and not supports_data_mode(language):
        raise ParseError(f"{language} has no data tree")
    return mode


def parse(text: str, language: str, mode: str | None = None, ignore_whitespace: bool = False, parse_depth: int | None = None) -> Node:
    """The numbered tree of a text; its root is the document node."""
    language = canonical(language)
    mode = resolve_mode(language, mode)
    parser = _PARSERS.get((language, mode))
    if parser is None and language in braces.LANGUAGES:
        parser = braces.parser(language, mode)
    if parser is None:
        parser = _PARSERS.get((language, "structure"))
    if parser is None:
        raise ParseError(f"no parser for {language}")
    doc = parser(text.replace("\r\n", "\n") if language != "xml" else text)
    if ignore_whitespace:
        _strip_whitespace(doc)
    if parse_depth is not None:
        _cut(doc, parse_depth)
    return number(doc)


def _strip_whitespace(node: Node) -> None:
    kept = []
    for c in node.children:
        if c.kind == "text":
            c.text = "".join((c.text or "").split())
            if not c.text:
                continue
        else:
            _strip_whitespace(c)
        kept.append(c)
    node.children = kept


def _cut(node: Node, depth: int) -> None:
    if depth <= 0:
        node.children = []
    for c in node.children:
        _cut(c, depth - 1)
