"""Configuration files (YAML or TOML): operations with their scopes; unknown keys are refused."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field

ROOT_KEYS = {"files", "exclude", "diff-files", "diff-lines", "check", "set", "query", "test", "operations"}
COMMON_KEYS = {"files", "exclude", "diff-files", "diff-lines", "tree-mode", "language"}
OWN_KEYS = {
    "check": {"rules"},
    "set": {"mappings", "expression", "value", "limit", "ignore-whitespace", "parse-depth", "inline-source", "write-mode", "verify", "report-mode"},
    "query": {"queries", "limit"},
    "test": {"assertions", "limit"},
}
ITEM_KEYS = {
    "rules": {"id", "xpath", "reason", "severity", "message", "include", "exclude", "language", "tree-mode", "expect"},
    "mappings": {"xpath", "value", "value-kind"},
    "queries": {"xpath"},
    "assertions": {"xpath", "expect"},
}


class ConfigError(ValueError):
    pass


@dataclass
class Operation:
    """One operation: its kind, its own settings, and the scopes it runs in."""

    kind: str
    settings: dict
    files: Sequence[str] | None = None
    root_files: Sequence[str] | None = None
    exclude: list[str] = field(default_factory=list)
    diff_files: list[str] = field(default_factory=list)
    diff_lines: list[str] = field(default_factory=list)


def _known(data: dict, keys: set, where: str) -> None:
    if not isinstance(data, dict):
        raise ConfigError(f"{where} must be a mapping")
    if extra := sorted(set(data) - keys):
        raise ConfigError(f"unknown key {extra[0]!r} in {where}")


def _listed(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def parse(text: str, kind: str = "yaml") -> list[Operation]:
    """Operations of a configuration text in the order they run: the root's own first, then the list."""
    if kind == "toml":
        data = tomllib.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text) or {}
    _known(data, ROOT_KEYS, "the configuration")
    found = [(k, data[k]) for k in ("check", "set", "query", "test") if k in data]
    for item in data.get("operations") or []:
        _known(item, set(OWN_KEYS), "operations")
        found += list(item.items())
    out = []
    for name, settings in found:
        settings = settings or {}
        _known(settings, COMMON_KEYS | OWN_KEYS[name], name)
        for items, keys in ITEM_KEYS.items():
            for entry in settings.get(items) or []:
                _known(entry, keys, items)
                if "xpath" not in entry:
                    raise ConfigError(f"an entry of {items} has no xpath")
        own = {k: v for k, v in settings.items() if k not in ("files", "exclude", "diff-files", "diff-lines")}
        out.append(
            Operation(
                name, own,
                settings.get("files"), data.get("files"),
                _listed(data.get("exclude")) + _listed(settings.get("exclude")),
                _listed(data.get("diff-files")) + _listed(settings.get("diff-files")),
                _listed(data.get("diff-lines")) + _listed(settings.get("diff-lines")),
            )
        )
    return out


def load(path: str) -> list[Operation]:
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), "toml" if path.endswith(".toml") else "yaml")
