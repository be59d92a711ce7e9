"""Globs: * within a path component, ** over any number of them; everything else is literal."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_path(path: str) -> str:
    """Forward slashes, no verbatim prefix."""
    return path.removeprefix("\\\\?\\").replace("\\", "/")


def absolute_path(path: str, base: str = "/") -> str:
    """Joined to base and lexically normalized; links are not followed."""
    return posixpath.normpath(posixpath.join(normalized_path(base), normalized_path(path)))


def to_regex(pattern: str) -> str:
    """A regular expression for whole paths; ? and brackets stand for themselves."""
    out = []
    parts = normalized_path(pattern).split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out.append("(?:[^/]+/)*[^/]+" if last else "(?:[^/]+/)*")
        else:
            out.append("[^/]*".join(re.escape(x) for x in part.split("*")) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def literal_prefix(pattern: str) -> str:
    """The folders before the first wildcard: where a reader can start."""
    parts = []
    for part in normalized_path(pattern).split("/")[:-1]:
        if "*" in part:
            break
        parts.append(part)
    return "/".join(parts)


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a path matches one of the patterns; relative patterns match below any folder boundary at the end."""
    out = F.lit(False)
    for p in patterns:
        regex = to_regex(p)
        begin = "^" if p.startswith("/") or "://" in p else "(^|/)"
        out = out | path.rlike(begin + regex[1:])
    return out


def in_scope(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Included by some pattern (or none given) and excluded by none."""
    include = list(include)
    return (matches_any(path, include) if include else F.lit(True)) & ~matches_any(path, exclude)
