"""Sources: one row per document, with doc_id, path, language and content.

A corpus is any table with a text column, files found by globs, or texts given inline. Everything that
can be decided from the path is a column predicate below the parser, so it is applied before a
document's text reaches Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import globs
from .languages import BY_EXTENSION, UNKNOWN, canonical, claims

#: Path of a text that has none.
PATHLESS = "<string>"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("content", T.StringType())])
MAX_FILES = 10_000


class SourceError(ValueError):
    pass


def language_of(path: Column) -> Column:
    """The language by a path's last extension."""
    known = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))), F.lit(UNKNOWN))


def from_table(table: DataFrame, content: Column | str, path: Column | str = PATHLESS, language: Column | str | None = None, doc_id: Column | str | None = None) -> DataFrame:
    """Sources of a table; path and language may be columns or constants, the language follows from the path if not given."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    where = F.replace(as_column(path), F.lit("\\"), F.lit("/"))
    lang = language_of(where) if language is None else F.lit(canonical(language)) if isinstance(language, str) else language
    number = F.monotonically_increasing_id() if doc_id is None else F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.col(content) if isinstance(content, str) else content
    return table.select(number.cast("long").alias("doc_id"), where.alias("path"), lang.alias("language"), text.cast("string").alias("content")).where(F.col("language") != UNKNOWN)


def inline(spark: SparkSession, texts: Sequence[tuple[str | None, str, str]]) -> DataFrame:
    """Sources of (path or None, language, text); None is a text without a path."""
    rows = [(k, globs.normalized_path(p) if p else PATHLESS, canonical(lang), text) for k, (p, lang, text) in enumerate(texts)]
    for (_, lang, _), row in zip(texts, rows, strict=True):
        if row[2] == UNKNOWN:
            raise SourceError(f"unknown language {lang}")
    return spark.createDataFrame(rows, SCHEMA)


def from_files(spark: SparkSession, patterns: Iterable[str], exclude: Iterable[str] = (), language: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Sources of the files that match the patterns; files of unknown languages are left out.

    The reader starts at each pattern's literal folders; the pattern itself is a predicate on the path,
    applied to the listing before any content is read.
    """
    patterns = [globs.absolute_path(p) if "://" not in p else p for p in patterns]
    if not patterns:
        raise SourceError("no file patterns")
    roots = sorted({globs.literal_prefix(p) or "/" for p in patterns})
    roots = [r for r in roots if not any(r != o and (r + "/").startswith(o.rstrip("/") + "/") for o in roots)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    path = F.regexp_replace("path", "^file:/*", "/")
    lang = F.lit(canonical(language)) if language else language_of(path)
    found = files.where(globs.in_scope(path, patterns, exclude)).where(lang != UNKNOWN)
    count = found.select("path").count()
    if count > max_files:
        raise SourceError(f"{count} files match; the limit is {max_files}")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return found.select(F.xxhash64(path).alias("doc_id"), path.alias("path"), lang.alias("language"), text.alias("content"))


def diagnosed(spark: SparkSession, patterns: Sequence[str], exclude: Sequence[str] = (), diff_lines: bool = False, **options) -> tuple[DataFrame, list[str]]:
    """Sources of files, and in words what is wrong with the patterns; with a problem there are no sources."""
    none = spark.createDataFrame([], SCHEMA)
    if not patterns:
        return none, ["no file patterns specified: give files, or name them in the configuration"]
    if bad := [p for p in exclude if not p or "\x00" in p]:
        return none, [f"invalid exclude pattern {p!r}" for p in bad]
    if diff_lines and any(p == PATHLESS for p in patterns):
        return none, ["changed lines need a file path to compare with"]
    try:
        found = from_files(spark, patterns, exclude, **options)
    except SourceError as e:
        return none, [str(e)]
    except AnalysisException as e:
        return none, [f"file patterns matched 0 files: {', '.join(patterns)}"] if e.getCondition() == "PATH_NOT_FOUND" else [str(e)]
    if found.limit(1).count():
        return found, []
    return none, ["file patterns matched 0 files: " + ", ".join(patterns)]


def from_paths(spark: SparkSession, lines: str, **options) -> DataFrame:
    """Sources of a list of paths, one in a line (as piped in)."""
    return from_files(spark, [x.strip() for x in lines.splitlines() if x.strip()], **options)


def resolve_input(spark: SparkSession, *, string: str | None = None, piped: str | None = None, paths: Sequence[str] = (), language: str | None = None, **options) -> DataFrame:
    """Sources of what a command was given: a string, piped text with a language, piped paths, or patterns."""
    if string is not None or (piped and language):
        if len(paths) > 1:
            raise SourceError("inline text takes one path at most")
        lang = language or (_only_language(paths[0]) if paths else None)
        if lang is None:
            raise SourceError("inline text needs a language")
        return inline(spark, [(paths[0] if paths else None, lang, string if string is not None else piped)])
    if piped and not paths:
        return from_paths(spark, piped, language=language, **options)
    return from_files(spark, paths, language=language, **options)


def _only_language(path: str) -> str | None:
    found = claims(path.rpartition(".")[2])
    if len(found) > 1:
        raise SourceError(f"{path} could be {' or '.join(found)}; name a language")
    return found[0] if found else None


def scoped(sources: DataFrame, files: Sequence[str] | None = None, exclude: Sequence[str] = (), root_files: Sequence[str] | None = None, cli_files: Sequence[str] | None = None) -> DataFrame:
    """Sources inside all scopes that are set: root, operation and command line; an empty list is an empty scope."""
    for scope in (root_files, files, cli_files):
        if scope is not None:
            sources = sources.where(globs.matches_any(F.col("path"), scope) if scope else F.lit(False))
    return sources.where(~globs.matches_any(F.col("path"), exclude)) if exclude else sources
