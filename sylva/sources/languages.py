"""Languages: names, extensions, aliases and default tree modes (fixed values)."""

from __future__ import annotations

import posixpath

#: language -> extensions, aliases
LANGUAGES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "csharp": (("cs",), ("cs",)),
    "rust": (("rs",), ("rs",)),
    "javascript": (("js", "mjs", "cjs", "jsx"), ("js", "jsx")),
    "typescript": (("ts",), ("ts",)),
    "tsx": (("tsx",), ()),
    "python": (("py", "pyw", "pyi"), ("py",)),
    "go": (("go",), ()),
    "java": (("java",), ()),
    "ruby": (("rb", "rake", "gemspec"), ("rb",)),
    "cpp": (("cpp", "cc", "cxx", "hpp", "hxx", "hh"), ()),
    "c": (("c", "h"), ()),
    "json": (("json",), ()),
    "html": (("html", "htm"), ()),
    "css": (("css",), ()),
    "bash": (("sh", "bash"), ("sh",)),
    "yaml": (("yml", "yaml"), ("yml",)),
    "toml": (("toml",), ()),
    "ini": (("ini", "cfg", "inf"), ()),
    "env": (("env",), ()),
    "php": (("php",), ()),
    "scala": (("scala", "sc"), ()),
    "lua": (("lua",), ()),
    "haskell": (("hs", "lhs"), ()),
    "ocaml": (("ml", "mli"), ()),
    "r": (("r",), ()),
    "julia": (("jl",), ()),
    "markdown": (("md", "markdown", "mdx"), ("md", "mdx")),
    "xml": (("xml",), ()),
    "tsql": (("sql",), ("mssql",)),
}
#: Languages whose default tree is the data tree.
DATA_DEFAULT = ("json", "yaml")
#: Not a language of files: plain text as lines.
TEXT = "text"
UNKNOWN = "unknown"

BY_EXTENSION = {e: name for name, (extensions, _) in LANGUAGES.items() for e in extensions}
BY_ALIAS = {a: name for name, (_, aliases) in LANGUAGES.items() for a in (name, *aliases)} | {TEXT: TEXT, "txt": TEXT}


def canonical(language: str) -> str:
    """The language that a name or alias means, or unknown."""
    return BY_ALIAS.get(language.lower(), UNKNOWN)


def of_path(path: str) -> str:
    """The language of a file by its last extension, or unknown; a file named .env is env."""
    name = posixpath.basename(path.replace("\\", "/")).lower()
    return BY_EXTENSION.get(name.rpartition(".")[2], UNKNOWN) if "." in name else UNKNOWN


def claims(extension: str) -> list[str]:
    """All languages that claim an extension."""
    return [name for name, (extensions, _) in LANGUAGES.items() if extension.lower() in extensions]


def supports_data_mode(language: str) -> bool:
    return canonical(language) in DATA_DEFAULT


def default_mode(language: str) -> str:
    return "data" if canonical(language) in DATA_DEFAULT else "structure"


def languages_table(spark):
    """language, extensions, aliases, default_mode, data_tree, renders: one row per language."""
    rows = [(n, list(e), list(a), default_mode(n), supports_data_mode(n), n in ("json", "yaml", "csharp")) for n, (e, a) in LANGUAGES.items()]
    return spark.createDataFrame(rows, "language string, extensions array<string>, aliases array<string>, default_mode string, data_tree boolean, renders boolean")
