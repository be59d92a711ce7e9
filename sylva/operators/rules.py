"""Rules: an expression, where it applies, and what a match of it says."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.xpath import normalized
from ..sources.globs import in_scope
from ..sources.languages import canonical

SEVERITIES = ("fatal", "error", "warning", "info")


@dataclass(frozen=True)
class Rule:
    xpath: str
    id: str | None = None
    reason: str | None = None
    severity: str = "error"
    message: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    language: str | None = None
    tree_mode: str | None = None
    valid: tuple[str, ...] = ()
    invalid: tuple[str, ...] = ()
    normalize: bool = True
    #: Only the fixed list of beginnings keeps an expression from being looked for below any node.
    strict: bool = False
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {', '.join(SEVERITIES)}")

    @property
    def expression(self) -> str:
        return normalized(self.xpath, self.strict) if self.normalize else self.xpath

    @property
    def said(self) -> str:
        """The reason, or the default one."""
        return self.reason or (f"[{self.id}] check failed" if self.id else "check failed")

    def applies(self, path: Column, language: Column) -> Column:
        test = in_scope(path, self.include, self.exclude)
        return test & (language == canonical(self.language)) if self.language else test


def applicable(rules: Sequence[Rule], path: Column, language: Column) -> Column:
    """Indexes of the rules that apply to a source: decided before a document is parsed."""
    marks = F.array(*[F.when(r.applies(path, language), F.lit(k)) for k, r in enumerate(rules)])
    return F.filter(marks, lambda x: x.isNotNull())
