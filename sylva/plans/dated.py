"""Dates, times and durations of expressions as Catalyst types: date, timestamp without zone, day-time and year-month intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE, MOMENT, SPAN, MONTHS = T.DateType(), T.TimestampNTZType(), T.DayTimeIntervalType(), T.YearMonthIntervalType()
_CLASSES = (T.DateType, T.TimestampNTZType, T.TimestampType, T.DayTimeIntervalType, T.YearMonthIntervalType)
_SPAN = r"^(-?)P(?=[0-9T])(?:([0-9]+)D)?(?:T(?=[0-9])(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:[.][0-9]+)?)S)?)?$"
_MONTHS = r"^(-?)P(?=[0-9])(?:([0-9]+)Y)?(?:([0-9]+)M)?$"
#: Components of a picture as the letters of Spark's patterns (fixed values).
LETTERS = {"Y": "y", "M": "M", "D": "d", "d": "D", "H": "H", "h": "h", "m": "m", "s": "s", "f": "S", "P": "a", "F": "E"}
#: Functions that read a part, and what it is called.
PARTS = {f"{plural}-from-dateTime": word for plural, word in (("year", "YEAR"), ("month", "MONTH"), ("day", "DAY"), ("hours", "HOUR"), ("minutes", "MINUTE"), ("seconds", "SECOND"))}
PARTS |= {f"{x}-from-date": x.upper() for x in ("year", "month", "day")}
PARTS |= {f"{plural}-from-duration": word for plural, word in (("days", "DAY"), ("hours", "HOUR"), ("minutes", "MINUTE"), ("seconds", "SECOND"), ("years", "YEAR"), ("months", "MONTH"))}
CASTS = ("date", "dateTime", "dayTimeDuration", "yearMonthDuration")


def is_dated(kind: T.DataType) -> bool:
    return isinstance(kind, _CLASSES)


def is_span(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DayTimeIntervalType, T.YearMonthIntervalType))


def cast(name: str, c: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """A value as a date, time or duration; null if its text is none."""
    if name == "date":
        if is_dated(kind):
            return c.cast("date"), DATE
        text = F.trim(c.cast("string"))
        return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date")), DATE
    if name == "dateTime":
        if is_dated(kind):
            return c.cast("timestamp_ntz"), MOMENT
        text = F.trim(c.cast("string"))
        return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?$"), text.try_cast("timestamp_ntz")), MOMENT
    if is_span(kind):
        return c, kind
    text = F.trim(c.cast("string"))
    part = lambda pattern, k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit("0"))
    if name == "dayTimeDuration":
        made = F.make_dt_interval(part(_SPAN, 2).cast("int"), part(_SPAN, 3).cast("int"), part(_SPAN, 4).cast("int"), part(_SPAN, 5).cast("decimal(18,6)"))
        return F.when(text.rlike(_SPAN), made * F.when(text.startswith("-"), -1).otherwise(1)), SPAN
    made = F.make_ym_interval(part(_MONTHS, 2).cast("int"), part(_MONTHS, 3).cast("int"))
    return F.when(text.rlike(_MONTHS), made * F.when(text.startswith("-"), -1).otherwise(1)), MONTHS


def combined(op: str, a: Column, ka: T.DataType, b: Column, kb: T.DataType) -> tuple[Column, T.DataType] | None:
    """a op b where one is a date, time or duration; nothing if they don't combine."""
    if op not in ("+", "-", "*", "div"):
        return None
    if not is_span(ka) and is_span(kb) and op in ("+", "-") and is_dated(ka):
        moved = a.cast("timestamp_ntz") + b if op == "+" else a.cast("timestamp_ntz") - b
        return (moved.cast("date"), DATE) if isinstance(ka, T.DateType) else (moved, MOMENT)
    if is_span(ka) and not is_span(kb) and op == "+" and is_dated(kb):
        return combined(op, b, kb, a, ka)
    if op == "-" and is_dated(ka) and is_dated(kb) and not is_span(ka) and not is_span(kb):
        return a.cast("timestamp_ntz") - b.cast("timestamp_ntz"), SPAN
    if is_span(ka) and type(ka) is type(kb) and op in ("+", "-"):
        return (a + b if op == "+" else a - b), ka
    if is_span(ka) and isinstance(kb, T.NumericType) and op in ("*", "div"):
        return (a * b if op == "*" else a / F.nullif(b.cast("double"), F.lit(0.0))), ka
    if op == "*" and isinstance(ka, T.NumericType) and is_span(kb):
        return b * a, kb
    return None


def part(name: str, c: Column, kind: T.DataType) -> Column | None:
    """A part of a value: whole but for seconds; 0 for a part that the kind of duration has not."""
    word = PARTS[name]
    if name.endswith("duration"):
        if not is_span(kind):
            return None
        if isinstance(kind, T.YearMonthIntervalType) != (word in ("YEAR", "MONTH")):
            return F.when(c.isNotNull(), F.lit(0)).cast("long")
    elif is_span(kind) or not is_dated(kind):
        return None
    value = F.date_part(F.lit(word), c)
    return value.cast("double") if word == "SECOND" else value.cast("long")


def pattern(picture: str) -> str | None:
    """Spark's pattern for a picture; nothing if it has components that Spark has not."""
    out = []
    for literal, component in re.findall(r"((?:[^\[\]]|\[\[|\]\])+)|\[([^\]]*)\]", picture):
        if literal:
            out.append("'" + literal.replace("[[", "[").replace("]]", "]").replace("'", "''") + "'")
            continue
        m = re.fullmatch(r"([YMDdHhmsfPF])(0*1|[Nn]+|)(?:,[0-9*]+(?:-[0-9*]+)?)?", component.strip())
        if m is None:
            return None
        letter, form = LETTERS[m.group(1)], m.group(2)
        if m.group(1) in ("F",) or form[:1] in ("N", "n"):
            if form not in ("Nn", "") or m.group(1) not in ("M", "F"):
                return None
            out.append(letter * 4)
        elif m.group(1) in ("m", "s") and not form:
            out.append(letter * 2)
        else:
            out.append(letter * max(1, len(form)))
    return "".join(out)


def text(c: Column, kind: T.DataType) -> Column:
    """A value as XPath writes it."""
    if isinstance(kind, T.DateType):
        return c.cast("string")
    if not is_span(kind):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(?:[.]|([.][0-9]*[1-9]))0+$", "$1")
    if isinstance(kind, T.YearMonthIntervalType):
        months = F.date_part(F.lit("YEAR"), c) * 12 + F.date_part(F.lit("MONTH"), c)
        size = F.abs(months)
        years, rest = F.floor(size / 12), size % 12
        body = F.concat(F.when(years > 0, F.concat(years.cast("string"), F.lit("Y"))).otherwise(""), F.when((rest > 0) | (size == 0), F.concat(rest.cast("string"), F.lit("M"))).otherwise(""))
        return F.concat(F.when(months < 0, "-").otherwise(""), F.lit("P"), body)
    d, h, m = (F.abs(F.date_part(F.lit(w), c)).cast("long") for w in ("DAY", "HOUR", "MINUTE"))
    s = F.abs(F.date_part(F.lit("SECOND"), c)).cast("decimal(8,6)")
    negative = c < F.make_dt_interval(F.lit(0))
    shown = F.regexp_replace(s.cast("string"), r"(?:[.]|([.][0-9]*[1-9]))0+$", "$1")
    clock = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""), F.when(s > 0, F.concat(shown, F.lit("S"))).otherwise(""))
    body = F.concat(F.when(d > 0, F.concat(d.cast("string"), F.lit("D"))).otherwise(""), F.when(clock != "", F.concat(F.lit("T"), clock)).when(d == 0, F.lit("T0S")).otherwise(""))
    return F.concat(F.when(negative, "-").otherwise(""), F.lit("P"), body)
