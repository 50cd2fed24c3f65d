"""Lenient parsing of text cells: null-like values, numbers, dates in many layouts, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value", in lower case: fixed values.
NULLISH = ("", "na", "n/a", "null", "none", "nan", "-", "--")

#: Date layouts in order of priority, month first before day first: fixed values. The patterns take one or two digits.
DATE_LAYOUTS = (
    "y-M-d H:m:s", "y-M-d H:m", "y-M-d'T'H:m:s", "y-M-d",
    "y/M/d H:m:s", "y/M/d",
    "M/d/y H:m:s", "M/d/y H:m", "M/d/y",
    "d/M/y H:m:s", "d/M/y",
    "d-MMM-y H:m:s", "d-MMM-y H:m", "d-MMM-y",
    "MMM d, y", "d MMMM y",
)


def trimmed(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c.cast("string"), F.lit(" \t\n\x0b\f\r"))


def is_nullish(c: Column) -> Column:
    return c.isNull() | F.lower(trimmed(c)).isin(*NULLISH)


def as_number(c: Column) -> Column:
    """A double, or null if the cell is null-like or no number; commas, $ and % are ignored."""
    s = trimmed(F.translate(trimmed(c), ",$%", ""))
    digits = r"\d+(_\d+)*"
    number = s.rlike(rf"\A[+-]?({digits}\.?({digits})?|\.{digits})([eE][+-]?{digits})?\z")
    infinite = F.lower(s).rlike(r"\A[+-]?inf(inity)?\z")
    value = F.when(number, F.regexp_replace(s, "_", "").try_cast("double"))
    value = value.when(infinite, F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.when(~is_nullish(c), value)


def _shape(layout: str) -> str:
    """What texts of a layout look like; parsing is tried only where they do, since a failed attempt is dear."""
    parts = re.findall(r"'[^']*'|MMMM|MMM|[yMdHms]|[^yMdHms']", layout)
    return r"\A" + "".join({"MMMM": r"[A-Za-z]+", "MMM": r"[A-Za-z]{3}", "y": r"\d+"}.get(p, r"\d{1,2}" if p in "MdHms" else re.escape(p.strip("'"))) for p in parts) + r"\z"


def as_datetime(c: Column) -> Column:
    """A timestamp, or null; the first layout that fits decides, then any ISO form."""
    s = trimmed(c)

    def first(timed: bool, sign: str):  # a text with such signs fits no other layouts
        fits = [p for p in DATE_LAYOUTS if (":" in p) == timed and next((x for x in "/-" if x in p), "") == sign]
        return F.coalesce(*[F.when(s.rlike(_shape(p)), F.try_to_timestamp(s, F.lit(p))) for p in fits]) if fits else F.lit(None).cast("timestamp")

    def of(timed: bool):
        return F.when(F.contains(s, F.lit("/")), first(timed, "/")).when(F.contains(s, F.lit("-")), first(timed, "-")).otherwise(first(timed, ""))

    laid_out = F.when(F.contains(s, F.lit(":")), of(True)).otherwise(of(False))
    return F.when(~is_nullish(c), F.coalesce(laid_out, F.when(s.rlike(r"\A\d{4}-"), s.try_cast("timestamp"))))


def full_match(c: Column, pattern: str) -> Column:
    """Whether the whole text matches; Python-only syntax is refused rather than read differently by Java."""
    if re.search(r"\(\?P[<=]|\(\?\(", pattern):
        raise ValueError(f"pattern uses syntax that the engine reads differently: {pattern}")
    return c.rlike(rf"\A(?:{pattern})\z")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), r"\s+", " ")


def title_case(c: Column) -> Column:
    """Upper case after anything that is no letter, lower case elsewhere; built-in initcap looks at spaces only."""
    marked = F.regexp_replace(F.lower(c), r"(?<![\p{L}])(\p{L})", "\u0000$1")
    parts = F.split(marked, "\u0000")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)), "")


def first_match(c: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The label of the first rule of which a keyword is in the text, without regard to case."""
    low, out = F.lower(c), None
    for label, words in rules:
        hit = None
        for w in words:
            hit = low.contains(w.lower()) if hit is None else hit | low.contains(w.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def year_month(c: Column) -> Column:
    """The text if it is a month such as 2024-03, else null."""
    return F.when(c.rlike(r"\A[0-9]{4}-(?:0[1-9]|1[0-2])\z"), c)
