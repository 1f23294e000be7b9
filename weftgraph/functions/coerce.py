"""Comparisons on text that may hold numbers; there is no null, only empty text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"

NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def number(c: Column, kind: str = "string") -> Column:
    """The number with which the text begins, else 0."""
    if is_numeric(kind):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    return F.coalesce(F.regexp_extract(c.cast("string"), _NUMBER, 1).try_cast("double"), F.lit(0.0))


def literal_number(value: str) -> float:
    m = re.match(_NUMBER, value)
    return float(m[1]) if m else 0.0


#: POSIX bracket classes and what Java calls them. Fixed values.
POSIX = {
    "[:alnum:]": r"\p{Alnum}",
    "[:alpha:]": r"\p{Alpha}",
    "[:blank:]": r"\p{Blank}",
    "[:cntrl:]": r"\p{Cntrl}",
    "[:digit:]": r"\p{Digit}",
    "[:graph:]": r"\p{Graph}",
    "[:lower:]": r"\p{Lower}",
    "[:print:]": r"\p{Print}",
    "[:punct:]": r"\p{Punct}",
    "[:space:]": r"\s",
    "[:upper:]": r"\p{Upper}",
    "[:xdigit:]": r"\p{XDigit}",
}


def java_pattern(pattern: str) -> str | None:
    """The pattern for rlike, or None if it can't be compiled."""
    for posix, java in POSIX.items():
        pattern = pattern.replace(posix, java)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except Exception:
        return None
    return pattern


def regex(c: Column, pattern: str) -> Column:
    """Unanchored search; false for a pattern that can't be compiled."""
    compiled = java_pattern(pattern)
    return F.lit(False) if compiled is None else c.cast("string").rlike(compiled)


def looks_like_regex(value: str) -> bool:
    return bool(re.search(r"\.\*|\.\+|[\[(|^$]", value))


def literal_hints(pattern: str) -> list[str]:
    """Runs of at least three plain characters that every match contains."""
    if "|" in pattern or "(?" in pattern:
        return []
    plain = re.sub(r"\\[A-Za-z0-9]|\[[^\]]*\]|\([^)]*\)[*?]?|.[*?{]", "\0", pattern)
    plain = re.sub(r"\\(.)", r"\1", plain)
    return [x for x in re.split(r"[\0.^$+*?(){}\[\]]+", plain) if len(x) >= 3]


def with_case_flag(pattern: str) -> str:
    return pattern if pattern.startswith("(?i)") else "(?i)" + pattern


def without_case_flag(pattern: str) -> str:
    return pattern.removeprefix("(?i)")


def glob_to_like(glob: str) -> str:
    """** matches anything and takes the slashes beside it, * and ? as usual."""
    glob = re.sub(r"/?\*\*/?", "\0", glob)
    # a double star in front keeps its own sign before a single one
    return glob.replace("*", "%").replace("?", "_").replace("\0", "%")


def compare(c: Column, kind: str, op: str, right) -> Column:
    """One comparison of a property with a literal; null where the property is null,
    which counts as false. kind: the property's type."""
    if op == "NULL":
        return c.isNull() | (c.cast("string") == "")
    if op in ("<", ">", "<=", ">="):
        left, value = number(c, kind), literal_number(right)
        if is_numeric(kind) and (value > 0 if op in (">", ">=") else False):
            left = c  # null is below it: the bare column can be pushed to the scan
        return {"<": left < value, ">": left > value, "<=": left <= value, ">=": left >= value}[op]
    if op == "IN":
        return text(c).isin(*right) if "" in right or is_numeric(kind) else c.cast("string").isin(*right)
    if op == "=":
        if is_numeric(kind) and kind in ("int", "bigint") and re.fullmatch(r"-?(0|[1-9][0-9]{0,17})", right):
            return c.eqNullSafe(F.lit(int(right)))
        return text(c) == "" if right == "" else c.cast("string").eqNullSafe(F.lit(right))
    if op == "<>":
        return ~compare(c, kind, "=", right)
    s = c.cast("string")
    if op == "CONTAINS":
        return s.contains(right)
    if op == "STARTS":
        return s.startswith(right)
    if op == "ENDS":
        return s.endswith(right)
    if op == "=~":
        return regex(c, right)
    raise ValueError(op)
