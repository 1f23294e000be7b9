"""Tokens of the pattern query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Reserved words, matched in any case. Fixed values.
KEYWORDS = frozenset(
    """ALL AND AS ASC BY CALL CASE CONSTRAINT CONTAINS CREATE DELETE DESC DETACH DISTINCT DROP ELSE END ENDS FALSE
    FOREACH IN IS LIMIT MANDATORY MATCH MERGE NOT NULL OPTIONAL OR ORDER REMOVE RETURN SET SKIP STARTS THEN TRUE UNION
    UNWIND WHEN WHERE WITH XOR YIELD""".split()
)


class QueryError(ValueError):
    """The query can't be read or compiled."""


class UnsupportedFeatureError(QueryError):
    """The query uses a clause that a read-only engine doesn't have."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name, string, number, sign or end
    text: str
    at: int


_SCAN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/|--(?![>\[])[^\n]*)
    |(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
    |(?P<number>\d+(?:\.(?!\.)\d*)?|\.(?!\.)\d+)
    |(?P<name>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<tick>`[^`]+`)
    |(?P<sign><>|!=|<=|>=|=~|\.\.|[-<>=()\[\]{},.:|*+])""",
    re.VERBOSE | re.DOTALL,
)

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def tokens(query: str) -> list[Token]:
    """Comments and characters that begin no token are skipped. `--` opens a comment
    up to the end of the line, except as the edge `-->`."""
    out, at = [], 0
    while at < len(query):
        m = _SCAN.match(query, at)
        if m is None:
            if query[at] in "'\"":
                raise QueryError(f"the string at {at} has no end")
            at += 1
            continue
        kind, text = m.lastgroup, m.group()
        if kind == "string":
            text = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.DOTALL)
        elif kind == "tick":
            kind, text = "name", text[1:-1]
        elif kind == "name" and text.upper() in KEYWORDS:
            kind = "word"
        if kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    out.append(Token("end", "", len(query)))
    return out
