"""Decision records: text in sections under known headings."""

from __future__ import annotations

import re

#: Headings in their order, and the most characters of a record. Fixed values.
SECTIONS = ("PURPOSE", "STACK", "ARCHITECTURE", "PATTERNS", "TRADEOFFS", "PHILOSOPHY")
MOST_CHARS = 8000


def parse_sections(text: str) -> dict[str, str]:
    """Section by heading; text before the first heading is left out, and so are unknown
    headings, whose text stays with the section they stand in."""
    out: dict[str, list[str]] = {}
    now = None
    for line in text.splitlines():
        m = re.match(r"##\s+(\w+)\s*$", line)
        if m and m[1].upper() in SECTIONS:
            now = out.setdefault(m[1].upper(), [])
        elif now is not None:
            now.append(line)
    return {k: "\n".join(v).strip() for k, v in out.items()}


def render_sections(sections: dict[str, str]) -> str:
    return "\n\n".join(f"## {k}\n{sections[k]}" for k in SECTIONS if k in sections)


def validate(text: str) -> list[str]:
    """What is wrong with a record."""
    missing = [s for s in SECTIONS if s not in parse_sections(text)]
    return [f"missing section {s}" for s in missing] + ([f"longer than {MOST_CHARS} characters"] if len(text) > MOST_CHARS else [])


def update_sections(text: str, update: dict[str, str]) -> str:
    if unknown := sorted(k for k in update if k.upper() not in SECTIONS):
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    out = render_sections(parse_sections(text) | {k.upper(): v for k, v in update.items()})
    if len(out) > MOST_CHARS:
        raise ValueError(f"longer than {MOST_CHARS} characters")
    return out
