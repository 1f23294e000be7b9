"""Recursive descent over the tokens to a tree of dataclasses.

    query   := part (UNION [ALL] part)*
    part    := (UNWIND list AS v | [OPTIONAL] MATCH pattern [WHERE e] |
               WITH items [ORDER BY ..] [SKIP n] [LIMIT n] [WHERE e])* [RETURN items ..]
    pattern := node (relationship node)* (, node (relationship node)*)*
    e       := OR < XOR < AND < NOT < comparison
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .lexer import QueryError, Token, UnsupportedFeatureError, tokens

#: Clauses that change data or call procedures. Fixed values.
UNSUPPORTED = ("CREATE", "DELETE", "DETACH", "SET", "REMOVE", "MERGE", "YIELD", "CALL", "FOREACH", "MANDATORY", "DROP", "CONSTRAINT")

AGGREGATES = frozenset(("COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT"))
STRING_FUNCTIONS = frozenset(("TOLOWER", "TOUPPER", "TOSTRING"))


@dataclass
class NodePattern:
    name: str | None
    label: str | None
    props: dict[str, str] = field(default_factory=dict)


@dataclass
class RelPattern:
    name: str | None
    types: list[str]
    direction: str  # out, in or any
    hops: tuple[int, int | None] | None = None  # None: one edge


@dataclass
class Path:
    nodes: list[NodePattern]
    rels: list[RelPattern]


@dataclass
class Value:
    """A variable, or a property of one."""

    name: str
    prop: str | None = None


@dataclass
class Comparison:
    left: Value
    op: str  # = <> =~ < > <= >= CONTAINS STARTS ENDS IN NULL
    right: Any


@dataclass
class Logic:
    op: str  # AND OR XOR NOT
    parts: list[Any]


@dataclass
class Case:
    branches: list[tuple[Any, str]]
    otherwise: str | None


@dataclass
class Item:
    value: Value | Case | None  # None: *
    func: str | None = None
    distinct: bool = False
    alias: str | None = None

    @property
    def title(self) -> str:
        if self.alias:
            return self.alias
        if self.func:
            return f"{self.func}({self.value.name if self.value else '*'})"
        if isinstance(self.value, Case):
            return "CASE"
        return self.value.name + (f".{self.value.prop}" if self.value.prop else "")


@dataclass
class Projection:
    items: list[Item] | None  # None: *
    distinct: bool = False
    order: list[tuple[Item, bool]] = field(default_factory=list)  # descending?
    skip: int = 0
    limit: int | None = None


@dataclass
class Match:
    paths: list[Path]
    optional: bool
    where: Any = None


@dataclass
class With:
    projection: Projection
    where: Any = None


@dataclass
class Unwind:
    values: list[str] | Value
    name: str


@dataclass
class Part:
    clauses: list[Match | With | Unwind]
    returns: Projection | None


@dataclass
class Query:
    parts: list[Part]
    keep_all: bool = True  # UNION ALL


class _Parser:
    def __init__(self, query: str):
        self.tokens, self.i = tokens(query), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def word(self, *words: str) -> bool:
        ahead = self.tokens[self.i : self.i + len(words)]
        if len(ahead) == len(words) and all(t.kind == "word" and t.text.upper() == w for t, w in zip(ahead, words, strict=True)):
            self.i += len(words)
            return True
        return False

    def sign(self, text: str) -> bool:
        if self.now.kind == "sign" and self.now.text == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.sign(text):
            raise QueryError(f"expected {text!r} at {self.now.at}, found {self.now.text!r}")

    def need_word(self, text: str) -> None:
        if not self.word(text):
            raise QueryError(f"expected {text} at {self.now.at}, found {self.now.text!r}")

    def name(self) -> str:
        t = self.now
        if t.kind not in ("name", "word"):
            raise QueryError(f"expected a name at {t.at}, found {t.text!r}")
        self.i += 1
        return t.text

    def integer(self) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            raise QueryError(f"expected a whole number at {self.now.at}")
        self.i += 1
        return int(self.tokens[self.i - 1].text)

    def literal(self) -> str:
        t = self.now
        negative = self.sign("-")
        t = self.now
        if t.kind == "number" or (not negative and (t.kind == "string" or (t.kind == "word" and t.text.upper() in ("TRUE", "FALSE")))):
            self.i += 1
            return "-" * negative + (t.text.lower() if t.kind == "word" else t.text)
        raise QueryError(f"expected a literal at {t.at}, found {t.text!r}")

    # patterns

    def node(self) -> NodePattern:
        self.need("(")
        name = self.name() if self.now.kind == "name" else None
        label = self.name() if self.sign(":") else None
        props = {}
        if self.sign("{"):
            while not self.sign("}"):
                key = self.name()
                self.need(":")
                props[key] = self.literal()
                self.sign(",")
        self.need(")")
        return NodePattern(name, label, props)

    def relationship(self) -> RelPattern:
        left = self.sign("<")
        self.need("-")
        name, types, hops = None, [], None
        if self.sign("["):
            if self.now.kind == "name":
                name = self.name()
            if self.sign(":"):
                types.append(self.name())
                while self.sign("|"):
                    self.sign(":")
                    types.append(self.name())
            if self.sign("*"):
                low = self.integer() if self.now.kind == "number" else None
                if self.sign(".."):
                    hops = (1 if low is None else low, self.integer() if self.now.kind == "number" else None)
                else:
                    hops = (1, low)
            self.need("]")
        self.need("-")
        right = self.sign(">")
        return RelPattern(name, types, "any" if left == right else "out" if right else "in", hops)

    def path(self) -> Path:
        nodes, rels = [self.node()], []
        while self.now.kind == "sign" and self.now.text in ("-", "<"):
            rels.append(self.relationship())
            nodes.append(self.node())
        return Path(nodes, rels)

    # expressions

    def value(self) -> Value:
        name = self.name()
        return Value(name, self.name() if self.sign(".") else None)

    def either(self) -> Any:
        parts = [self.exclusive()]
        while self.word("OR"):
            parts.append(self.exclusive())
        return parts[0] if len(parts) == 1 else Logic("OR", parts)

    def exclusive(self) -> Any:
        left = self.both()
        while self.word("XOR"):
            left = Logic("XOR", [left, self.both()])
        return left

    def both(self) -> Any:
        parts = [self.negation()]
        while self.word("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Logic("AND", parts)

    def negation(self) -> Any:
        if self.word("NOT"):
            return Logic("NOT", [self.negation()])
        if self.sign("("):
            inner = self.either()
            self.need(")")
            return inner
        return self.comparison()

    def comparison(self) -> Any:
        left = self.value()
        for op in ("=~", "<>", "!=", "<=", ">=", "=", "<", ">"):
            if self.sign(op):
                return Comparison(left, "<>" if op == "!=" else op, self.literal())
        if self.word("CONTAINS"):
            return Comparison(left, "CONTAINS", self.literal())
        if self.word("STARTS", "WITH"):
            return Comparison(left, "STARTS", self.literal())
        if self.word("ENDS", "WITH"):
            return Comparison(left, "ENDS", self.literal())
        if self.word("IN"):
            return Comparison(left, "IN", self.literals())
        if self.word("IS", "NOT", "NULL"):
            return Logic("NOT", [Comparison(left, "NULL", None)])
        if self.word("IS", "NULL"):
            return Comparison(left, "NULL", None)
        raise QueryError(f"expected an operator at {self.now.at}, found {self.now.text!r}")

    def literals(self) -> list[str]:
        self.need("[")
        out = []
        while not self.sign("]"):
            out.append(self.literal())
            self.sign(",")
        return out

    def case(self) -> Case:
        branches, otherwise = [], None
        while self.word("WHEN"):
            condition = self.either()
            self.need_word("THEN")
            branches.append((condition, self.outcome()))
        if self.word("ELSE"):
            otherwise = self.outcome()
        self.need_word("END")
        return Case(branches, otherwise)

    def outcome(self) -> str:
        """A literal; what looks like a property is its own text."""
        if self.now.kind == "name":
            v = self.value()
            return v.name + (f".{v.prop}" if v.prop else "")
        return self.literal()

    # projections

    def item(self) -> Item:
        if self.word("CASE"):
            item = Item(self.case())
        else:
            name, after = self.now.text, self.tokens[self.i + 1]
            if name.upper() in AGGREGATES | STRING_FUNCTIONS and after.kind == "sign" and after.text == "(":
                self.i += 2
                func, distinct = name.upper() if name.upper() in AGGREGATES else name, False
                if self.sign("*"):
                    item = Item(None, func)
                else:
                    distinct = self.word("DISTINCT")
                    item = Item(self.value(), func, distinct)
                self.need(")")
            else:
                item = Item(self.value())
        if self.word("AS"):
            item.alias = self.name()
        return item

    def projection(self) -> Projection:
        p = Projection([], self.word("DISTINCT"))
        if self.sign("*"):
            p.items = None
        else:
            p.items.append(self.item())
            while self.sign(","):
                p.items.append(self.item())
        if self.word("ORDER", "BY"):
            while True:
                key = self.item()
                descending = self.word("DESC")
                if not descending:
                    self.word("ASC")
                p.order.append((key, descending))
                if not self.sign(","):
                    break
        if self.word("SKIP"):
            p.skip = self.integer()
        if self.word("LIMIT"):
            p.limit = self.integer()
        return p

    def part(self) -> Part:
        clauses: list[Match | With | Unwind] = []
        while True:
            t = self.now
            if t.kind == "word" and t.text.upper() in UNSUPPORTED:
                raise UnsupportedFeatureError(f"unsupported clause: {t.text.upper()}")
            if self.word("UNWIND"):
                values = self.literals() if self.now.text == "[" else self.value()
                self.need_word("AS")
                clauses.append(Unwind(values, self.name()))
            elif self.word("OPTIONAL", "MATCH") or self.word("MATCH"):
                optional = self.tokens[self.i - 2].text.upper() == "OPTIONAL" if self.i > 1 else False
                paths = [self.path()]
                while self.sign(","):
                    paths.append(self.path())
                clauses.append(Match(paths, optional, self.either() if self.word("WHERE") else None))
            elif self.word("WITH"):
                p = self.projection()
                clauses.append(With(p, self.either() if self.word("WHERE") else None))
            elif clauses and self.word("WHERE"):
                last = clauses[-1]
                extra = self.either()
                last.where = extra if last.where is None else Logic("AND", [last.where, extra])
            else:
                break
        if not clauses:
            raise QueryError(f"expected MATCH, found {self.now.text!r}")
        return Part(clauses, self.projection() if self.word("RETURN") else None)

    def query(self) -> Query:
        out = Query([self.part()])
        while self.word("UNION"):
            keep_all = self.word("ALL")
            if len(out.parts) == 1:
                out.keep_all = keep_all  # the first UNION decides for the chain
            out.parts.append(self.part())
        t = self.now
        if t.kind == "word" and t.text.upper() in UNSUPPORTED:
            raise UnsupportedFeatureError(f"unsupported clause: {t.text.upper()}")
        return out


def parse(query: str) -> Query:
    return _Parser(query).query()
