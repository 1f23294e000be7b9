"""From the tree of a query to one DataFrame plan.

A row holds the variables bound so far: the columns of node variable v are named
v#column. Which of them the query uses, the optimizer finds out; predicates are
filters and reach the scans of the variables they name.

Meaning is the documented one throughout: a variable that occurs again must be
the same node, OPTIONAL MATCH keeps a row when the whole pattern has no match,
DISTINCT comes before SKIP and LIMIT, a WHERE sees all variables of its clause,
and string functions beside aggregates are grouping keys. There is no null in
predicates: a missing property is empty text.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..graph import Graph
from ..lineage import deal, many
from ..operators import reach
from .lexer import QueryError
from .parser import AGGREGATES, Case, Comparison, Item, Logic, Match, NodePattern, Part, Path, Projection, Query, Unwind, Value, With, parse

#: Properties that count a node's CALLS edges.
DEGREES = {"in_degree": "dst", "out_degree": "src"}

CALLS = "CALLS"


@dataclass
class _Rows:
    df: DataFrame | None
    kinds: dict[str, str] = field(default_factory=dict)  # of each variable: node, edge or value

    def columns(self, name: str) -> list[str]:
        return [c for c in self.df.columns if c.startswith(f"{name}#")]


def _renamed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{name}#{c}") for c in df.columns])


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _or_null(df: DataFrame) -> DataFrame:
    """df, or one row of nulls where it is empty: the right side of an outer join without a
    key, which is then an inner one that no side has to be broadcast for."""
    some = df.limit(1).select(F.lit(1).alias("~some"))
    none = df.sparkSession.range(1).join(some, F.lit(True), "left_anti")  # against one row at most
    return df.unionByName(none.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))


@dataclass
class _Step:
    """A relationship between two variables."""

    here: str
    rel: Any
    there: str


_BACK = {"out": "in", "in": "out", "any": "any"}


#: In counted rows, for how many equal rows each stands.
TIMES = "~n"


class Compiler:
    def __init__(self, graph: Graph):
        self.graph = graph
        self.fresh = 0
        self.counted: set[str] | None = None  # variables that a part which only counts its matches still asks for

    def name(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    # values

    def value(self, rows: _Rows, v: Value) -> tuple[Column, str]:
        """The column of a variable or property, and its type."""
        kind = rows.kinds.get(v.name)
        if kind is None:
            raise QueryError(f"variable {v.name} isn't bound")
        types = dict(rows.df.dtypes)
        if kind == "value":
            column = f"{v.name}#"
        elif v.prop is None:
            column = f"{v.name}#name" if kind == "node" else f"{v.name}#properties"
        else:
            column = f"{v.name}#{v.prop}"
        if column in types:
            return _c(column), types[column]
        if kind == "value":
            raise QueryError(f"{v.name} has no properties")
        if f"{v.name}#properties" in types:
            key = v.prop.replace("'", "\\'")
            return F.get_json_object(_c(f"{v.name}#properties"), f"$['{key}']"), "string"
        return F.lit(None).cast("string"), "string"

    def predicate(self, rows: _Rows, e: Any, negated: bool = False) -> Column:
        """Under a negation nothing may be null; elsewhere null is as good as false."""
        if isinstance(e, Logic):
            if e.op == "NOT":
                return ~self.predicate(rows, e.parts[0], True)
            parts = [self.predicate(rows, p, negated or e.op == "XOR") for p in e.parts]
            if e.op == "XOR":
                return parts[0] != parts[1]
            return reduce((lambda a, b: a & b) if e.op == "AND" else (lambda a, b: a | b), parts)
        c, kind = self.value(rows, e.left)
        if e.op == "=~":
            hinted = [c.cast("string").contains(h) for h in coerce.literal_hints(e.right)]
            out = reduce(lambda a, b: a & b, [*hinted, coerce.compare(c, kind, e.op, e.right)])
        else:
            out = coerce.compare(c, kind, e.op, e.right)
        return F.coalesce(out, F.lit(False)) if negated else out

    def filtered(self, rows: _Rows, e: Any) -> _Rows:
        if e is None:
            return rows
        rows = self.with_degrees(rows, e)
        return replace(rows, df=rows.df.where(self.predicate(rows, e)))

    def with_degrees(self, rows: _Rows, *parts: Any) -> _Rows:
        """Joins the degrees that the parts name."""
        for v in _values(parts):
            if v.prop in DEGREES and rows.kinds.get(v.name) == "node" and f"{v.name}#{v.prop}" not in rows.df.columns:
                end = DEGREES[v.prop]
                counts = self.graph.scan_edges([CALLS]).groupBy(F.col(end).alias("_end")).agg(F.count(F.lit(1)).alias("_n"))
                joined = rows.df.join(counts, _c(f"{v.name}#id") == F.col("_end"), "left")
                rows = replace(rows, df=joined.withColumn(f"{v.name}#{v.prop}", F.coalesce("_n", F.lit(0))).drop("_end", "_n"))
        return rows

    # patterns

    def scan(self, pattern: NodePattern, name: str) -> DataFrame:
        df = _renamed(self.graph.scan(pattern.label), name)
        rows = _Rows(df, {name: "node"})
        for key, value in pattern.props.items():
            op = "=~" if coerce.looks_like_regex(value) else "="
            rows = self.filtered(rows, Comparison(Value(name, key), op, value))
        return rows.df

    def bind(self, rows: _Rows, pattern: NodePattern, name: str, used: bool, certain: bool) -> _Rows:
        """Joins the node whose id is in name#id, unless only its id is needed and its
        label is certain."""
        kinds = rows.kinds | {name: "node"}
        if self.graph.whole and certain and not used and not pattern.props:
            return _Rows(rows.df, kinds)
        found = self.scan(pattern, name).withColumnRenamed(f"{name}#id", "_id")
        joined = rows.df.join(found, _c(f"{name}#id") == F.col("_id")).drop("_id")
        return _Rows(joined, kinds)

    def path(self, rows: _Rows, path: Path, used: set[str]) -> _Rows:
        names = [n.name or self.name() for n in path.nodes]
        first = path.nodes[0]
        if names[0] in rows.kinds:
            rows = self.again(rows, first, names[0])
        else:
            found = self.scan(first, names[0])
            shared = rows.df is not None
            later = [n for n in names[1:] if n in rows.kinds]
            if shared and later:  # begin at a bound end, so that it joins by key
                return self.path(rows, _turned(path, names.index(later[0])), used) if _turns(path, names, later[0]) else self._cross(rows, found, path, names, used)
            rows = _Rows(rows.df.crossJoin(found) if shared else found, rows.kinds | {names[0]: "node"})
        return self.walk(rows, path, names, used)

    def _cross(self, rows: _Rows, found: DataFrame, path: Path, names: list[str], used: set[str]) -> _Rows:
        alone = self.walk(_Rows(found, {names[0]: "node"}), path, names, used | set(rows.kinds))
        return self.joined(rows, alone, "inner")

    def joined(self, left: _Rows, right: _Rows, how: str) -> _Rows:
        """By the variables that both have."""
        both = [n for n in right.kinds if n in left.kinds]
        if how == "left" and not both:
            return _Rows(left.df.crossJoin(_or_null(right.df)), left.kinds | right.kinds)
        twin = {c: f"~{c}" for n in both for c in right.columns(n)}
        df = right.df.withColumnsRenamed(twin)
        keys = [_c(f"{n}#id").eqNullSafe(_c(f"~{n}#id")) if right.kinds[n] != "value" else _c(f"{n}#").eqNullSafe(_c(f"~{n}#")) for n in both]
        condition = reduce(lambda a, b: a & b, keys) if keys else None
        out = left.df.crossJoin(df) if condition is None and how == "inner" else left.df.join(df, condition if condition is not None else F.lit(True), how)
        return _Rows(out.drop(*twin.values()), left.kinds | right.kinds)

    def again(self, rows: _Rows, pattern: NodePattern, name: str) -> _Rows:
        """A bound variable named again, maybe with a label or properties."""
        if rows.kinds[name] != "node":
            raise QueryError(f"{name} isn't a node")
        if pattern.label is not None and f"{name}#label" in rows.df.columns:
            rows = replace(rows, df=rows.df.where(_c(f"{name}#label") == pattern.label))
        for key, value in pattern.props.items():
            rows = self.filtered(rows, Comparison(Value(name, key), "=~" if coerce.looks_like_regex(value) else "=", value))
        return rows

    def walk(self, rows: _Rows, path: Path, names: list[str], used: set[str]) -> _Rows:
        for k, rel in enumerate(path.rels):
            here, there, pattern = names[k], names[k + 1], path.nodes[k + 1]
            bound = there in rows.kinds
            if bound and rel.hops is None:
                rows = self.again(self.closed(rows, rel, here, there), pattern, there)
                continue
            end = self.name() if bound else there
            if rel.hops is None:
                rows = self.step(rows, rel, here, end)
            else:
                rows = self.leap(rows, rel, here, end)
            if bound:
                rows = _Rows(rows.df.where(_c(f"{end}#id") == _c(f"{there}#id")).drop(f"{end}#id"), rows.kinds)
                rows = self.again(rows, pattern, there)
            else:
                certain = self.graph.certain(rel.types, rel.direction, pattern.label)
                rows = self.bind(rows, pattern, there, pattern.name in used, certain)
        return rows

    def edges(self, rows: _Rows, rel, end: str) -> tuple[DataFrame, dict[str, str]]:
        """Edges of a relationship with _from and end#id, and the variable it binds."""
        edges = self.graph.scan_edges(rel.types)
        name = rel.name or self.name()
        if name in rows.kinds:
            raise QueryError(f"relationship {name} is bound twice")
        as_is = _renamed(edges, name).withColumns({"_from": _c(f"{name}#src"), f"{end}#id": _c(f"{name}#dst")})
        turned = _renamed(edges, name).withColumns({"_from": _c(f"{name}#dst"), f"{end}#id": _c(f"{name}#src")})
        found = {"out": as_is, "in": turned}[rel.direction] if rel.direction != "any" else as_is.unionByName(turned)
        return (found, {rel.name: "edge"}) if rel.name else (found.select("_from", f"`{end}#id`"), {})

    def step(self, rows: _Rows, rel, here: str, end: str) -> _Rows:
        found, kinds = self.edges(rows, rel, end)
        return _Rows(rows.df.join(found, _c(f"{here}#id") == F.col("_from")).drop("_from"), rows.kinds | kinds)

    def closed(self, rows: _Rows, rel, here: str, there: str) -> _Rows:
        """A step between two bound nodes: one join by both, which multiplies no rows on
        its way."""
        found, kinds = self.edges(rows, rel, "_to")
        both = (_c(f"{here}#id") == F.col("_from")) & (_c(f"{there}#id") == _c("_to#id"))
        return _Rows(rows.df.join(found, both).drop("_from", "_to#id"), rows.kinds | kinds)

    def together(self, rows: _Rows, paths: list[Path], used: set[str]) -> _Rows:
        """Several paths of single steps as one set of steps, in an order that keeps rows
        few: steps between bound nodes come first, then those that lead to one node, then
        others; last those that fan out of a node to which many rows came by one that
        leads to one node, as these pair all of the rows with all of its neighbours."""
        named = [[(n.name or self.name(), n) for n in p.nodes] for p in paths]
        steps = [_Step(ns[k][0], rel, ns[k + 1][0]) for ns, p in zip(named, paths, strict=True) for k, rel in enumerate(p.rels)]
        patterns: dict[str, list[NodePattern]] = {}
        for ns in named:
            for name, pattern in ns:
                patterns.setdefault(name, []).append(pattern)

        def put(rows: _Rows, name: str, types: list[str] | None = None, direction: str = "out") -> _Rows:
            first, *more = patterns.pop(name)
            if types is None:
                found = self.scan(first, name)
                rows = _Rows(found if rows.df is None else rows.df.crossJoin(found), rows.kinds | {name: "node"})
            else:
                certain = self.graph.certain(types, direction, first.label)
                rows = self.bind(rows, first, name, first.name in used or bool(more), certain)
            for pattern in more:
                rows = self.again(rows, pattern, name)
            return rows

        for name in [n for n in patterns if n in rows.kinds]:
            for pattern in patterns.pop(name):
                rows = self.again(rows, pattern, name)
        gathered: set[str] = set()  # nodes that many rows came to
        where = self.where if self.counted is not None else None

        def cost(s: _Step) -> int:
            if s.here in rows.kinds and s.there in rows.kinds:
                return 0
            start, way = (s.here, s.rel.direction) if s.here in rows.kinds else (s.there, _BACK[s.rel.direction])
            if self.graph.leads_to_one(s.rel.types, way):
                return 1
            return 3 if start in gathered else 2

        while steps or patterns:
            open_ = [s for s in steps if s.here in rows.kinds or s.there in rows.kinds]
            if not open_:
                rows = put(rows, next(iter(patterns)))
                continue
            s = min(open_, key=cost)
            if self.counted is not None and cost(s) == 3:
                needed = self.counted | set(patterns) | {n for x in steps for n in (x.here, x.there)}
                rows = self.collapsed(rows, needed, where)
            steps.remove(s)
            if s.here in rows.kinds and s.there in rows.kinds:
                rows = self.closed(rows, s.rel, s.here, s.there)
                continue
            here, there, rel = (s.here, s.there, s.rel) if s.here in rows.kinds else (s.there, s.here, replace(s.rel, direction=_BACK[s.rel.direction]))
            if self.graph.leads_to_one(rel.types, rel.direction):
                gathered.add(there)
            rows = put(self.step(rows, rel, here, there), there, rel.types, rel.direction)
        return rows

    def collapsed(self, rows: _Rows, needed: set[str], where: Any) -> _Rows:
        """Rows that differ only in variables that nothing needs any more as one, with their
        number, so that a step out of a node isn't taken for each of them."""
        gone = [n for n in rows.kinds if n not in needed]
        if not gone:
            return rows
        for test in where.parts if isinstance(where, Logic) and where.op == "AND" else [where]:
            if test is not None and all(v.name in rows.kinds and v.prop not in DEGREES for v in _values(test)):
                rows = self.filtered(rows, test)
        kinds = {n: k for n, k in rows.kinds.items() if n in needed}
        kept = [c for n in kinds for c in rows.columns(n)]
        keys = [c for c in kept if c.endswith("#id") or kinds[c.partition("#")[0]] != "node"]
        times = F.sum(_c(TIMES)) if TIMES in rows.df.columns else F.count(F.lit(1))
        rest = [F.first(_c(c)).alias(c) for c in kept if c not in keys]
        return _Rows(rows.df.groupBy(*[_c(c) for c in keys]).agg(times.alias(TIMES), *rest), kinds)

    def leap(self, rows: _Rows, rel, here: str, end: str) -> _Rows:
        """Without a type only CALLS are followed."""
        low, high = rel.hops
        edges = self.graph.scan_edges(rel.types or [CALLS])
        found = reach.expand(rows.df.select(_c(f"{here}#id").alias("id")), edges, low, high, rel.direction)
        found = found.select(F.col("root").alias("_root"), F.col("node").alias(f"{end}#id"), F.col("hop").alias("_hop"))
        return _Rows(rows.df.join(found, _c(f"{here}#id") == F.col("_root")).drop("_root", "_hop"), rows.kinds)

    def match(self, rows: _Rows, m: Match, used: set[str]) -> _Rows:
        if not m.optional or rows.df is None:
            return self.filtered(self.paths(rows, m.paths, used), m.where)
        known = set(rows.kinds)
        ends = {n.name for p in m.paths for n in p.nodes if n.name in known}
        anchored = _Rows(None, {})
        if ends:  # the whole pattern over the distinct nodes it starts from
            columns = [f"`{c}`" for n in sorted(ends) for c in rows.columns(n)]
            anchored = _Rows(rows.df.select(*columns).dropDuplicates([f"{n}#id" for n in sorted(ends)]), {n: rows.kinds[n] for n in ends})
        return self.joined(rows, self.filtered(self.paths(anchored, m.paths, used), m.where), "left")

    def paths(self, rows: _Rows, paths: list[Path], used: set[str]) -> _Rows:
        """One path is walked as it is written; several of single steps are one set, and so is
        one whose matches are only counted."""
        several = len(paths) > 1 or (self.counted is not None and len(paths[0].rels) > 1)
        if several and all(rel.hops is None for p in paths for rel in p.rels):
            return self.together(rows, paths, used)
        for p in paths:
            rows = self.path(rows, p, used)
        return rows

    def unwind(self, rows: _Rows, u: Unwind) -> _Rows:
        if isinstance(u.values, Value):
            c, kind = self.value(rows, u.values)
            df = rows.df.withColumn(f"{u.name}#", F.explode(c if kind.startswith("array") else F.array(c)))
        else:
            values = F.array(*[F.lit(v) for v in u.values]) if u.values else F.array().cast("array<string>")
            base = rows.df if rows.df is not None else self.graph.scan_edges().sparkSession.range(1).drop("id")
            df = base.withColumn(f"{u.name}#", F.explode(values))
        return _Rows(df, rows.kinds | {u.name: "value"})

    # projections

    def scalar(self, rows: _Rows, item: Item) -> Column:
        if isinstance(item.value, Case):
            out = None
            for condition, value in item.value.branches:
                test = self.predicate(rows, condition, True)
                out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
            return out.otherwise(F.lit(item.value.otherwise or ""))
        c, _ = self.value(rows, item.value)
        func = (item.func or "").upper()
        return {"TOLOWER": F.lower, "TOUPPER": F.upper}[func](c.cast("string")) if func in ("TOLOWER", "TOUPPER") else c.cast("string") if func == "TOSTRING" else c

    def aggregate(self, rows: _Rows, item: Item) -> Column:
        if item.func == "COUNT":
            if TIMES in rows.df.columns and not item.distinct:  # of nodes and edges of a match none is null
                return F.coalesce(F.sum(_c(TIMES)), F.lit(0).cast("bigint"))
            if item.value is None:
                return F.count(F.lit(1))
            kind = rows.kinds.get(item.value.name)
            c = _c(f"{item.value.name}#id") if item.value.prop is None and kind in ("node", "edge") else self.value(rows, item.value)[0]
            return F.count_distinct(c) if item.distinct else F.count(c) if item.value.prop is None else F.count(F.lit(1))
        c, kind = self.value(rows, item.value)
        if item.func == "COLLECT":
            listed = c if kind != "string" else F.coalesce(c, F.lit(""))
            return F.array_sort(F.collect_set(listed) if item.distinct else F.collect_list(listed))
        n = coerce.number(c, kind)
        if item.distinct and item.func == "SUM":
            return F.sum_distinct(n)
        return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[item.func](n)

    def grouped(self, rows: _Rows, items: list[Item], names: list[str]) -> DataFrame:
        keys = [(i, n) for i, n in zip(items, names, strict=True) if i.func not in AGGREGATES]
        sums = [(i, n) for i, n in zip(items, names, strict=True) if i.func in AGGREGATES]
        aggs = [self.aggregate(rows, i).alias(n) for i, n in sums]
        if not keys:  # no row, no result
            return rows.df.agg(*aggs, F.count(F.lit(1)).alias("_n")).where("_n > 0").select(*[f"`{n}`" for n in names])
        by = [self.scalar(rows, i).alias(n) for i, n in keys]
        distinct = {i.value.name for i, _ in sums if i.distinct and i.func == "COUNT" and isinstance(i.value, Value) and i.value.prop is None and rows.kinds.get(i.value.name) in ("node", "edge")}
        if len(distinct) == 1:  # its ids are told apart where they are dealt to, with the groups
            rows = replace(rows, df=deal(rows.df, many(rows.df), *[self.scalar(rows, i) for i, _ in keys], _c(f"{min(distinct)}#id")))
        df = rows.df.groupBy(*by).agg(*aggs)
        return df.select(*[f"`{n}`" for n in names])

    def returned(self, rows: _Rows, p: Projection | None) -> DataFrame:
        if p is None:
            items = [Item(Value(n, c)) for n, k in rows.kinds.items() if k == "node" and not n.startswith("_") for c in ("name", "qualified_name", "label")]
            p = Projection(items)
        elif p.items is None:
            items = []
            for n, k in rows.kinds.items():
                if not n.startswith("_"):
                    items += [Item(Value(n))] if k == "value" else [Item(Value(n, c)) for c in (("name", "qualified_name", "label", "file_path") if k == "node" else ("type",))]
            p = replace(p, items=items)
        rows = self.with_degrees(rows, p)
        titles = [i.title for i in p.items]
        names = [f"{i}={t}" for i, t in enumerate(titles)]
        return self.ordered(rows, p, names, titles)

    def ordered(self, rows: _Rows, p: Projection, names: list[str], titles: list[str]) -> DataFrame:
        """Projects, and sorts by output columns or else by what the rows hold."""
        aggregated = any(i.func in AGGREGATES for i in p.items)
        keys, extra = [], []
        for key, descending in p.order:
            at = next((k for k, (i, t) in enumerate(zip(p.items, titles, strict=True)) if key.title == t or (key.value == i.value and key.func == i.func)), None)
            if at is not None:
                keys.append((names[at], descending))
            elif aggregated and key.func in AGGREGATES:
                extra.append((key, f"^{len(extra)}"))
                keys.append((extra[-1][1], descending))
            elif not aggregated and not p.distinct:
                extra.append((key, f"^{len(extra)}"))
                keys.append((extra[-1][1], descending))
        items, every = [*p.items, *(k for k, _ in extra)], [*names, *(n for _, n in extra)]
        if aggregated:
            df = self.grouped(rows, items, every)
        else:
            df = rows.df.select(*[self.scalar(rows, i).alias(n) for i, n in zip(items, every, strict=True)])
        if p.distinct:
            df = df.distinct()
        if keys:
            df = df.orderBy(*[_c(n).desc() if d else _c(n).asc() for n, d in keys])
        df = df.offset(p.skip) if p.skip else df
        df = df.limit(p.limit) if p.limit else df
        return df.select(*[_c(n).alias(t) for n, t in zip(names, titles, strict=True)])

    def with_(self, rows: _Rows, w: With) -> _Rows:
        p = w.projection
        if p.items is None:
            return self.filtered(rows, w.where)
        rows = self.with_degrees(rows, p)
        nodes = [i for i in p.items if isinstance(i.value, Value) and i.func is None and i.value.prop is None and rows.kinds.get(i.value.name) in ("node", "edge")]
        others = [i for i in p.items if i not in nodes]
        kinds = {i.alias or i.value.name: rows.kinds[i.value.name] for i in nodes} | {i.title: "value" for i in others}
        kept = [(c, f"{i.alias or i.value.name}#{c.partition('#')[2]}") for i in nodes for c in rows.columns(i.value.name)]
        if any(i.func in AGGREGATES for i in others):
            ids = [(c, n) for c, n in kept if n.endswith("#id")]
            rest = [(c, n) for c, n in kept if not n.endswith("#id")]
            keys = [_c(c).alias(n) for c, n in ids] + [self.scalar(rows, i).alias(f"{i.title}#") for i in others if i.func not in AGGREGATES]
            aggs = [self.aggregate(rows, i).alias(f"{i.title}#") for i in others if i.func in AGGREGATES] + [F.first(_c(c)).alias(n) for c, n in rest]
            df = rows.df.groupBy(*keys).agg(*aggs) if keys else rows.df.agg(*aggs, F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
        else:
            df = rows.df.select(*[_c(c).alias(n) for c, n in kept], *[self.scalar(rows, i).alias(f"{i.title}#") for i in others])
            if p.distinct:
                df = df.dropDuplicates([c for c in df.columns if c.endswith("#id") or c.endswith("#")])
        out = _Rows(df, kinds)
        if p.order:
            keys = []
            for key, descending in p.order:
                title = key.title
                c = _c(f"{title}#") if kinds.get(title) == "value" else self.value(out, key.value)[0]
                keys.append(c.desc() if descending else c.asc())
            out.df = out.df.orderBy(*keys)
        if p.skip:
            out.df = out.df.offset(p.skip)
        if p.limit:
            out.df = out.df.limit(p.limit)
        return self.filtered(out, w.where)

    def part(self, part: Part) -> DataFrame:
        used = _used(part)
        rows = _Rows(None, {})
        clauses = _merged(part.clauses)
        self.counted, self.where = _counted(clauses, part.returns), clauses[0].where if isinstance(clauses[0], Match) else None
        for clause in clauses:
            if isinstance(clause, Match):
                rows = self.match(rows, clause, used)
            elif isinstance(clause, With):
                rows = self.with_(rows, clause)
            else:
                rows = self.unwind(rows, clause)
        return self.returned(rows, part.returns)

    def query(self, q: Query) -> DataFrame:
        parts = [self.part(p) for p in q.parts]
        out = parts[0]
        for p in parts[1:]:
            if len(p.columns) != len(out.columns):
                raise QueryError("the parts of a UNION have different numbers of columns")
            out = out.union(p)
        return out if len(parts) == 1 or q.keep_all else out.distinct()


def _merged(clauses: list[Any]) -> list[Any]:
    """Neighbouring MATCH clauses as one: both ask for the same rows."""
    out: list[Any] = []
    for c in clauses:
        if out and all(isinstance(x, Match) and not x.optional for x in (c, out[-1])):
            tests = [x.where for x in (out[-1], c) if x.where is not None]
            out[-1] = Match(out[-1].paths + c.paths, False, Logic("AND", tests) if len(tests) > 1 else next(iter(tests), None))
        else:
            out.append(c)
    return out


def _turns(path: Path, names: list[str], at: str) -> bool:
    """Whether the path can be walked from its last node."""
    return names[-1] == at and names.count(at) == 1


def _turned(path: Path, at: int) -> Path:
    other = {"out": "in", "in": "out", "any": "any"}
    return Path(path.nodes[::-1], [replace(r, direction=other[r.direction]) for r in path.rels[::-1]])


def _values(tree: Any) -> list[Value]:
    if isinstance(tree, Value):
        return [tree]
    if isinstance(tree, (list, tuple)):
        return [v for x in tree for v in _values(x)]
    if hasattr(tree, "__dataclass_fields__"):
        return [v for name in tree.__dataclass_fields__ for v in _values(getattr(tree, name))]
    return []


def _counted(clauses: list[Any], p: Projection | None) -> set[str] | None:
    """Of one MATCH whose matches are only counted: the variables that its tests and results
    name, but for those that are counted themselves. None where a result takes each match's
    value: how often a value comes matters then."""
    if p is None or p.items is None or len(clauses) != 1 or not isinstance(clauses[0], Match) or clauses[0].optional:
        return None
    items = [*p.items, *(k for k, _ in p.order)]
    sums = [i for i in items if i.func in AGGREGATES]
    once = lambda i: i.func in ("COUNT", "MIN", "MAX") or (i.distinct and i.func in ("COLLECT", "SUM"))
    if not any(i.func in AGGREGATES for i in p.items) or not all(map(once, sums)):
        return None
    plain = {id(i.value) for i in sums if i.func == "COUNT" and not i.distinct and isinstance(i.value, Value)}
    return {v.name for v in _values([clauses[0].where, items]) if id(v) not in plain}


def _used(part: Part) -> set[str]:
    """Variables of which more than the id is needed."""
    whole = part.returns is None or part.returns.items is None
    named = [n.name for c in part.clauses if isinstance(c, Match) for p in c.paths for n in p.nodes if n.name]
    if whole:
        return set(named)
    out = {v.name for v in _values([c.where for c in part.clauses if not isinstance(c, Unwind)]) + _values([c.projection for c in part.clauses if isinstance(c, With)])}
    counted = {id(i.value) for i in part.returns.items if i.func == "COUNT" and isinstance(i.value, Value) and i.value.prop is None}
    out |= {v.name for v in _values(part.returns) if id(v) not in counted}
    return out | {n for n in named if named.count(n) > 1}


def compile_query(graph: Graph, query: str) -> DataFrame:
    """The query's result: typed columns, named by alias, else FUNC(variable), CASE,
    variable.property or variable."""
    return Compiler(graph).query(parse(query))
