"""The property graph: nodes and edges as DataFrames.

nodes: id, project, label, name, qualified_name, file_path, start_line, end_line and
properties (JSON); edges: id, project, src, dst, type and properties (JSON).

A graph may also give a table for each label or edge type, with properties as
columns of their own: a scan of that label then reads only the columns that the
query uses, and its filters reach the files.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "id bigint, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string"
EDGE_SCHEMA = "id bigint, project string, src bigint, dst bigint, type string, properties string"

NODE_COLUMNS = tuple(x.split()[0] for x in NODE_SCHEMA.split(", "))
EDGE_COLUMNS = tuple(x.split()[0] for x in EDGE_SCHEMA.split(", "))


def _union(frames: Iterable[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    frames = [f.select(*columns) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@dataclass
class Graph:
    """nodes and edges, or tables by label and type, or both.

    whole: every edge's ends are nodes; an edge whose other end is neither labelled
    nor used then needs no join with the nodes. ends: the labels at both ends of a type.
    single: out or in, for types of which a node has at most one edge that way."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    by_label: Mapping[str, DataFrame] = field(default_factory=dict)
    by_type: Mapping[str, DataFrame] = field(default_factory=dict)
    project: str | None = None
    whole: bool = True
    ends: Mapping[str, tuple[frozenset[str], frozenset[str]]] = field(default_factory=dict)
    single: Mapping[str, str] = field(default_factory=dict)

    def leads_to_one(self, types: Iterable[str], direction: str) -> bool:
        """Whether from a node at most one edge of these types leads in this direction."""
        types = list(types)
        return len(types) == 1 and direction != "any" and self.single.get(types[0]) == direction

    def scan(self, label: str | None = None) -> DataFrame:
        """The nodes, or those of a label."""
        if label is not None and label in self.by_label:
            return self._own(self.by_label[label])
        if self.nodes is None:
            if label is not None:
                return self._own(_union(self.by_label.values(), NODE_COLUMNS).where(F.lit(False)))
            return self._own(_union(self.by_label.values(), NODE_COLUMNS))
        nodes = self._own(self.nodes)
        return nodes if label is None else nodes.where(F.col("label") == label)

    def scan_edges(self, types: Iterable[str] = ()) -> DataFrame:
        """The edges, or those of some types, a type named twice counting once."""
        types = list(dict.fromkeys(types))
        if self.edges is None:
            known = [self.by_type[t] for t in types if t in self.by_type] if types else list(self.by_type.values())
            if not known:
                return _union(self.by_type.values(), EDGE_COLUMNS).where(F.lit(False))
            return self._own(known[0] if len(known) == 1 else _union(known, EDGE_COLUMNS))
        edges = self._own(self.edges)
        return edges.where(F.col("type").isin(types)) if types else edges

    def certain(self, types: Iterable[str], direction: str, label: str | None) -> bool:
        """Whether edges of these types lead, in this direction, to nodes of label alone."""
        if label is None:
            return True
        at = {"out": (1,), "in": (0,), "any": (0, 1)}[direction]
        return bool(types) and all(t in self.ends and self.ends[t][i] <= {label} for t in types for i in at)

    def _own(self, df: DataFrame) -> DataFrame:
        return df if self.project is None else df.where(F.col("project") == self.project)
