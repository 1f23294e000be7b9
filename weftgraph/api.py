"""One object with a method for each tool, over a graph and its source files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vectors
from .graph import Graph
from .operators import analytics, derive, records, store, text_search, traverse, vector_search
from .plans.compiler import compile_query


@dataclass
class Engine:
    """graph: the nodes and edges; files: file_path, text; embeddings: id, vector; records
    and states: what was extracted from the files, and how they were then."""

    graph: Graph
    files: DataFrame | None = None
    embeddings: DataFrame | None = None
    records: DataFrame | None = None
    states: DataFrame | None = None

    @cached_property
    def nodes(self) -> DataFrame:
        return self.graph.scan()

    @cached_property
    def edges(self) -> DataFrame:
        return self.graph.scan_edges()

    def query_graph(self, query: str, ceiling: int | None = None) -> DataFrame:
        """Rows of a pattern query; beyond the ceiling, if one is given, an error."""
        out = compile_query(self.graph, query)
        if ceiling is not None and out.limit(ceiling + 1).count() > ceiling:
            raise ValueError(f"more than {ceiling} rows; narrow the query")
        return out

    @staticmethod
    def as_text(rows: DataFrame) -> DataFrame:
        """All cells as text, null as empty."""
        return rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])

    def search_graph(self, query: str | None = None, *, limit: int = 100, offset: int = 0, connected: bool = False, semantic: list[list[float]] | None = None, **conditions) -> dict[str, DataFrame]:
        """results, and on demand their neighbours and the nearest vectors."""
        if query is not None:
            results = text_search.search_nodes(self.nodes, query, limit)
        else:
            results = store.page(store.structured_search(self.nodes, self.edges, **conditions), limit, offset)
        out = {"results": results}
        if connected:
            out["connected"] = traverse.connected(results, self.edges, self.nodes)
        if semantic and self.embeddings is not None:
            out["semantic"] = vector_search.search(self.embeddings, semantic, limit=limit)
        return out

    def search_code(self, query: str, path_filter: str | None = None, limit: int = 50) -> dict[str, DataFrame]:
        found = text_search.search_code(self.files, self.nodes, self.edges, query, path_filter, limit)
        return {"results": found, "directories": text_search.directories(found)}

    def get_code_snippet(self, qualified_name: str) -> dict[str, DataFrame]:
        return {"snippet": text_search.snippet(self.nodes, self.files, qualified_name), "suggestions": text_search.suggestions(self.nodes, qualified_name)}

    def trace_path(self, name: str, mode: str = "calls", depth: int = 3, tests: bool = True) -> dict[str, DataFrame]:
        return {"callers": traverse.trace(self.nodes, self.edges, name, mode, "in", depth, tests), "callees": traverse.trace(self.nodes, self.edges, name, mode, "out", depth, tests)}

    def get_graph_schema(self) -> dict[str, DataFrame]:
        return analytics.schema(self.nodes, self.edges)

    def get_architecture(self, *aspects: str) -> dict[str, DataFrame]:
        return analytics.architecture(self.nodes, self.edges, *aspects)

    def detect_changes(self, changed: DataFrame, depth: int = 0) -> dict[str, DataFrame]:
        out = {"symbols": traverse.changed_symbols(self.nodes, changed)}
        if depth:
            out["impact"] = traverse.blast_radius(self.nodes, self.edges, changed, depth)
        return out

    def dead_code(self) -> DataFrame:
        return traverse.dead_code(self.nodes, self.edges)

    def cross_project(self, calls: DataFrame, targets: DataFrame, kind: str = "HTTP") -> DataFrame:
        return derive.cross_project(calls, targets, kind)

    def list_projects(self) -> DataFrame:
        return self.nodes.groupBy("project").agg(F.count(F.lit(1)).alias("nodes"))

    def index_status(self) -> DataFrame:
        edges = self.edges.groupBy("project").agg(F.count(F.lit(1)).alias("edges"))
        return self.list_projects().join(edges, "project", "left").na.fill(0, ["edges"])

    def delete_project(self, project: str) -> Engine:
        return Engine(Graph(self.nodes.where(F.col("project") != project), self.edges.where(F.col("project") != project)), self.files, self.embeddings)

    def manage_adr(self, text: str | None = None, update: dict[str, str] | None = None) -> str:
        return records.update_sections(text or "", update or {})

    def architecture_documents(self) -> DataFrame:
        return store.files(self.nodes).where(F.col("file_path").rlike(r"(?i)(^|/)(architecture|design|adr[^/]*|decisions?)(\.md|/.*\.md)$"))

    def register_functions(self) -> None:
        vectors.register(self.nodes.sparkSession)

    def save(self, path: str) -> None:
        """The graph as compressed Parquet by project, with a row of its figures beside it."""
        for name, df in (("nodes", self.nodes), ("edges", self.edges)):
            df.write.mode("overwrite").option("compression", "zstd").partitionBy("project").parquet(f"{path}/{name}")
        self.index_status().coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> Engine:
        return Engine(Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")))
