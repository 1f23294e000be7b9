"""Traces, impact, dead code and call depth on top of bounded expansion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_file, risk
from . import reach
from .store import degrees, top_per

#: Edge types that a trace follows, by mode. Fixed values.
MODES = {"calls": ("CALLS",), "data_flow": ("CALLS", "DATA_FLOWS"), "cross_service": ("HTTP_CALLS", "ASYNC_CALLS", "DATA_FLOWS", "CALLS")}

CROSS_SERVICE = ("HTTP_CALLS", "ASYNC_CALLS")


def bfs(roots: DataFrame, edges: DataFrame, types: Iterable[str] = ("CALLS",), direction: str = "out", depth: int = 3) -> DataFrame:
    """root, node, hop: every number of edges by which a walk of at most depth edges leads
    to a node."""
    return reach.expand(roots, edges.where(F.col("type").isin(*types)), 1, depth, direction)


def first_hops(visited: DataFrame) -> DataFrame:
    """root, node and the least hop."""
    return visited.groupBy("root", "node").agg(F.min("hop").alias("hop"))


def edges_among(visited: DataFrame, edges: DataFrame, types: Iterable[str]) -> DataFrame:
    """src, dst, type, confidence of the edges between the nodes of a traversal."""
    ids = visited.select(F.col("node").alias("id")).union(visited.select(F.col("root").alias("id"))).distinct()
    inner = edges.where(F.col("type").isin(*types))
    inner = inner.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inner.select("src", "dst", "type", F.lit(1.0).alias("confidence"))


def trace(nodes: DataFrame, edges: DataFrame, name: str, mode: str = "calls", direction: str = "out", depth: int = 3, tests: bool = True, limit: int | None = None) -> DataFrame:
    """hop, risk and the node of everything that a function leads to (out) or that
    leads to it (in). name: a short name, else a qualified one; of several functions
    of that name the one with the smallest id."""
    named = nodes.where(F.col("name") == name).agg(F.min("id").alias("id")).where("id is not null")
    exact = nodes.where(F.col("qualified_name") == name).agg(F.min("id").alias("id")).where("id is not null")
    root = named.withColumn("o", F.lit(0)).union(exact.withColumn("o", F.lit(1))).orderBy("o").limit(1).select("id")
    found = first_hops(bfs(root, edges, MODES[mode], direction, depth)).where("root <> node")
    out = found.join(nodes, F.col("node") == F.col("id")).select("hop", risk(F.col("hop")).alias("risk"), "id", "name", "qualified_name", "file_path")
    if not tests:
        out = out.where(~is_test_file(F.col("file_path")))
    return out if limit is None else out.orderBy("hop", "id").limit(limit)


def impact_summary(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each root: nodes by risk, their number, and whether the edges cross
    services."""
    crossing = edges.where(F.col("type").isin(*CROSS_SERVICE)).agg((F.count(F.lit(1)) > 0).alias("has_cross_service"))
    counts = visited.groupBy("root").agg(
        F.count_if(F.col("hop") == 1).alias("critical"),
        F.count_if(F.col("hop") == 2).alias("high"),
        F.count_if(F.col("hop") == 3).alias("medium"),
        F.count_if(F.col("hop") > 3).alias("low"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.crossJoin(F.broadcast(crossing))  # one row


def changed_symbols(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes of the changed files (file_path), without containers."""
    inner = nodes.where(~F.col("label").isin("File", "Folder", "Project"))
    return inner.join(changed.select("file_path"), "file_path", "left_semi")


def blast_radius(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """node, hop, risk of what leads to a changed symbol, by the shortest way."""
    roots = changed_symbols(nodes, changed).select("id")
    found = reach.shortest(roots, edges.where(F.col("type") == "CALLS"), depth, "in").groupBy("node").agg(F.min("hop").alias("hop"))
    return found.select("node", "hop", F.when(F.col("hop") == 0, "CHANGED").otherwise(risk(F.col("hop"))).alias("risk"))


def dead_code(nodes: DataFrame, edges: DataFrame, label: str = "Function", types: Iterable[str] = ("CALLS",)) -> DataFrame:
    called = edges.where(F.col("type").isin(*types)).select(F.col("dst").alias("id"))
    return nodes.where(F.col("label") == label).join(called, "id", "left_anti")


def call_depth(edges: DataFrame) -> DataFrame:
    """node, depth: edges from the nearest node that nothing leads to; 0 for nodes that
    none of these leads to, as on a cycle."""
    ends = degrees(edges)
    found = reach.shortest(ends.where("in_degree = 0").select("id"), edges).groupBy("node").agg(F.min("hop").alias("depth"))
    return ends.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def connected(found: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and the sorted names of its direct neighbours."""
    ids = found.select("id")
    around = reach.steps(edges, "any").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    named = around.join(nodes.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("id"), "name").distinct()
    return named.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("neighbours"))


#: Edge types of callers and callees. Fixed values.
CALLING = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS")


def neighbour_names(nodes: DataFrame, edges: DataFrame, direction: str = "out", limit: int = 10) -> DataFrame:
    """id, names: for every node up to limit distinct names of what it calls, or of what
    calls it, in order."""
    travel = reach.steps(edges.where(F.col("type").isin(*CALLING)), direction)
    named = travel.join(nodes.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("id"), "name").distinct()
    return top_per(named, "id", [F.col("name")], limit).groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("names"))
