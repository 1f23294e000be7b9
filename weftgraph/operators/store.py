"""Scans, lookups, upserts and deletes on node and edge tables."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.coerce import glob_to_like, with_case_flag
from ..lineage import cut, deal, many

# lookups


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes with the asked ids (column id)."""
    return nodes.join(ids.select("id"), "id", "left_semi").select(*nodes.columns)


def by_qualified_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """qualified_name, id of each asked name; 0 where there is no such node."""
    known = nodes.select("qualified_name", "id")
    return names.select("qualified_name").join(known, "qualified_name", "left").select("qualified_name", F.coalesce("id", F.lit(0)).alias("id"))


def by_suffix(nodes: DataFrame, suffix: str) -> DataFrame:
    """Nodes whose qualified name is the suffix or ends in a dot and the suffix, any case."""
    return nodes.where((F.col("qualified_name") == suffix) | F.col("qualified_name").ilike(f"%.{suffix}"))


#: Labels without lines of their own. Fixed values.
CONTAINERS = ("Module", "Package", "File", "Folder")


def overlapping(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Nodes whose lines overlap a span (file_path, low, high), joined by file."""
    inner = nodes.where(~F.col("label").isin(*CONTAINERS))
    return inner.join(spans, "file_path").where((F.col("start_line") <= F.col("high")) & (F.col("end_line") >= F.col("low")))


def tightest(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """For each hit (file_path, line) the enclosing node of the fewest lines, the
    smallest id among equals; hits outside all nodes are left out."""
    inner = nodes.where(~F.col("label").isin(*CONTAINERS)).select("id", "name", "label", "qualified_name", "file_path", "start_line", "end_line")
    n = many(nodes, hits)
    found = deal(hits, n, "file_path").join(deal(inner, n, "file_path"), "file_path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.min_by(F.struct("id", "name", "label", "qualified_name", "start_line", "end_line"), F.struct(F.col("end_line") - F.col("start_line"), F.col("id")))
    return found.groupBy(*hits.columns).agg(best.alias("n")).select(*hits.columns, "n.*")


def edges_by_url(edges: DataFrame, keyword: str) -> DataFrame:
    return edges.where(F.get_json_object("properties", "$.url_path").contains(keyword))


def files(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.coalesce("file_path", F.lit("")) != "").select("file_path").distinct()


def structured_search(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    label: str | None = None,
    name_pattern: str | None = None,
    file_glob: str | None = None,
    qn_pattern: str | None = None,
    relationship: str | None = None,
    min_degree: int | None = None,
    max_degree: int | None = None,
    exclude_labels: Iterable[str] = (),
    exclude_entry_points: bool = False,
    degree_types: Iterable[str] = ("CALLS", "USAGE"),
) -> DataFrame:
    """Nodes by any of the conditions, with in_degree and out_degree if one needs them."""
    if label is not None:
        nodes = nodes.where(F.col("label") == label)
    if name_pattern is not None:
        nodes = nodes.where(F.col("name").rlike(with_case_flag(name_pattern)))
    if qn_pattern is not None:
        nodes = nodes.where(F.col("qualified_name").rlike(with_case_flag(qn_pattern)))
    if file_glob is not None:
        nodes = nodes.where(F.col("file_path").like(glob_to_like(file_glob)))
    if exclude_labels:
        nodes = nodes.where(~F.col("label").isin(*exclude_labels))
    if relationship is not None:
        of = edges.where(F.col("type") == relationship)
        ends = of.select(F.col("src").alias("id")).union(of.select(F.col("dst").alias("id")))
        nodes = nodes.join(ends, "id", "left_semi")
    if min_degree is not None or max_degree is not None or exclude_entry_points:
        nodes = with_degrees(nodes, edges, degree_types)
        total = F.col("in_degree") + F.col("out_degree")
        if min_degree is not None:
            nodes = nodes.where(total >= min_degree)
        if max_degree is not None:
            nodes = nodes.where(total <= max_degree)
        if exclude_entry_points:
            calls = with_degrees(nodes.select("id"), edges, ("CALLS",)).where("in_degree = 0 and out_degree > 0")
            nodes = nodes.join(calls.select("id"), "id", "left_anti")
    return nodes


def page(found: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    return found.orderBy("name", "id").offset(offset).limit(limit)


#: Parts in which the edges of a node are counted.
DEGREE_PARTS = 16


def degrees(edges: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """id, in_degree, out_degree in one pass over the edges. Where these are many, a node's
    edges are counted in parts first."""
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    ends = edges.select((F.col("src") + F.col("dst")).alias("other"), F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    n = many(edges)
    if n:
        ends = deal(ends.select("e", F.pmod(F.xxhash64("other"), F.lit(DEGREE_PARTS)).alias("part")), n, "e.id", "part")
        ends = deal(ends.groupBy("e.id", "part").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o")), n, "id").select(F.struct("id", "i", "o").alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def with_degrees(nodes: DataFrame, edges: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return nodes.join(degrees(edges, types), "id", "left").withColumns({"in_degree": F.coalesce("in_degree", zero), "out_degree": F.coalesce("out_degree", zero)})


# changes

NODE_KEY, EDGE_KEY = ("project", "qualified_name"), ("src", "dst", "type")


def latest(rows: DataFrame, key: Iterable[str], version: str) -> DataFrame:
    """Of rows with one key the one with the highest version, as an aggregate, which
    combines before the shuffle; other columns break ties."""
    key = list(key)
    rest = [c for c in rows.columns if c not in key and c != version]
    best = F.max(F.struct(version, *rest)).alias("r")
    return rows.groupBy(*key).agg(best).select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def upsert_nodes(old: DataFrame, new: DataFrame, key: Iterable[str] = NODE_KEY) -> DataFrame:
    """The last writer wins on every column."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return latest(both, key, "_v").drop("_v")


def _merged(target: Any, patch: Any) -> Any:
    """A JSON merge patch: objects are merged key by key, null deletes a key, all else
    takes the target's place."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merged(out.get(k), v)
    return out


@F.pandas_udf(StringType())
def _merge_versions(versions: pd.Series) -> pd.Series:
    def one(texts: Iterable[str]) -> str:
        out: Any = {}
        for t in texts:
            out = _merged(out, json.loads(t or "{}"))
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    return versions.map(one)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with one source, target and type are one; their properties are merged as JSON
    merge patches, the old ones first, of several new ones in the order of their text.
    Values keep their types. Properties of which there is one version are left as they
    are, without a step through Python; equal versions count once."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rest = [c for c in old.columns if c not in (*EDGE_KEY, "properties")]
    kept = [F.min_by(c, "_v").alias(c) for c in rest]
    version = F.struct("_v", F.coalesce("properties", F.lit("{}")).alias("p"))
    merged = both.groupBy(*EDGE_KEY).agg(*kept, F.array_sort(F.collect_set(version))["p"].alias("_all"))
    columns = [c for c in old.columns if c != "properties"]
    plain = (F.size("_all") == 1) & ~F.col("_all")[0].contains("null")
    one = merged.where(plain).select(*columns, F.col("_all")[0].alias("properties"))
    several = merged.where(~plain).select(*columns, _merge_versions("_all").alias("properties"))
    return one.unionByName(several).select(*old.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes whose ids are gone, and without their edges."""
    left = nodes.join(gone.select("id"), "id", "left_anti").select(*nodes.columns)
    ids = gone.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, kept.select(*edges.columns)


def merge_buffers(first: DataFrame, second: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two node tables whose ids may clash, as one: ids of the first stay, attributes of
    the second win, and edges of the second follow their qualified names."""
    old = first.select(*NODE_KEY, F.col("id").alias("kept"))
    renamed = second.join(old, list(NODE_KEY), "left").withColumn("to", F.coalesce("kept", F.xxhash64(*NODE_KEY)))
    moved = renamed.select(*[F.col("to").alias("id") if c == "id" else F.col(c) for c in second.columns])
    mapping = renamed.select("id", "to")
    turned = edges.join(mapping.select(F.col("id").alias("src"), F.col("to").alias("s")), "src").join(mapping.select(F.col("id").alias("dst"), F.col("to").alias("d")), "dst")
    return upsert_nodes(first, moved), turned.select(*[F.col("s").alias("src") if c == "src" else F.col("d").alias("dst") if c == "dst" else F.col(c) for c in edges.columns])


def renumbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with ids from 1 on in the order of their ids, and the edges between them. The
    nodes are dealt by ranges; only the ranges' sizes are added up in one place."""
    dealt = cut(nodes.repartitionByRange("id").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("id"))
    placed = dealt.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn("_new", F.col("_before") + F.col("_rank"))
    ids = cut(placed.select("id", "_new"))
    moved = edges.join(ids.select(F.col("id").alias("src"), F.col("_new").alias("_s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("_new").alias("_d")), "dst")
    turned = moved.select(*[F.col("_s").alias(c) if c == "src" else F.col("_d").alias(c) if c == "dst" else F.col(c) for c in edges.columns])
    return placed.select(*[F.col("_new").alias(c) if c == "id" else F.col(c) for c in nodes.columns]), turned


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = many(nodes, edges)
    ids = nodes.select("id")
    kept = edges
    for end in ("src", "dst"):
        some = deal(ids.withColumnRenamed("id", end), n, end)
        kept = deal(kept, n, end).join(some.hint("merge") if n else some, end, "left_semi")  # many ids are not broadcast
    return kept.select(*edges.columns)


# change detection


def classify_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """rel_path, status: new, changed (by time or size), unchanged or deleted."""
    n = now.select("rel_path", F.col("mtime_ns").alias("m"), F.col("size").alias("s"), F.lit(True).alias("here"))
    b = before.select("rel_path", "mtime_ns", "size", F.lit(True).alias("there"))
    both = n.join(b, "rel_path", "full")
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted").when((F.col("m") != F.col("mtime_ns")) | (F.col("s") != F.col("size")), "changed").otherwise("unchanged")
    return both.select("rel_path", status.alias("status"))


def deleted_or_skipped(before: DataFrame, indexed: DataFrame, present: DataFrame) -> DataFrame:
    """rel_path, status of stored files that weren't indexed: skipped while they are
    still present, else deleted."""
    missing = before.select("rel_path").join(indexed.select("rel_path"), "rel_path", "left_anti")
    known = present.select("rel_path").distinct().withColumn("p", F.lit(True))
    return missing.join(known, "rel_path", "left").select("rel_path", F.when(F.col("p"), "skipped").otherwise("deleted").alias("status"))


def top_per(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_r") <= n).drop("_r")
