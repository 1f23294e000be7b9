"""From source files to a graph: discovery, records, resolution, derived edges.

Every step is a table; records of languages without a front end here can be added
to the tables that build() takes.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .functions.paths import language
from .graph import EDGE_COLUMNS, NODE_COLUMNS, Graph
from .lineage import cut
from .operators import derive, services, store
from .sources import files as discovery
from .sources import python_code


def _id(project: str, name: Column) -> Column:
    return F.xxhash64(F.lit(project), name)


def _nodes(df: DataFrame, project: str) -> DataFrame:
    """df: label, name, qualified_name, file_path, start_line, end_line, properties."""
    own = df.withColumns({"id": _id(project, F.col("qualified_name")), "project": F.lit(project)})
    return own.select(*NODE_COLUMNS)


def _edges(df: DataFrame, project: str, properties: Column | None = None) -> DataFrame:
    """df: type, src and dst as qualified names."""
    src, dst = _id(project, F.col("src")), _id(project, F.col("dst"))
    out = df.select(F.xxhash64(src, dst, F.col("type")).alias("id"), F.lit(project).alias("project"), src.alias("src"), dst.alias("dst"), "type", (properties if properties is not None else F.lit("{}")).alias("properties"))
    return out.select(*EDGE_COLUMNS)


def _named_calls(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls with target: the name that the file's imports give the callee."""
    keys = imports.groupBy("file", F.col("key").alias("head")).agg(F.min("module").alias("imported"))
    heads = calls.withColumn("head", F.substring_index("callee", ".", 1)).join(keys, ["file", "head"], "left")
    name = F.when(F.col("imported").isNotNull(), F.concat("imported", F.expr("substr(callee, length(head) + 1)"))).otherwise(F.col("callee"))
    return heads.withColumn("target", name).drop("head", "imported")


def build(project: str, paths: DataFrame, defs: DataFrame, calls: DataFrame, imports: DataFrame, bases: DataFrame | None = None, resolved: DataFrame | None = None, decorated: DataFrame | None = None) -> Graph:
    """paths: file_path. defs: qualified_name, name, label, module, parent, file_path,
    start_line, end_line. calls: call_id, caller, module, callee, file, and arg (their first
    string), without which none goes to a route. imports: file, key, module. bases:
    qualified_name, module, bases, decorators. resolved: call_id, target of a better
    resolver. decorated: function, router, method, path. Edges to what is no node are left
    out, and repeated ones merged."""
    if "arg" not in calls.columns:
        calls = calls.withColumn("arg", F.lit(None).cast("string"))
    structure, contains = derive.structure(paths, project)
    name = F.when(F.col("file_path") == "", F.lit(project)).otherwise(F.substring_index("file_path", "/", -1))
    none = {"start_line": F.lit(0), "end_line": F.lit(0), "properties": F.lit("{}")}
    modules = defs.groupBy(F.col("module").alias("qualified_name")).agg(F.min("file_path").alias("file_path"))
    modules = modules.withColumns({"label": F.lit("Module"), "name": F.substring_index("qualified_name", ".", -1), **none})
    own = defs.withColumn("properties", F.to_json(F.struct(language(F.col("file_path")).alias("language"))))
    columns = ["label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties"]
    dotted = lambda c: F.when(F.col(c) == "", F.lit(project)).otherwise(F.concat_ws(".", F.lit(project), F.regexp_replace(c, "/", ".")))
    file_end = F.when(F.col("type") == "CONTAINS_FILE", F.concat(dotted("dst_path"), F.lit(".__file__"))).otherwise(dotted("dst_path"))
    parts = [_edges(contains.select("type", dotted("src_path").alias("src"), file_end.alias("dst")), project), _edges(derive.definitions(defs), project)]
    found = cut(derive.resolve_calls(calls, defs, imports, resolved)).join(calls.select("call_id", "caller", "callee", "arg"), "call_id")
    inside = found.select("call_id", F.col("caller").alias("src"), "callee", "target", "arg", "strategy", "confidence")
    outside = _named_calls(calls, imports).join(found.select("call_id"), "call_id", "left_anti")
    sent = cut(services.service_edges(inside).join(inside.select("call_id", "strategy", "confidence"), "call_id"))
    away = cut(services.service_edges(outside.withColumnRenamed("caller", "src")).where("route is not null"))
    parts.append(_edges(sent.where("src <> dst"), project, F.to_json(F.struct("strategy", "confidence", "method", "broker"))))
    parts.append(_edges(away, project, F.to_json(F.struct("method", "broker"))))
    routes = sent.select("route", "path").unionByName(away.select("route", "path")).where("route is not null")
    handled = services.file_routes(defs).select("route", "path", "handler")
    if decorated is not None:
        handled = handled.unionByName(derive.routes(decorated).select("route", "path", "handler"))
    routes = routes.unionByName(handled.select("route", "path")).groupBy(F.col("route").alias("qualified_name")).agg(F.min("path").alias("name"))
    routes = routes.withColumns({"label": F.lit("Route"), "file_path": F.lit(""), **none})
    handles = handled.select(F.lit("HANDLES").alias("type"), F.col("handler").alias("src"), F.col("route").alias("dst"))
    parts.append(_edges(handles, project))
    asked = sent.unionByName(away, allowMissingColumns=True).where("type in ('HTTP_CALLS', 'ASYNC_CALLS')").select("src", "route")
    flows = derive.data_flows(asked, handles.select("src", F.col("dst").alias("route")), sent.where("type = 'CALLS'").select("src", "dst"))
    parts.append(_edges(flows.withColumn("type", F.lit("DATA_FLOWS")), project, F.to_json(F.struct("route"))))
    if bases is not None:
        parts.append(_edges(derive.inherits(bases, defs), project))
        inherited = derive.inherits(bases, defs).where("type = 'INHERITS'").select("src", "dst")
        methods = defs.where("label = 'Method'").select(F.col("parent").alias("owner"), "name", "qualified_name")
        parts.append(_edges(derive.overrides(methods, inherited), project))
    nodes = reduce(DataFrame.unionByName, [x.select(*columns) for x in (structure.withColumns({"name": name, **none}), modules, own, routes)])
    nodes = cut(_nodes(nodes, project).dropDuplicates(["id"]))
    edges = cut(reduce(DataFrame.unionByName, parts))
    tested = derive.tests(edges.where("type = 'CALLS'"), nodes)
    edges = edges.unionByName(tested.select(F.xxhash64("src", "dst", "type").alias("id"), F.lit(project).alias("project"), "src", "dst", "type", F.lit("{}").alias("properties")))
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(nodes, edges.groupBy("id", "project", "src", "dst", "type").agg(F.max("properties").alias("properties")))


def _graph_of(records: DataFrame, found: DataFrame, project: str) -> Graph:
    classes = python_code.definitions(records).select("qualified_name", "module")
    listed = records.where("kind in ('base', 'decorator') and name <> ''").groupBy(F.col("owner").alias("qualified_name")).agg(
        F.collect_set(F.when(F.col("kind") == "base", F.col("name"))).alias("bases"),
        F.collect_set(F.when(F.col("kind") == "decorator", F.col("name"))).alias("decorators"),
    )
    bases = classes.join(listed, "qualified_name")
    graph = build(project, found.select("file_path"), python_code.definitions(records), python_code.calls(records), python_code.imports(records), bases, decorated=python_code.decorated_routes(records))
    return Graph(graph.nodes, cut(graph.edges))


def index_repository(spark: SparkSession, root: str, project: str, rules: Iterable[str] = (), mode: str = "full") -> Engine:
    """The engine over the graph of a folder's files. Definitions, calls and imports come
    from its Python files; all others are files of the graph and of code search."""
    found = cut(discovery.discover(spark, root, rules, mode=mode))  # as they are now
    records = cut(python_code.extract(found))  # many tables come from it
    return Engine(_graph_of(records, found, project), found, records=records, states=cut(discovery.file_states(found)))


def update_repository(engine: Engine, root: str, project: str, rules: Iterable[str] = (), mode: str = "full") -> Engine:
    """The engine after a folder has changed, as index_repository() would make it. Only new
    and changed files are parsed again; records of the others are taken over, and names,
    which a change elsewhere can resolve otherwise, are resolved from all records. An engine
    without records is indexed in full; one whose files are the same is returned."""
    spark = engine.graph.scan().sparkSession
    if engine.records is None or engine.states is None:
        return index_repository(spark, root, project, rules, mode)
    found = cut(discovery.discover(spark, root, rules, mode=mode))  # as they are now
    states = cut(discovery.file_states(found))
    status = cut(store.classify_files(states, engine.states).where("status <> 'unchanged'"))
    if status.isEmpty():
        return engine
    gone = status.where("status <> 'new'").select(F.col("rel_path").alias("file_path"))
    again = status.where("status <> 'deleted'").select(F.col("rel_path").alias("file_path"))
    kept = engine.records.join(gone, "file_path", "left_anti").select(*engine.records.columns)
    records = cut(kept.unionByName(python_code.extract(found.join(again, "file_path", "left_semi"))))
    return Engine(_graph_of(records, found, project), found, engine.embeddings, records, states)
