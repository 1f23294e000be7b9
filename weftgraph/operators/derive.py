"""Edges derived from extraction records by joins.

Records are tables: defs (qualified_name, name, label, module, file_path), imports
(file, key, module), calls (call_id, file, module, callee) and the like.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_file, is_test_function
from ..functions.text import config_key, decorator_words
from ..lineage import cut, deal, many
from .joins import meet
from .store import files as file_list


def structure(paths: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, qualified_name, file_path) and edges (type, src_path, dst_path) of the
    project, its folders and its files. The project's own path is empty."""
    parts = F.split("file_path", "/")
    rows = paths.select("file_path").distinct().select("file_path", parts.alias("p"))
    levels = rows.select("p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("d")).select("p", "d", F.array_join(F.slice("p", 1, F.col("d")), "/").alias("folder"))
    folders = levels.where("d > 0").select("folder").distinct()
    nodes = (
        folders.select(F.lit("Folder").alias("label"), F.concat_ws(".", F.lit(project), F.regexp_replace("folder", "/", ".")).alias("qualified_name"), F.col("folder").alias("file_path"))
        .union(rows.select(F.lit("File"), F.concat_ws(".", F.lit(project), F.regexp_replace("file_path", "/", "."), F.lit("__file__")), "file_path"))
        .union(paths.sparkSession.range(1).select(F.lit("Project"), F.lit(project), F.lit("")))
    )
    parent = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    edges = folders.select(F.lit("CONTAINS_FOLDER").alias("type"), parent("folder").alias("src_path"), F.col("folder").alias("dst_path")).union(rows.select(F.lit("CONTAINS_FILE"), parent("file_path"), "file_path"))
    return nodes, edges


def definitions(defs: DataFrame, channels: DataFrame | None = None, imports: DataFrame | None = None) -> DataFrame:
    """type, src, dst by qualified name: DEFINES, DEFINES_METHOD, EMITS, LISTENS_ON, IMPORTS.
    defs: qualified_name, label, module, parent (a method's class)."""
    out = defs.select(F.lit("DEFINES").alias("type"), F.col("module").alias("src"), F.col("qualified_name").alias("dst"))
    methods = defs.where((F.col("label") == "Method") & F.col("parent").isNotNull())
    out = out.union(methods.select(F.lit("DEFINES_METHOD"), "parent", "qualified_name"))
    if channels is not None:
        kind = F.when(F.col("direction") == "emit", "EMITS").otherwise("LISTENS_ON")
        out = out.union(channels.select(kind, "function", F.concat(F.lit("__channel__"), "name")))
    if imports is not None:
        out = out.union(imports.select(F.lit("IMPORTS"), "module", "target"))
    return out.distinct()


#: Confidence of each way to resolve a call, in the order of trial. Fixed values.
STRATEGIES = {"import_map": 0.95, "import_map_suffix": 0.85, "same_module": 0.90, "unique_name": 0.75, "suffix_match": 0.55}


def resolve_calls(calls: DataFrame, defs: DataFrame, imports: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """call_id, target, strategy, confidence of the calls that can be resolved.

    calls: call_id, module, callee, file. defs: qualified_name, name, module, file_path.
    imports: file, key, module. Each distinct (file, module, callee) is resolved once:
    by the import map (the first part of a dotted callee, or the whole), by an imported
    module's name that ends in the key, in the caller's own module, by a name that one
    definition alone has, and by the best of several, where production code goes before
    tests and a longer common beginning of the module before a shorter; candidates that
    no import reaches count half. known: call_id, target of other resolvers, which win.
    """
    n = many(calls, defs, imports)
    asked = calls.select("file", "module", "callee").distinct()
    dotted = F.instr("callee", ".") > 0
    asked = asked.select("*", F.when(dotted, F.substring_index("callee", ".", 1)).otherwise(F.col("callee")).alias("head"), F.when(dotted, F.expr("substr(callee, instr(callee, '.') + 1)")).alias("tail"), F.substring_index("callee", ".", -1).alias("last"))
    d = defs.select(F.col("qualified_name").alias("target"), F.col("name").alias("def_name"), F.col("module").alias("def_module"), F.col("file_path").alias("def_file"))
    key = ["file", "module", "callee"]
    mapped = asked.join(imports.select("file", F.col("key").alias("head"), F.col("module").alias("imported")), ["file", "head"])
    wanted = F.concat_ws(".", "imported", F.when(F.col("tail").isNotNull(), F.col("tail")))
    exact = mapped.withColumn("w", wanted)
    by_map = exact.join(d, F.col("w") == F.col("target")).select(*key, "target", F.lit(0).alias("order"), F.lit("import_map").alias("strategy"), F.lit(1.0).alias("score"))
    by_tail = mapped.join(d, F.col("last") == F.col("def_name")).where(F.col("target").startswith(F.concat(F.col("imported"), F.lit("."))))
    by_tail = by_tail.select(*key, "target", F.lit(1).alias("order"), F.lit("import_map_suffix").alias("strategy"), F.lit(1.0).alias("score"))
    here = asked.withColumn("w", F.concat_ws(".", "module", "callee")).join(d, F.col("w") == F.col("target"))
    here = here.select(*key, "target", F.lit(2).alias("order"), F.lit("same_module").alias("strategy"), F.lit(1.0).alias("score"))

    reach = imports.select("file", F.col("module").alias("imported")).distinct()
    named = asked.select(*key, "last").join(d, F.col("last") == F.col("def_name"))
    linked = named.join(reach.withColumnRenamed("file", "f"), (F.col("file") == F.col("f")) & ((F.col("def_module") == F.col("imported")) | F.col("target").startswith(F.concat(F.col("imported"), F.lit(".")))), "left")
    cand = deal(linked, n, *key).groupBy(*key, "target", "def_module", "def_file").agg(F.max(F.col("imported").isNotNull()).alias("reachable"))
    counted = cand.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("reachable").alias("any"))
    common = F.aggregate(
        F.sequence(F.lit(1), F.least(F.size(F.split("module", r"\.")), F.size(F.split("def_module", r"\.")))),
        F.lit(0),
        lambda s, i: F.when((s == i - 1) & (F.try_element_at(F.split("module", r"\."), i) == F.try_element_at(F.split("def_module", r"\."), i)), i).otherwise(s),
    )
    rank = F.when(~is_test_file(F.col("def_file")), 1000).otherwise(0) + common + F.when(F.col("reachable"), 10_000).otherwise(0)
    scored = cand.join(counted, key).select(*key, "target", "n", "any", F.col("reachable"), rank.alias("score"))
    unique = scored.where("n = 1").select(*key, "target", F.lit(3).alias("order"), F.lit("unique_name").alias("strategy"), F.col("score").cast("double"), F.when(F.col("reachable"), 1.0).otherwise(0.5).alias("factor"))
    penalty = F.when(F.col("n") > 3, F.least(F.lit(1.0), 3.0 / F.col("n"))).otherwise(1.0) * F.when(F.col("any"), 1.0).otherwise(0.5)
    several = scored.where("n > 1").select(*key, "target", F.lit(4).alias("order"), F.lit("suffix_match").alias("strategy"), F.col("score").cast("double"), penalty.alias("factor"))

    every = reduce(DataFrame.unionByName, [x.withColumn("factor", F.lit(1.0)) for x in (by_map, by_tail, here)] + [unique, several])
    best = deal(every, n, *key).groupBy(*key).agg(F.min_by(F.struct("target", "strategy", "factor"), F.struct("order", -F.col("score"), "target")).alias("b")).select(*key, "b.*")
    confidence = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
    out = deal(calls, n, *key).join(best, key).select("call_id", "target", "strategy", (F.try_element_at(confidence, F.col("strategy")) * F.col("factor")).alias("confidence"))
    if known is not None:
        given = known.select("call_id", "target", F.lit("resolved").alias("strategy"), F.lit(1.0).alias("confidence"))
        out = out.join(known.select("call_id"), "call_id", "left_anti").unionByName(given)
    return out


def route_key(method: Column, path: Column) -> Column:
    """Qualified name of a route: method, and path with its parameters alike."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\{[^}]*\}|:[A-Za-z_]\w*|<[^>]*>", "{}"), r"(?<=.)/$", "")
    return F.concat(F.lit("__route__"), F.upper(F.coalesce(F.nullif(method, F.lit("")), F.lit("ANY"))), F.lit("__"), plain)


def routes(decorated: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """route, method, path, handler from decorators (function, router, method, path), with
    the prefixes under which routers are mounted (router, prefix)."""
    rows = decorated
    path = F.col("path")
    if prefixes is not None:
        rows = rows.join(prefixes, "router", "left")
        path = F.concat(F.coalesce("prefix", F.lit("")), F.col("path"))
    return rows.select(route_key(F.col("method"), path).alias("route"), F.upper("method").alias("method"), path.alias("path"), F.col("function").alias("handler"))


def data_flows(calls: DataFrame, handles: DataFrame, direct: DataFrame | None, mapped: DataFrame | None = None, shared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """src, dst, route: callers of a route to its handlers, but for functions that call
    themselves or each other directly. calls: src, route; handles: src, route; direct:
    src, dst of CALLS; mapped: route, to (INFRA_MAPS). shared: direct calls of each src to
    each dst with the same key, as (src, key) and (dst, key), which are never paired but
    for the flows."""
    c = calls.select("src", "route").distinct()
    if mapped is not None:
        c = c.union(c.join(mapped, "route").select("src", F.col("to").alias("route"))).distinct()
    flows = c.join(handles.select(F.col("src").alias("dst"), "route").distinct(), "route").where("src <> dst")
    if direct is not None:
        flows = flows.join(direct.select("src", "dst"), ["src", "dst"], "left_anti")
    if shared is not None:
        by = shared[0].select("src", "key").groupBy("src").agg(F.collect_set("key").alias("_a"))
        of = shared[1].select("dst", "key").groupBy("dst").agg(F.collect_set("key").alias("_b"))
        flows = flows.join(by, "src", "left").join(of, "dst", "left").where(~F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False)))
    return flows.select("src", "dst", "route")


def cross_project(calls: DataFrame, targets: DataFrame, kind: str = "HTTP") -> DataFrame:
    """type, project, src, other_project, dst in both directions: calls (project, src,
    method, path) to routes (project, id, method, path) of other projects; a route for
    any method serves where none for the call's own exists."""
    asked = calls.select("project", "src", route_key(F.col("method"), F.col("path")).alias("own"), route_key(F.lit("ANY"), F.col("path")).alias("any"))
    served = targets.select(F.col("project").alias("other_project"), F.col("id").alias("dst"), route_key(F.col("method"), F.col("path")).alias("route"))
    ends = served.groupBy(F.col("route").alias("own")).agg(F.min("other_project").alias("least"), F.max("other_project").alias("most"))
    elsewhere = F.coalesce((F.col("least") != F.col("project")) | (F.col("most") != F.col("project")), F.lit(False))
    wanted = asked.join(ends, "own", "left").select("project", "src", F.when(elsewhere, F.col("own")).otherwise(F.col("any")).alias("route"))
    both = wanted.join(served, "route").where("project <> other_project").select("project", "src", "other_project", "dst").distinct()
    ways = F.array(F.struct("project", "src", "other_project", "dst"), F.struct(F.col("other_project").alias("project"), F.col("dst").alias("src"), F.col("project").alias("other_project"), F.col("src").alias("dst")))
    return both.select(F.explode(ways).alias("w")).select(F.lit(f"CROSS_{kind}_CALLS").alias("type"), "w.*")


def cross_channels(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """project, src, other_project, dst, channel by the channel's name. Both sides are made
    distinct, which makes their pairs so, and a channel of many emitters is dealt out."""
    e = emits.select("project", "src", "channel").distinct()
    listening = listens.select(F.col("project").alias("other_project"), F.col("src").alias("dst"), "channel").distinct()
    return meet(e, listening, ["channel"]).where("project <> other_project").select("project", "src", "other_project", "dst", "channel")


def usages(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """type, src, dst: USAGE, THROWS, RAISES, READS, WRITES. records: call_id, function,
    kind; resolved: call_id, target."""
    names = {"usage": "USAGE", "throw": "THROWS", "raise": "RAISES", "read": "READS", "write": "WRITES"}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = records.join(resolved, "call_id").select(F.try_element_at(known, F.col("kind")).alias("type"), F.col("function").alias("src"), F.col("target").alias("dst"))
    return found.where("type is not null and src <> dst").distinct()


def inherits(classes: DataFrame, defs: DataFrame) -> DataFrame:
    """type, src, dst. classes: qualified_name, module, bases, decorators (arrays of names)."""
    d = defs.select(F.col("qualified_name").alias("dst"), F.col("name").alias("n"), F.col("module").alias("m"))
    out = []
    for kind, column in (("INHERITS", "bases"), ("DECORATES", "decorators")):
        named = classes.select(F.col("qualified_name").alias("src"), F.col("module"), F.explode(column).alias("n"))
        found = named.withColumn("n", F.substring_index("n", ".", -1)).join(d, "n").where("src <> dst")
        best = found.groupBy("src", "n").agg(F.min_by("dst", F.struct(F.col("m") != F.col("module"), "dst")).alias("dst"))
        out.append(best.select(F.lit(kind).alias("type"), "src", "dst") if kind == "INHERITS" else best.select(F.lit(kind).alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    return out[0].union(out[1])


def implements(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """type, src, dst: types whose methods include all of an interface's, by name.
    methods: owner, name; interfaces: owner, name. The owners of an interface's rarest name
    are tried with its next rarest, and what is left with all other names."""
    have = methods.select(F.col("owner").alias("src"), "name").where("src is not null and name is not null").distinct()
    want = interfaces.select(F.col("owner").alias("dst"), "name").where("dst is not null and name is not null").distinct()
    owners = have.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("dst").orderBy("n", "name")
    ranked = want.join(owners, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = cut(ranked.select("dst", "name", F.row_number().over(rarest).alias("r"), F.lead("name").over(rarest).alias("next"), F.count(F.lit(1)).over(Window.partitionBy("dst")).alias("k")))
    some = ranked.where("r = 1").join(have, "name").where("src <> dst").select("src", "dst", "k", "next")
    both = cut(some.where("k > 1").join(have.withColumnRenamed("name", "next"), ["src", "next"], "left_semi").select("src", "dst", "k"))
    full = some.where("k = 1").select("src", "dst").union(both.where("k = 2").select("src", "dst"))
    rest = both.where("k > 2").select("src", "dst", "k").join(ranked.where("r > 2").select("dst", "name"), "dst").join(have, ["src", "name"], "left_semi")
    full = full.union(rest.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"), F.first("k").alias("k")).where("c = k - 2").select("src", "dst"))
    return full.select(F.lit("IMPLEMENTS").alias("type"), "src", "dst")


def overrides(methods: DataFrame, parents: DataFrame) -> DataFrame:
    """type, src, dst: methods (owner, name, qualified_name) of a class and of its parents
    (src, dst) with one name."""
    m = methods.select("owner", "name", "qualified_name")
    child = m.join(parents.select(F.col("src").alias("owner"), F.col("dst").alias("base")), "owner").select("base", "name", F.col("qualified_name").alias("src"))
    return child.join(m.select(F.col("owner").alias("base"), "name", F.col("qualified_name").alias("dst")), ["base", "name"]).select(F.lit("OVERRIDE").alias("type"), "src", "dst")


def tests(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """type, src, dst: TESTS from test functions to what they call in production code."""
    n = nodes.select("id", "name", "file_path")
    a, b = n.select(F.col("id").alias("src"), F.col("name").alias("na"), F.col("file_path").alias("fa")), n.select(F.col("id").alias("dst"), F.col("file_path").alias("fb"))
    k = many(calls, nodes)
    found = deal(calls.select("src", "dst"), k, "src").join(deal(a, k, "src"), "src").where(is_test_function(F.col("fa"), F.col("na")))
    found = deal(found, k, "dst").join(deal(b, k, "dst"), "dst").where(~is_test_file(F.col("fb")))
    return found.select(F.lit("TESTS").alias("type"), "src", "dst").distinct()


def production_path(path: Column) -> Column:
    """The file that a test file tests, by its name."""
    plain = F.regexp_replace(path, r"(^|/)(tests?|__tests__)/", "$1")
    plain = F.regexp_replace(plain, r"(^|/)test_([^/]*)$", "$1$2")
    return F.regexp_replace(plain, r"(_test|\.test|\.spec)(\.[^./]*)$", "$2")


def tests_files(nodes: DataFrame) -> DataFrame:
    """type, src_path, dst_path by convention of names, where both files exist."""
    paths = file_list(nodes)
    tested = paths.where(is_test_file(F.col("file_path"))).select(F.col("file_path").alias("src_path"), production_path(F.col("file_path")).alias("dst_path")).where("src_path <> dst_path")
    return tested.join(paths.select(F.col("file_path").alias("dst_path")), "dst_path", "left_semi").select(F.lit("TESTS_FILE").alias("type"), "src_path", "dst_path")


def configures(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst, confidence: configuration keys (id, key) to symbols (id, name): equal when
    normalised 0.85, contained 0.75. Containment meets by the words of the key, so that
    only symbols with its first word are compared."""
    k = keys.select(F.col("id").alias("src"), config_key(F.col("key")).alias("k")).where(F.length("k") >= 3)
    s = symbols.select(F.col("id").alias("dst"), config_key(F.col("name")).alias("n"))
    words = s.select("dst", "n", F.explode(F.array_distinct(F.split("n", "_"))).alias("word"))
    met = k.withColumn("word", F.substring_index("k", "_", 1)).join(words, "word")
    score = F.when(F.col("k") == F.col("n"), 0.85).when(F.concat(F.lit("_"), "n", F.lit("_")).contains(F.concat(F.lit("_"), F.col("k"), F.lit("_"))), 0.75)
    return met.select("src", "dst", score.alias("confidence")).where("confidence is not null").distinct()


def dependency_imports(deps: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst, confidence: declared dependencies (id, name) to imports (id, target): the
    same first part 0.95, any part 0.80."""
    parts = imports.select(F.col("id").alias("dst"), F.posexplode(F.split("target", r"[./]")).alias("i", "name"))
    met = deps.select(F.col("id").alias("src"), F.lower(F.regexp_replace("name", "-", "_")).alias("name")).join(parts.withColumn("name", F.lower("name")), "name")
    return met.groupBy("src", "dst").agg(F.max(F.when(F.col("i") == 0, 0.95).otherwise(0.80)).alias("confidence"))


def file_references(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """src, file_path, confidence: strings (id, text) that name a file: its path 0.90, its
    last part 0.70."""
    r = refs.select(F.col("id").alias("src"), F.regexp_replace("text", r"^\./", "").alias("t"), F.substring_index("text", "/", -1).alias("last"))
    p = paths.select("file_path", F.substring_index("file_path", "/", -1).alias("last"))
    return r.join(p, "last").select("src", "file_path", F.when(F.col("t") == F.col("file_path"), 0.90).otherwise(0.70).alias("confidence"))


def decorator_tags(nodes: DataFrame) -> DataFrame:
    """id, tags: words of a node's decorators that at least two nodes have. nodes: id,
    decorators (array)."""
    words = nodes.select("id", F.explode(F.array_distinct(F.flatten(F.transform("decorators", decorator_words)))).alias("w"))
    common = words.groupBy("w").agg(F.count_distinct("id").alias("n")).where("n >= 2").select("w")
    return words.join(common, "w", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("tags"))


def module_definitions(imports: DataFrame, defs: DataFrame) -> DataFrame:
    """file, qualified_name: what a file's imported modules define."""
    return imports.select("file", "module").distinct().join(defs.select("module", "qualified_name"), "module").select("file", "qualified_name")


def fuzzy_resolve(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """call_id, target, confidence by name alone: 0.40 for the only one, 0.30 for the first
    of several."""
    d = defs.groupBy(F.col("name").alias("last")).agg(F.min("qualified_name").alias("target"), F.count(F.lit(1)).alias("n"))
    return calls.withColumn("last", F.substring_index("callee", ".", -1)).join(d, "last").select("call_id", "target", F.when(F.col("n") == 1, 0.40).otherwise(0.30).alias("confidence"))
