"""Schema statistics, architecture roll-ups, communities, components, co-change."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_file, language, package
from ..lineage import cut, forget, shares
from .store import degrees

#: Property keys listed for a label or type.
KEYS = 50


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def counts(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """what, n: how many nodes, edges and vectors there are."""
    parts = {"nodes": nodes, "edges": edges} | ({} if vectors is None else {"vectors": vectors})
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, df in parts.items()]
    return reduce(DataFrame.union, rows)


def property_keys(rows: DataFrame, by: str, column: str = "properties", most: int = KEYS) -> DataFrame:
    """by, keys: the sorted distinct keys of the JSON objects, at most so many."""
    keys = rows.select(by, F.explode(F.json_object_keys(column)).alias("k")).distinct()
    return keys.groupBy(by).agg(F.slice(F.array_sort(F.collect_set("k")), 1, most).alias("keys"))


def patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src_label, type, dst_label, n."""
    s, d = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label")), nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(s, "src").join(d, "dst").groupBy("src_label", "type", "dst_label").agg(F.count(F.lit(1)).alias("n"))


def _top(df: DataFrame, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("n"), *ties).limit(n)


def languages(nodes: DataFrame, most: int = 10) -> DataFrame:
    files = nodes.where((F.col("label") == "File") & (language(F.col("file_path")) != ""))
    return _top(files.groupBy(language(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n")), most, "language")


def packages(nodes: DataFrame, most: int = 15) -> DataFrame:
    """Packages by the number of their functions and classes."""
    inner = nodes.where(F.col("label").isin("Function", "Method", "Class", "Interface", "Type", "Enum"))
    named = inner.select(package(F.col("qualified_name")).alias("package")).where("package <> ''")
    return _top(named.groupBy("package").agg(F.count(F.lit(1)).alias("n")), most, "package")


def _flag(key: str) -> Column:
    return F.coalesce(F.get_json_object("properties", f"$.{key}").isin("true", "1"), F.lit(False))


def entry_points(nodes: DataFrame, most: int = 20) -> DataFrame:
    found = nodes.where(_flag("is_entry_point") & ~is_test_file(F.col("file_path")))
    return found.select("id", "name", "qualified_name", "file_path").orderBy("id").limit(most)


def routes(nodes: DataFrame, most: int = 20) -> DataFrame:
    p = lambda k: F.coalesce(F.get_json_object("properties", f"$.{k}"), F.lit(""))
    found = nodes.where(F.col("label") == "Route").select("id", p("method").alias("method"), F.when(p("path") != "", p("path")).otherwise(F.col("name")).alias("path"), p("handler").alias("handler"))
    return found.orderBy("id").limit(most)


def hotspots(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Functions and methods with the most callers, tests aside."""
    inner = nodes.where(F.col("label").isin("Function", "Method") & ~is_test_file(F.col("file_path")))
    fan_in = edges.where(F.col("type") == "CALLS").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return _top(inner.join(fan_in, "id").select("id", "name", "qualified_name", "n"), most, "id")


def boundaries(nodes: DataFrame, edges: DataFrame, most: int | None = 10) -> DataFrame:
    """from_package, to_package, n: calls between packages."""
    named = nodes.select("id", package(F.col("qualified_name")).alias("p")).where("p <> ''")
    s, d = named.select(F.col("id").alias("src"), F.col("p").alias("from_package")), named.select(F.col("id").alias("dst"), F.col("p").alias("to_package"))
    calls = edges.where(F.col("type") == "CALLS").join(s, "src").join(d, "dst").where("from_package <> to_package")
    counted = calls.groupBy("from_package", "to_package").agg(F.count(F.lit(1)).alias("n"))
    return counted if most is None else _top(counted, most, "from_package", "to_package")


def layers(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """package, layer: entry, api, core, leaf or internal, by calls across packages. most:
    only the so many strongest boundaries count."""
    calls = boundaries(nodes, edges, most)
    flows = calls.select(F.explode(F.array(F.struct(F.col("from_package").alias("package"), F.col("n").alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_package").alias("package"), F.lit(0).alias("o"), F.col("n").alias("i")))).alias("x")).select("x.*")
    sums = flows.groupBy("package").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    inner = nodes.select(package(F.col("qualified_name")).alias("package"), _flag("is_entry_point").alias("e"), (F.col("label") == "Route").alias("r"))
    marks = inner.where("package <> ''").groupBy("package").agg(F.bool_or("e").alias("has_entry"), F.bool_or("r").alias("has_routes"))
    both = sums.join(marks, "package", "full").na.fill(0, ["fan_out", "fan_in"]).where("fan_in > 0 or fan_out > 0 or has_routes")
    i, o = F.col("fan_in"), F.col("fan_out")
    layer = F.when(F.coalesce("has_entry", F.lit(False)) & (o > 0) & (i == 0), "entry").when(F.coalesce("has_routes", F.lit(False)), "api")
    layer = layer.when((i > o) & (i > 3), "core").when((o == 0) & (i > 0), "leaf").when((i == 0) & (o > 0), "entry").otherwise("internal")
    return both.select("package", layer.alias("layer"), "fan_in", "fan_out")


def file_tree(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """path, children: the folders up to a depth with the number of things in each."""
    parts = F.split("file_path", "/")
    paths = nodes.where(F.col("label") == "File").select(parts.alias("p"))
    levels = paths.select("p", F.explode(F.sequence(F.lit(0), F.least(F.size("p") - 1, F.lit(depth)))).alias("d"))
    pairs = levels.where(F.col("d") < F.size("p")).select(F.array_join(F.slice("p", 1, F.col("d")), "/").alias("path"), F.try_element_at("p", F.col("d") + 1).alias("child")).distinct()
    return pairs.groupBy("path").agg(F.count(F.lit(1)).alias("children"))


#: What an architecture report may have, and how it is made.
ASPECTS = {
    "languages": lambda nodes, edges: languages(nodes),
    "packages": lambda nodes, edges: packages(nodes),
    "entry_points": lambda nodes, edges: entry_points(nodes),
    "routes": lambda nodes, edges: routes(nodes),
    "hotspots": lambda nodes, edges: hotspots(nodes, edges),
    "boundaries": lambda nodes, edges: boundaries(nodes, edges),
    "layers": lambda nodes, edges: layers(nodes, edges),
    "file_tree": lambda nodes, edges: file_tree(nodes),
    "clusters": lambda nodes, edges: communities(nodes, edges),
}


def architecture(nodes: DataFrame, edges: DataFrame, *aspects: str) -> dict[str, DataFrame]:
    """The aspects that are asked for, all if none is named; no others are computed."""
    return {k: make(nodes, edges) for k, make in ASPECTS.items() if not aspects or k in aspects}


def schema(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    return {"labels": label_counts(nodes), "types": type_counts(edges), "node_keys": property_keys(nodes, "label"), "edge_keys": property_keys(edges, "type"), "patterns": patterns(nodes, edges)}


# components and communities


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that edges of either direction lead to. Each round
    takes the least label around and then that label's own label, which halves the
    distance that is left; the last is the one that changes nothing."""
    around = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    around = cut(around)
    labels = nodes.select("id", F.col("id").alias("c"))
    while True:
        near = around.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("m"))
        least = labels.join(near, "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = least.select(F.col("id").alias("n"), F.col("n").alias("t"))
        new = cut(least.join(jump, "n", "left").select("id", "c", F.least("n", F.coalesce("t", "n")).alias("n")))
        changed = new.where("c <> n").limit(1).count()
        labels = new.select("id", F.col("n").alias("c"))
        if not changed:
            return labels.withColumnRenamed("c", "component")


def communities(nodes: DataFrame, edges: DataFrame, sweeps: int = 10) -> DataFrame:
    """id, community: local moving by modularity gain w(i, C) - k(i) * K(C) / 2m over an
    undirected multigraph without loops. All nodes of one half, by a hash that differs
    in each sweep, move at once, so that neighbours don't swap for ever; the smallest
    community wins ties.

    The edges are dealt once, by the node whose label a sweep looks up, and a sweep weighs
    the half that moves only; the other half is looked at where the first wants no move, to
    tell whether all is settled."""
    parts = shares(edges)
    pairs = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst")
    w = cut(pairs.repartition(parts, "src").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    degree = cut(w.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    labels = nodes.select("id", F.col("id").alias("c"))
    total = degree.agg(F.sum("k")).first()[0]
    if not total:
        forget(w, degree)
        return labels.withColumnRenamed("c", "community")

    def wishes(labels: DataFrame, half: Callable[[str], Column]) -> DataFrame:
        """id, old, new of the nodes of one half."""
        known = labels.join(degree, "id")
        sized = known.join(known.groupBy("c").agg(F.sum("k").alias("kc")), "c")
        around = w.where(half("dst")).join(sized.select(F.col("id").alias("src"), "c", "kc"), "src")
        links = around.groupBy(F.col("dst").alias("id"), "c").agg(F.sum("w").alias("wic"), F.first("kc").alias("kc"))
        own = sized.where(half("id"))
        stay = own.select("id", "c", F.lit(0.0).alias("wic"), "kc", F.col("c").alias("old"), "k")
        options = links.join(own.select("id", F.col("c").alias("old"), "k"), "id").unionByName(stay)
        rest = F.col("kc") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0.0)
        gain = F.col("wic") - F.col("k") * rest / F.lit(float(total))
        return options.groupBy("id", "old").agg(F.min_by("c", F.struct((-gain).alias("g"), F.col("c") != F.col("old"), "c")).alias("new"))

    kept = None
    for sweep in range(sweeps):
        turn = lambda c, s=sweep: F.pmod(F.xxhash64(c, F.lit(s)), F.lit(2)) == 0
        moved = wishes(labels, turn).where("new <> old").select("id", F.col("new").alias("n"))
        new = cut(labels.join(moved, "id", "left").select("id", F.coalesce("n", "c").alias("c"), F.col("n").isNotNull().alias("moved")))
        settled = new.where("moved").isEmpty() and wishes(labels, lambda c, t=turn: ~t(c)).where("new <> old").isEmpty()
        if kept is not None:
            forget(kept)
        kept, labels = new, new.select("id", "c")
        if settled:
            break
    forget(w, degree)
    return labels.withColumnRenamed("c", "community")


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, q. labels: id, community."""
    s, d = labels.select(F.col("id").alias("src"), F.col("community").alias("a")), labels.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    between = edges.select("src", "dst").where("src <> dst").join(s, "src").join(d, "dst").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    inner = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)
    ends = between.select(F.explode(F.array(F.struct("a", inner.alias("i"), "n"), F.struct(F.col("b").alias("a"), inner.alias("i"), "n"))).alias("e"))
    inside = ends.groupBy("e.a").agg(F.sum("e.i").alias("i"), F.sum("e.n").alias("k"))
    m2 = F.sum("k").over(Window.partitionBy())
    return inside.select((F.col("i") / m2 - (F.col("k") / m2) * (F.col("k") / m2)).alias("q")).agg(F.sum("q").alias("q"))


# co-change


def co_change(changes: DataFrame, most_files: int = 20, least: int = 3, score: float = 0.3) -> DataFrame:
    """file_a, file_b, co_changes, coupling_score, last_co_change. changes: commit_id, ts,
    file; commits of more files than most_files don't count. The score is the share of
    the less changed file's commits."""
    once = changes.groupBy("commit_id", "file").agg(F.max("ts").alias("ts"))
    small = once.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_files).select("commit_id")
    rows = once.join(small, "commit_id", "left_semi")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("c"))
    a, b = rows.select("commit_id", "ts", F.col("file").alias("file_a")), rows.select("commit_id", F.col("file").alias("file_b"))
    pairs = a.join(b, "commit_id").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("co_changes"), F.max("ts").alias("last_co_change")).where(F.col("co_changes") >= least)
    pairs = pairs.join(counts.select(F.col("file").alias("file_a"), F.col("c").alias("ca")), "file_a").join(counts.select(F.col("file").alias("file_b"), F.col("c").alias("cb")), "file_b")
    share = F.col("co_changes") / F.least("ca", "cb")
    return pairs.select("file_a", "file_b", "co_changes", share.alias("coupling_score"), "last_co_change").where(F.col("coupling_score") >= score)


def file_history(changes: DataFrame) -> DataFrame:
    return changes.groupBy("file").agg(F.count_distinct("commit_id").alias("change_count"), F.max("ts").alias("last_modified"))


def p99(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, p99: the value at place min(int(0.99 n), n - 1) of each group in order. The
    groups are ranked, not gathered."""
    counted = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by).orderBy(value)
    total = Window.partitionBy(*by)
    ranked = counted.withColumns({"_end": F.sum("_c").over(upto), "_n": F.sum("_c").over(total)})
    at = F.least(F.floor(F.col("_n") * 99 / 100), F.col("_n") - 1)
    return ranked.where(F.col("_end") > at).groupBy(*by).agg(F.min(value).alias("p99"))
