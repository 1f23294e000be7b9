"""Steps whose rows must not grow with the square of a group, against loops."""

import os
import random
import re

import numpy as np
import pytest

from weftgraph.lineage import cut
from weftgraph.operators import analytics, derive, reach, similarity, text_search, vector_search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def gathers_pairs(df, a="a", b="b"):
    """Whether the plan groups rows by both ends of a pair."""
    return any(re.search(rf"\b{a}#", keys) and re.search(rf"\b{b}#", keys) for keys in re.findall(r"Aggregate \[(.*?)\], ", plan(df)))


def made(df):
    """The most rows that a join of the run plan gave."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        for inner in ("executedPlan", "plan"):
            if name in ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage") and (inner == "executedPlan") == (name == "AdaptiveSparkPlan"):
                todo.append(getattr(node, inner)())
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return most


@pytest.fixture
def bits(spark):
    r = random.Random(3)
    rows = [(i, [r.randint(0, 1) for _ in range(16)] if i % 3 else [1] * 16) for i in range(60)]
    return rows, spark.createDataFrame(rows, "id bigint, bits array<int>")


@pytest.mark.parametrize("cap", [None, 12])
def test_hyperplane_pairs_come_once(bits, cap):
    rows, df = bits
    found = vector_search.hyperplane_candidates(df, bands=4, cap=cap)
    assert not gathers_pairs(found)
    buckets = {}
    for i, b in rows:
        for k in range(4):
            buckets.setdefault((k, tuple(b[4 * k : 4 * k + 4])), []).append(i)
    want = {(a, b) for ids in buckets.values() if cap is None or len(ids) <= cap for a in ids for b in ids if a < b}
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted(want)


@pytest.fixture
def signed(spark):
    r = random.Random(5)
    rows = [(i, [str(r.randint(0, 3)) for _ in range(8)] if i % 4 else ["x"] * 8) for i in range(50)]
    return rows, spark.createDataFrame(rows, "id bigint, signature array<string>")


def _agreeing(rows):
    out = {}
    for a, x in rows:
        for b, y in rows:
            if a < b and any(x[2 * k : 2 * k + 2] == y[2 * k : 2 * k + 2] for k in range(4)):
                out[a, b] = sum(p == q for p, q in zip(x, y, strict=True)) / 8
    return out


def test_similar_pairs_come_once_with_their_likeness(signed):
    rows, df = signed
    found = similarity.scored_pairs(df, bands=4)
    assert not gathers_pairs(found)
    got = found.select("a", "b", "jaccard").collect()
    assert {(r.a, r.b): r.jaccard for r in got} == _agreeing(rows) and len(got) == len(_agreeing(rows))


def test_similar_edges_join_no_pair_with_signatures(spark, signed):
    rows, df = signed
    files = spark.createDataFrame([(i, f"f{i % 5}.{'py' if i % 2 else 'js'}") for i, _ in rows], "id bigint, file_path string")
    found = similarity.similar_edges(df, files, 0.25, 2, bands=4)
    assert not gathers_pairs(found)
    want = []
    for a, _ in rows:
        near = sorted((-s, q) for (p, q), s in _agreeing(rows).items() if p == a and s >= 0.25 and p % 2 == q % 2)
        want += [(a, q, -s, a % 5 == q % 5) for s, q in near[:2]]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_neighbours_in_steps(spark, monkeypatch):
    assert vector_search.STEP <= 256
    r = np.random.default_rng(1)
    m = r.standard_normal((150, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vector array<double>")
    got = {(x.query, x.id) for x in vector_search.neighbours(df, df, 3).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert got == {(i, int(j)) for i in range(150) for j in np.argsort(-(u @ u.T)[i], kind="stable")[:3]}


def test_interfaces_begin_at_their_rarest_name(spark):
    n = 120
    methods = [(f"t{i}", "common") for i in range(n)] + [(f"t{i}", f"own{i}") for i in range(n)] + [(f"t{i}", m) for i in range(0, n, 4) for m in ("p", "q", "r")] + [("t0", None), (None, "p"), ("t1", "common")]
    wanted = [(f"i{i}", "common") for i in range(n)] + [(f"i{i}", f"own{i}") for i in range(n)] + [("four", m) for m in ("common", "p", "q", "r")] + [("one", "p"), ("none", "absent"), ("none", "p"), ("null", None), ("t0", "p")]
    df = derive.implements(spark.createDataFrame(methods, "owner string, name string"), spark.createDataFrame(wanted, "owner string, name string"))
    assert made(df) < n * n / 4
    has, need = {}, {}
    for table, rows in ((has, methods), (need, wanted)):
        for owner, name in rows:
            if owner is not None and name is not None:
                table.setdefault(owner, set()).add(name)
    assert sorted((r.src, r.dst) for r in df.collect()) == sorted((s, d) for s in has for d in need if need[d] <= has[s] and s != d)


def test_channels_are_made_distinct_before_they_pair(spark):
    side = lambda p, n, m: spark.createDataFrame([(p, i % n, f"c{i % 3}") for i in range(m)], "project string, src bigint, channel string")
    df = derive.cross_channels(side("one", 30, 120), side("two", 6, 40))
    assert not gathers_pairs(df, "src", "dst")
    got = [(r.src, r.dst, r.channel) for r in df.collect()]
    assert sorted(got) == sorted((a, b, f"c{c}") for c in range(3) for a in range(c, 30, 3) for b in range(c, 6, 3))


def test_flows_without_direct_calls_by_a_key(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    calls, handles = t([(1, "r"), (2, "r"), (3, "r"), (1, "r")], "src bigint, route string"), t([(3, "r"), (4, "r")], "src bigint, route string")
    near = t([(1, "k"), (1, "m"), (2, "n")], "src bigint, key string"), t([(3, "m"), (4, "n")], "dst bigint, key string")
    found = derive.data_flows(calls, handles, None, shared=near)
    assert sorted(map(tuple, found.collect())) == [(1, 4, "r"), (2, 3, "r"), (3, 4, "r")]
    assert found.join(found, ["src", "dst"]).count() == 3


def test_projects_calls_meet_routes_once(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    calls = t([("a", 1, "get", "/x/{i}"), ("a", 2, "get", "/y"), ("b", 3, "get", "/y"), ("b", 4, "post", "/z")], "project string, src bigint, method string, path string")
    served = t([("b", 7, "GET", "/x/:j"), ("b", 8, "ANY", "/x/{k}"), ("a", 9, "GET", "/y"), ("b", 10, "ANY", "/y/")], "project string, id bigint, method string, path string")
    found = derive.cross_project(calls, served)
    assert plan(found).count("LeftAnti") == 0
    one = [("a", 1, "b", 7), ("a", 2, "b", 10), ("b", 3, "a", 9)]
    assert sorted((r.project, r.src, r.other_project, r.dst) for r in found.collect()) == sorted(one + [(p, d, o, s) for o, s, p, d in one])


def test_communities_leave_only_what_is_read(spark):
    context = spark.sparkContext
    r = random.Random(2)
    edges = [(g * 10 + a, g * 10 + b) for g in range(4) for a in range(10) for b in range(a) if r.random() < 0.8] + [(g * 10, g * 10 + 10) for g in range(3)]
    nodes, table = spark.range(40), spark.createDataFrame(edges, "src bigint, dst bigint")
    cut(spark.range(1))  # sets the folder
    folder = context.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    found = analytics.communities(nodes, table, 2)
    assert len(set(os.listdir(folder)) - before) == 1
    of = {x.id: x.community for x in found.collect()}
    assert len(of) == 40
    degree, m = dict.fromkeys(range(40), 0), len(edges)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    by_hand = sum(of[a] == of[b] for a, b in edges) / m - sum((sum(degree[i] for i in of if of[i] == c) / (2 * m)) ** 2 for c in set(of.values()))
    assert abs(analytics.modularity(found, table).first().q - by_hand) < 1e-9


def test_shortest_paths_compute_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    edges = spark.createDataFrame([(i, i + 1) for i in range(2)] + [(2, 0)], "src bigint, dst bigint").mapInPandas(counted, "src bigint, dst bigint")
    got = sorted(map(tuple, reach.shortest(spark.createDataFrame([(0,)], "id bigint"), edges).collect()))
    assert got == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]
    assert seen.value == 3


def test_counted_matches_are_not_paired(spark):
    from weftgraph.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph
    from weftgraph.plans.compiler import compile_query

    nodes = [(i, "p", label, f"{label}{i}", f"q{i}", "f", i % 7, 0, "{}") for i, label in [(1, "Town"), (2, "Town")] + [(i, "Person") for i in range(10, 60)] + [(i, "Shop") for i in range(60, 100)]]
    edges = [(i, "p", i, 1 if i % 3 else 2, "IN", "{}") for i in range(10, 100)]
    g = Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), ends={"IN": (frozenset({"Person", "Shop"}), frozenset({"Town"}))}, single={"IN": "out"})
    people, shops = ([i for i in r if i % 3] for r in (range(10, 60), range(60, 100)))
    others = [[i for i in r if not i % 3] for r in (range(10, 60), range(60, 100))]
    sizes = {"Town1": (len(people), len(shops)), "Town2": tuple(map(len, others))}

    match = "MATCH (a:Person)-[:IN]->(t:Town) MATCH (t)<-[:IN]-(b:Shop)"
    found = compile_query(g, f"{match} RETURN t.name AS t, COUNT(*) AS n, COUNT(a) AS a, COUNT(DISTINCT b) AS b")
    assert made(found) <= 90
    assert {r.t: (r.n, r.a, r.b) for r in found.collect()} == {t: (p * s, p * s, s) for t, (p, s) in sizes.items()}
    found = compile_query(g, "MATCH (a:Person)-[:IN]->(t:Town)<-[:IN]-(b:Shop) WHERE a.start_line > 2 AND b.start_line < 5 RETURN t.name AS t, COUNT(b) AS n")
    want = {t: sum(i % 7 > 2 for i in p) * sum(i % 7 < 5 for i in s) for t, (p, s) in {"Town1": (people, shops), "Town2": others}.items()}
    assert made(found) <= 90 and {r.t: r.n for r in found.collect()} == want
    three = compile_query(g, f"{match} MATCH (t)<-[:IN]-(c:Person) RETURN t.name AS t, COUNT(c) AS n")
    assert made(three) <= 90 and {r.t: r.n for r in three.collect()} == {t: p * s * p for t, (p, s) in sizes.items()}
    whole = compile_query(g, f"{match} RETURN t.name AS t, SUM(b.start_line) AS n")  # how often a value comes matters
    assert {r.t: r.n for r in whole.collect()} == {t: float(len(p) * sum(i % 7 for i in s)) for t, (p, s) in {"Town1": (people, shops), "Town2": others}.items()}
    compared = compile_query(g, f"{match} WHERE a.start_line > 2 OR b.start_line < 5 RETURN COUNT(*) AS n")
    assert compared.collect()[0].n == sum(i % 7 > 2 or j % 7 < 5 for p, s in ((people, shops), others) for i in p for j in s)


def test_copies_are_scored_once(spark):
    r = random.Random(4)
    texts = [sorted(r.sample(["all", "u", "v", "w", "x", "y"], r.randint(1, 4))) for _ in range(12)]
    rows = [(i, "g" if i % 5 else "h", texts[i % len(texts)]) for i in range(90)] + [(90, "g", ["only"])]
    docs = spark.createDataFrame(rows, "id bigint, p_brand string, t array<string>")
    tokens = docs.selectExpr("id", "'name' as field", "explode(t) as token")
    weights = cut(similarity.tfidf(tokens, similarity.document_frequency(docs, "t")))
    scores, members = similarity.class_cosines(docs, "p_brand", weights)
    classes = {(g, tuple(t)) for _, g, t in rows}
    assert scores.count() <= len(classes) * (len(classes) + 1) // 2 and members.count() == len(rows)

    found = similarity.group_cosines(docs, "p_brand", weights)
    assert not gathers_pairs(found)
    got = {(x.a, x.b): x.score for x in found.collect()}
    pairs = spark.createDataFrame([(a, b) for a, g, _ in rows for b, h, _ in rows if a < b and g == h], "a bigint, b bigint")
    want = {(x.a, x.b): x.score for x in similarity.sparse_cosine(pairs, weights).collect()}
    assert got.keys() == want.keys() and len(want) > 2000
    assert found.count() == len(got) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_large_inputs_are_dealt_by_their_size(spark, monkeypatch, tmp_path):
    from weftgraph import lineage
    from weftgraph.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph
    from weftgraph.operators import store
    from weftgraph.plans.compiler import compile_query

    r = random.Random(6)
    nodes = spark.createDataFrame([(i, "p", "AB"[i % 2], f"test_{i}", f"q{i}", "tests/test_a.py" if i % 2 else "src/a.py", i % 5, i % 5 + i % 9, "{}") for i in range(40)], NODE_SCHEMA)
    edges = spark.createDataFrame([(i, "p", r.choice([1, 1, r.randrange(50)]), r.randrange(50), "CALLS", "{}") for i in range(300)], EDGE_SCHEMA)
    for name, df in (("nodes", nodes), ("edges", edges)):  # files have a known size
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    nodes, edges = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("nodes", "edges"))
    hits = nodes.selectExpr("file_path", "start_line as line").distinct()
    runs = {
        "degrees": lambda: store.degrees(edges),
        "without_dangling": lambda: store.without_dangling(nodes, edges),
        "tightest": lambda: store.tightest(nodes, hits),
        "tests": lambda: derive.tests(edges, nodes),
        "count_distinct": lambda: compile_query(Graph(nodes, edges), "MATCH (a:A)-[:CALLS]->(b:B) RETURN b.start_line AS s, COUNT(DISTINCT a) AS n"),
    }
    small = {k: sorted(f().collect()) for k, f in runs.items()}
    assert all(small.values())
    monkeypatch.setattr(lineage, "SHARE", 1)
    monkeypatch.setattr(lineage, "MOST_SHARES", 9)
    for k, f in runs.items():
        assert re.search(r"RepartitionByExpression \[.*\], 9", plan(f())), k
        assert sorted(f().collect()) == small[k], k


def test_an_index_is_written_without_a_shuffle(spark, tmp_path):
    import pyarrow.parquet as pq

    r = random.Random(8)
    words = [f"w{i}" for i in range(20)] + ["Éa", "ω", "x_1"]
    rows = [(i % 90, " - ".join(r.choices(words, k=r.randint(0, 30)))) for i in range(120)] + [(None, "w1 w1"), (90, None), (91, ""), (92, "..."), (93, "w3")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "id bigint, text string")
    assert "Exchange" not in text_search.index(docs, "id", "text")[0]._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    text_search.write_index(docs, "id", "text", str(tmp_path))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    segments = [pq.read_table(f) for f in tmp_path.glob("postings/part-*.parquet")]
    assert len(segments) == 5
    for s in segments:
        tokens = [w.encode() for w in s["token"].to_pylist()]
        assert tokens == sorted(tokens)
    got = sorted((i, w, n, m) for s in segments for i, w, n, m in zip(*(s[c].to_pylist() for c in ("id", "token", "tf", "dl")), strict=True) if i is not None)
    split = [(i, re.findall(r"\w+", t.lower())) for i, t in rows if t and i is not None]
    assert got == sorted((i, w, t.count(w), len(t)) for i, t in split for w in set(t))
    for query in ("w1", "w2 nothing ω", " ".join(words), ""):  # rows that share an id count each
        scan = {}
        for x in text_search.bm25(docs, "id", "text", query).collect():
            scan[x.id] = scan.get(x.id, 0.0) + x.score
        found = text_search.search_index(spark, str(tmp_path), "id", query)
        assert {x.id: x.score for x in found.collect()} == pytest.approx(scan)
    assert re.search(r"PushedFilters: \[[^\]]*token", text_search.search_index(spark, str(tmp_path), "id", " ".join(words))._jdf.queryExecution().executedPlan().toString())
