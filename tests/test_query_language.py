import pytest
from weftgraph.graph import Graph
from weftgraph.plans.compiler import compile_query
from weftgraph.plans.lexer import QueryError, UnsupportedFeatureError, tokens
from weftgraph.plans.parser import Comparison, Logic, parse

from .graphs import http, standard


def rows(g, q):
    return sorted((tuple(r) for r in compile_query(g, q).collect()), key=str)


@pytest.fixture(scope="module")
def std(spark):
    return standard(spark)


@pytest.fixture(scope="module")
def web(spark):
    return http(spark)


def test_lexer():
    kinds = [(t.kind, t.text) for t in tokens("match (n) /* c */ WHERE n.x = 'it\\'s' // end\n AND n.y >= 1.5")]
    assert ("string", "it's") in kinds and ("number", "1.5") in kinds and ("sign", ">=") in kinds
    assert kinds[0] == ("word", "match") and kinds[-1][0] == "end"
    assert [t.text for t in tokens("*1..3")][:4] == ["*", "1", "..", "3"]
    assert [t.text for t in tokens("a -- comment\nb")][:2] == ["a", "b"]
    with pytest.raises(QueryError):
        tokens("'open")


def test_precedence():
    e = parse("MATCH (n) WHERE NOT n.a = 1 AND n.b = 2 XOR n.c = 3 OR n.d = 4 RETURN n").parts[0].clauses[0].where
    assert e.op == "OR" and e.parts[0].op == "XOR" and e.parts[0].parts[0].op == "AND"
    assert isinstance(e.parts[0].parts[0].parts[0], Logic) and isinstance(e.parts[1], Comparison)


@pytest.mark.parametrize("q", ["MATCH (n RETURN n", "MATCH (n) WHERE n.x RETURN n", "RETURN 1", "MATCH (n) RETURN m", "MATCH (n) WHERE n.x = m RETURN n"])
def test_bad_queries(std, q):
    with pytest.raises(QueryError):
        compile_query(std, q)


@pytest.mark.parametrize("word", ["CREATE", "DELETE", "DETACH", "SET", "REMOVE", "MERGE", "CALL", "FOREACH", "DROP"])
def test_clauses_that_write_are_refused(word):
    with pytest.raises(UnsupportedFeatureError, match=word):
        parse(f"MATCH (n) {word} (n)")


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("MATCH (f:Function) RETURN f.name", [("HandleOrder",), ("LogError",), ("SubmitOrder",), ("ValidateOrder",)]),
        ("MATCH (f:Function {name: 'SubmitOrder'}) RETURN f.qualified_name", [("test.SubmitOrder",)]),
        ("MATCH (f:Function {name: '.*Order$'}) RETURN COUNT(f) AS n", [(3,)]),
        ("MATCH (f)-[:CALLS]->(g) RETURN f.name, g.name", [("HandleOrder", "LogError"), ("HandleOrder", "ValidateOrder"), ("ValidateOrder", "SubmitOrder")]),
        ("MATCH (f {name: 'SubmitOrder'})<-[:CALLS]-(g) RETURN g.name", [("ValidateOrder",)]),
        ("MATCH (f {name: 'ValidateOrder'})-[:CALLS]-(g) RETURN g.name", [("HandleOrder",), ("SubmitOrder",)]),
        ("MATCH (f {name: 'HandleOrder'})-[:CALLS*1..3]->(g) RETURN g.name", [("LogError",), ("SubmitOrder",), ("ValidateOrder",)]),
        ("MATCH (f {name: 'HandleOrder'})-[*2]->(g) RETURN g.name", [("LogError",), ("SubmitOrder",), ("ValidateOrder",)]),
        ("MATCH (f {name: 'HandleOrder'})-[*2..]->(g) RETURN g.name", [("SubmitOrder",)]),
        ("MATCH (f {name: 'HandleOrder'})-[*0..1]->(g) RETURN g.name", [("HandleOrder",), ("LogError",), ("ValidateOrder",)]),
        ("MATCH (m:Module)-[:DEFINES|CALLS]->(g) RETURN m.name, g.name", [("main", "HandleOrder")]),
        ("MATCH (f:Function) WHERE f.start_line > 4 AND f.end_line <= 15 RETURN f.name", [("ValidateOrder",)]),
        ("MATCH (f:Function) WHERE f.name CONTAINS 'Order' AND NOT f.name STARTS WITH 'Handle' RETURN f.name", [("SubmitOrder",), ("ValidateOrder",)]),
        ("MATCH (f) WHERE f.file_path IS NULL RETURN f.name", [("main",)]),
        ("MATCH (f:Function) WHERE f.in_degree = 0 RETURN f.name", [("HandleOrder",)]),
        ("MATCH (f:Function) WHERE f.out_degree >= 2 RETURN f.name, f.out_degree AS o", [("HandleOrder", 2)]),
        ("MATCH (f:Function) OPTIONAL MATCH (f)-[:CALLS]->(g) RETURN f.name AS f, g.name AS g", [("HandleOrder", "LogError"), ("HandleOrder", "ValidateOrder"), ("LogError", None), ("SubmitOrder", None), ("ValidateOrder", "SubmitOrder")]),
        ("MATCH (f)-[:CALLS]->(g) WITH f, COUNT(g) AS n WHERE n > 1 RETURN f.name, f.label, n", [("HandleOrder", "Function", 2)]),
        ("MATCH (f:Function) RETURN f.label AS l, COUNT(*) AS n, COLLECT(f.name) AS names", [("Function", 4, ["HandleOrder", "LogError", "SubmitOrder", "ValidateOrder"])]),
        ("MATCH (f:Function) RETURN f.name ORDER BY f.start_line DESC, f.name SKIP 1 LIMIT 2", [("LogError",), ("ValidateOrder",)]),
        ("MATCH (f) RETURN DISTINCT f.label", [("Function",), ("Module",)]),
        ("MATCH (a)-[:CALLS]->(b)-[:CALLS]->(a) RETURN a.name", []),
        ("MATCH (f:Function) WHERE f.name IN ['LogError', 'x'] OR f.name =~ '^Sub' RETURN f", [("LogError",), ("SubmitOrder",)]),
        ("MATCH (f:Function) WHERE f.name =~ '[' RETURN f", []),
        ("MATCH (f:Function) RETURN CASE WHEN f.start_line >= 10 THEN 'late' WHEN f.start_line > 0 THEN 'early' END AS c, COUNT(*) AS n", [("", 2), ("early", 1), ("late", 1)]),
        ("MATCH (f {name: 'LogError'}) RETURN toUpper(f.name) AS u, toLower(f.name) AS l", [("LOGERROR", "logerror")]),
        ("MATCH (m:Module) RETURN m.name AS x UNION MATCH (m:Module) RETURN m.name AS x", [("main",)]),
        ("MATCH (m:Module) RETURN m.name AS x UNION ALL MATCH (m:Module) RETURN m.name AS x", [("main",), ("main",)]),
        ("MATCH (f)-[:CALLS]->(g) WHERE NOT g.name = 'SubmitOrder' RETURN g.name", [("LogError",), ("ValidateOrder",)]),
        ("MATCH (a {name: 'HandleOrder'}) MATCH (b {name: 'LogError'}) MATCH (a)-[:CALLS]->(b) RETURN a.name, b.name", [("HandleOrder", "LogError")]),
        ("MATCH (b {name: 'LogError'}) MATCH (x)-[:CALLS]->(b) RETURN x.name", [("HandleOrder",)]),
        ("MATCH (a)-[:CALLS]->(b), (b)-[:CALLS]->(c) RETURN a.name, c.name", [("HandleOrder", "SubmitOrder")]),
        ("UNWIND ['a', 'b'] AS x MATCH (m:Module) RETURN x, m.name", [("a", "main"), ("b", "main")]),
        ("MATCH (f:Function) RETURN MIN(f.start_line) AS a, MAX(f.end_line) AS b, SUM(f.start_line) AS s, AVG(f.name) AS z", [(0.0, 30.0, 15.0, 0.0)]),
        ("MATCH (f:Nothing) RETURN COUNT(*) AS n", []),
        ("MATCH (f:Function) WITH f.label AS l, f.name AS n ORDER BY n LIMIT 2 RETURN n", [("HandleOrder",), ("LogError",)]),
        ("MATCH (f:Function) WHERE f.name = 'LogError' XOR f.label = 'Function' RETURN COUNT(*) AS n", [(3,)]),
        ("MATCH (x)-->(y) RETURN COUNT(*) AS n", [(4,)]),
    ],
)
def test_rows(std, q, want):
    assert rows(std, q) == sorted(want, key=str)


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("r.url_path = '/health'", ["HandleHealth"]),
        ("r.url_path CONTAINS 'orders'", ["HandleOrder"]),
        ("r.url_path STARTS WITH '/api'", ["HandleOrder"]),
        ("r.confidence >= 0.6", ["HandleOrder"]),
        ("r.confidence < 0.6", ["HandleHealth"]),
        ("r.method =~ 'P.*'", ["HandleOrder"]),
        ("r.type = 'HTTP_CALLS'", ["HandleHealth", "HandleOrder"]),
        ("r.missing IS NULL", ["HandleHealth", "HandleOrder"]),
    ],
)
def test_edge_properties(web, where, want):
    assert rows(web, f"MATCH (a)-[r:HTTP_CALLS]->(b) WHERE {where} RETURN b.name") == [(w,) for w in want]


def test_titles(std):
    assert compile_query(std, "MATCH (f)-[r:CALLS]->(g) RETURN f, f.name, COUNT(g), CASE WHEN f.name = 'x' THEN 'y' END").columns == ["f", "f.name", "COUNT(g)", "CASE"]
    assert compile_query(std, "MATCH (f)-[r:CALLS]->(g)").columns == ["f.name", "f.qualified_name", "f.label", "g.name", "g.qualified_name", "g.label"]
    assert compile_query(std, "MATCH (f)-[r:CALLS]->(g) RETURN *").columns == ["f.name", "f.qualified_name", "f.label", "f.file_path", "r.type", "g.name", "g.qualified_name", "g.label", "g.file_path"]


def test_plans_have_no_python_and_push_filters(spark):
    from weftgraph.sources.tables import tpch_graph

    df = compile_query(tpch_graph(spark, "/root/testdata/sf0.001"), "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.segment = 'FURNITURE' RETURN c.name AS name, COUNT(o) AS n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "EqualNullSafe(c_mktsegment,FURNITURE)" in plan
    assert plan.count("FileScan") == 2  # the orders' own table isn't needed
    assert "c_acctbal" not in plan


def test_order_of_steps_changes_no_rows(spark):
    """Several MATCH clauses against loops over all assignments, with and without what is
    known of edges that lead to one node."""
    import random

    rng = random.Random(3)
    nodes = [(i, "AB"[i % 2], f"n{i}") for i in range(12)]
    edges = [(k, rng.randrange(12), rng.randrange(12), rng.choice("XY")) for k in range(40)]
    df = spark.createDataFrame([(i, "p", lab, n, n, "", 0, 0, "{}") for i, lab, n in nodes], "id bigint, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string")
    ed = spark.createDataFrame([(k, "p", s, d, t, "{}") for k, s, d, t in edges], "id bigint, project string, src bigint, dst bigint, type string, properties string")
    query = "MATCH (a:A)-[:X]->(b)-[:Y]-(c) MATCH (d)-[:X]->(c), (b)-[:Y]->(e:B) WHERE a.name <> 'n4' RETURN a.name AS a, b.name AS b, c.name AS c, d.name AS d, e.name AS e"
    x, y = [(s, d) for _, s, d, t in edges if t == "X"], [(s, d) for _, s, d, t in edges if t == "Y"]
    both = y + [(d, s) for s, d in y]
    want = sorted(
        tuple(f"n{i}" for i in (a, b, c, d, e))
        for a, b in x
        if a % 2 == 0 and a != 4
        for b2, c in both
        if b2 == b
        for d, c2 in x
        if c2 == c
        for b3, e in y
        if b3 == b and e % 2 == 1
    )
    for single in ({}, {"X": "out", "Y": "in"}):
        got = compile_query(Graph(df, ed, single=single), query)
        assert sorted(map(tuple, got.collect())) == want
