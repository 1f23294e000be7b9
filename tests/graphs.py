"""The graphs of FIXTURES.md as tables."""

from __future__ import annotations

import json

from weftgraph.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph

STANDARD_NODES = [
    (1, "test", "Function", "HandleOrder", "test.HandleOrder", "handler.go", 10, 30, "{}"),
    (2, "test", "Function", "ValidateOrder", "test.ValidateOrder", "validate.go", 5, 15, "{}"),
    (3, "test", "Function", "SubmitOrder", "test.SubmitOrder", "submit.go", 0, 0, "{}"),
    (4, "test", "Module", "main", "test.main", "", 0, 0, "{}"),
    (5, "test", "Function", "LogError", "test.LogError", "log.go", 0, 0, "{}"),
]
STANDARD_EDGES = [(1, 1, 2, "CALLS"), (2, 2, 3, "CALLS"), (3, 1, 5, "CALLS"), (4, 4, 1, "DEFINES")]

HTTP_NODES = [(i + 1, "testproj", "Function", n, f"testproj.{f.split('/')[0]}.{n}", f, 1, 9, "{}") for i, (n, f) in enumerate((("SendOrder", "caller/client.go"), ("HandleOrder", "handler/routes.go"), ("HandleHealth", "handler/health.go")))]
HTTP_EDGES = [(1, 1, 2, "HTTP_CALLS", json.dumps({"url_path": "/api/orders", "confidence": 0.85, "method": "POST"})), (2, 1, 3, "HTTP_CALLS", json.dumps({"url_path": "/health", "confidence": 0.45}))]

ARCH_FUNCTIONS = [
    ("main", "test.cmd.server.main", "cmd/server/main.go", True),
    ("HandleRequest", "test.internal.handler.HandleRequest", "internal/handler/handler.go", True),
    ("ProcessOrder", "test.internal.service.ProcessOrder", "internal/service/service.go", False),
    ("ValidateOrder", "test.internal.service.ValidateOrder", "internal/service/service.go", False),
    ("formatDate", "test.internal.service.formatDate", "internal/service/service.go", False),
    ("TestHandleRequest", "test.internal.handler.handler_test.TestHandleRequest", "internal/handler/handler_test.go", True),
]


def graph(spark, nodes, edges, project=None):
    rows = [(e[0], nodes[0][1], e[1], e[2], e[3], e[4] if len(e) > 4 else "{}") for e in edges]
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(rows, EDGE_SCHEMA), project=project)


def standard(spark):
    return graph(spark, STANDARD_NODES, STANDARD_EDGES)


def http(spark):
    return graph(spark, HTTP_NODES, HTTP_EDGES)


def architecture(spark):
    nodes = [(i + 1, "test", "Function", n, q, f, 1, 9, json.dumps({"is_entry_point": e})) for i, (n, q, f, e) in enumerate(ARCH_FUNCTIONS)]
    nodes.append((20, "test", "Route", "/api/orders", "test.internal.handler.route", "internal/handler/handler.go", 0, 0, json.dumps({"method": "POST", "path": "/api/orders", "handler": "HandleRequest"})))
    for i, f in enumerate(("main.go", "handler.go", "service.go", "model.py", "utils.js")):
        nodes.append((30 + i, "test", "File", f, f"test.{f}", f, 0, 0, "{}"))
    calls = [(1, 2), (2, 3), (3, 4), (3, 5), (6, 2)]
    return graph(spark, nodes, [(i + 1, a, b, "CALLS") for i, (a, b) in enumerate(calls)])


def chain(spark, pairs, type_="CALLS"):
    ids = sorted({x for p in pairs for x in p})
    nodes = [(i, "p", "Function", f"n{i}", f"p.n{i}", f"f{i}.go", 1, 2, "{}") for i in ids]
    return graph(spark, nodes, [(k, a, b, type_) for k, (a, b) in enumerate(pairs)])
