"""Signals of how functions are related, from their records.

fields: id, field, token (name, callee, body, signature, param, pattern, path, type,
decorator); profiles: id and 25 figures of a function's syntax tree.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .similarity import document_frequency, sparse_cosine, tfidf

#: Signals that come from tokens, and the fields each of them uses. Fixed values.
TOKEN_SIGNALS = {"tfidf": ("name", "callee", "body", "signature", "param", "pattern", "path"), "api": ("callee",), "type": ("type",), "decorator": ("decorator",)}


def token_signals(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Adds a cosine per token signal to pairs (a, b); 0 where a side has no token."""
    out = pairs
    for name, used in TOKEN_SIGNALS.items():
        own = fields.where(F.col("field").isin(*used))
        docs = own.groupBy("id").agg(F.collect_set("token").alias("t"))
        scored = sparse_cosine(pairs.select("a", "b"), tfidf(own, document_frequency(docs, "t"))).withColumnRenamed("score", name)
        out = out.join(scored, ["a", "b"], "left").na.fill(0.0, [name])
    return out


#: Kinds of nodes counted in a profile, 20 of its 25 figures. Fixed values.
PROFILE_NODES = ("If", "For", "While", "Try", "With", "Return", "Raise", "Call", "Assign", "AugAssign", "BinOp", "BoolOp", "Compare", "Subscript", "Attribute", "Lambda", "ListComp", "DictComp", "Await", "Yield")


def profile(text: str) -> list[float]:
    """Shares of the kinds of nodes, and then depth, nodes, lines, names and constants, each
    scaled to between 0 and 1; zeros for what doesn't parse."""
    size = len(PROFILE_NODES) + 5
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [0.0] * size
    counts, depth, names, constants, nodes = dict.fromkeys(PROFILE_NODES, 0), 0, 0, 0, 0
    stack: list[tuple[ast.AST, int]] = [(tree, 0)]
    while stack:
        node, level = stack.pop()
        nodes, depth = nodes + 1, max(depth, level)
        kind = type(node).__name__
        if kind in counts:
            counts[kind] += 1
        names += kind == "Name"
        constants += kind == "Constant"
        stack.extend((c, level + 1) for c in ast.iter_child_nodes(node))
    squash = lambda x, half: x / (x + half)
    return [counts[k] / nodes for k in PROFILE_NODES] + [squash(depth, 10), squash(nodes, 100), squash(text.count("\n") + 1, 20), names / nodes, constants / nodes]


def profiles(functions: DataFrame) -> DataFrame:
    """id, profile of functions (id, text)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "profile": [profile(t or "") for t in pdf["text"]]})

    return functions.select("id", "text").mapInPandas(run, "id bigint, profile array<double>")


def vector_signal(pairs: DataFrame, vectors: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the cosine of the sides' vectors (id, column), 0 where one has none."""
    a, b = vectors.select(F.col("id").alias("a"), F.col(column).alias("_x")), vectors.select(F.col("id").alias("b"), F.col(column).alias("_y"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.withColumn(name, F.coalesce(cosine(F.col("_x"), F.col("_y")), F.lit(0.0))).drop("_x", "_y")


def document_vectors(fields: DataFrame, tokens: DataFrame, idf: DataFrame) -> DataFrame:
    """id, vector: the sum of a function's token vectors (token, vector) by their weights."""
    weights = tfidf(fields, idf).join(tokens, "token")
    dims = weights.select("id", "weight", F.posexplode("vector").alias("k", "x"))
    sums = dims.groupBy("id", "k").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("e")).select("id", F.col("e.x").alias("vector"))
