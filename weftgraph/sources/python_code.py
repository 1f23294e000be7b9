"""Extraction records of Python source files, by Python's own parser, file by file on
the executors. Front ends of other languages come as tables of the same form."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind: def, call, import, base, decorator, raise, env. target: a definition's label, an
#: import's name, a call's or decorator's first string.
SCHEMA = "file_path string, kind string, name string, qualified_name string, owner string, target string, start_line int, end_line int"


def module_of(path: str) -> str:
    plain = path.removesuffix(".py").removesuffix("/__init__")
    return "" if plain == "__init__" else plain.replace("/", ".")


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return ".".join(["?", *reversed(parts)]) if parts else ""


def _first_string(node: ast.AST) -> str | None:
    """The first argument of a call that is a string."""
    values = [*node.args, *(k.value for k in node.keywords)] if isinstance(node, ast.Call) else []
    return next((a.value for a in values if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)


def records(path: str, text: str) -> list[tuple]:
    """Of a file that doesn't parse: none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    module, out = module_of(path), []

    def add(kind: str, name: str, owner: str, node: ast.AST, target: str | None = None, qualified: str | None = None) -> None:
        out.append((path, kind, name, qualified, owner, target, getattr(node, "lineno", 0), getattr(node, "end_lineno", 0)))

    stack: list[tuple[ast.AST, str, str]] = [(n, module, "Module") for n in reversed(tree.body)]
    while stack:
        node, owner, inside = stack.pop()
        where, kind = owner, inside
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            own = f"{owner}.{node.name}" if owner else node.name
            label = "Class" if isinstance(node, ast.ClassDef) else "Method" if inside == "Class" else "Function"
            add("def", node.name, owner, node, label, own)
            for d in node.decorator_list:
                add("decorator", _dotted(d.func if isinstance(d, ast.Call) else d), own, d, _first_string(d))
            for b in getattr(node, "bases", []):
                add("base", _dotted(b), own, b)
            where, kind = own, label
        elif isinstance(node, ast.Import):
            for a in node.names:
                add("import", a.asname or a.name, module, node, a.name)
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            for a in node.names:
                add("import", a.asname or a.name, module, node, f"{base}.{a.name}" if base else a.name)
        elif isinstance(node, ast.Call):
            name = _dotted(node.func)
            if name:
                add("call", name, owner, node, _first_string(node))
            if name in ("os.getenv", "os.environ.get") and node.args and isinstance(node.args[0], ast.Constant):
                add("env", str(node.args[0].value), owner, node)
        elif isinstance(node, ast.Raise) and node.exc is not None:
            add("raise", _dotted(node.exc.func if isinstance(node.exc, ast.Call) else node.exc), owner, node)
        stack.extend((c, where, kind) for c in reversed(list(ast.iter_child_nodes(node))))
    return out


def extract(files: DataFrame) -> DataFrame:
    """Records of the files (file_path, text) that end in .py."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, t in zip(pdf["file_path"], pdf["text"], strict=True) for r in records(p, t or "")]
            yield pd.DataFrame(rows, columns=columns)

    return files.where(F.col("file_path").endswith(".py")).select("file_path", "text").mapInPandas(run, SCHEMA)


def definitions(found: DataFrame) -> DataFrame:
    """qualified_name, name, label, module, parent, file_path, start_line, end_line."""
    defs = found.where("kind = 'def'")
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), r"/__init__$", ""), "/", ".")
    return defs.select("qualified_name", "name", F.col("target").alias("label"), module.alias("module"), F.when(F.col("target") == "Method", F.col("owner")).alias("parent"), "file_path", "start_line", "end_line")


def calls(found: DataFrame) -> DataFrame:
    """call_id, caller, module, callee, file, arg."""
    rows = found.where("kind = 'call'")
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), r"/__init__$", ""), "/", ".")
    return rows.select(F.xxhash64("file_path", "owner", "name", "start_line", F.coalesce("target", F.lit(""))).alias("call_id"), F.col("owner").alias("caller"), module.alias("module"), F.col("name").alias("callee"), F.col("file_path").alias("file"), F.col("target").alias("arg")).dropDuplicates(["call_id"])


def imports(found: DataFrame) -> DataFrame:
    """file, key, module."""
    return found.where("kind = 'import'").select(F.col("file_path").alias("file"), F.col("name").alias("key"), F.regexp_replace("target", r"^\.+", "").alias("module"))


def decorated_routes(found: DataFrame) -> DataFrame:
    """function, router, method, path of functions whose decorator is a router's method and
    has a path."""
    verb = F.lower(F.substring_index("name", ".", -1))
    rows = found.where((F.col("kind") == "decorator") & F.col("name").contains(".") & F.col("target").startswith("/"))
    method = F.when(verb.isin("get", "post", "put", "delete", "patch", "head", "options"), F.upper(verb)).when(verb.isin("route", "websocket", "api_route"), "ANY")
    return rows.select(F.col("owner").alias("function"), F.expr("substring_index(name, '.', 1)").alias("router"), method.alias("method"), F.col("target").alias("path")).where("method is not null")
