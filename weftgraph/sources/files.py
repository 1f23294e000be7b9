"""File discovery: a walk that leaves out folders of no interest, filtered by ignore
rules, by language and by size, on the executors.

Spark's own readers don't list names that begin with `_` or `.`, of which `__init__.py`
and `.gitignore` are two; so folders are walked and files read here.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_language

# Folders, endings, names and parts of names that are left out: the first two always, the
# others in every mode but `full`. Fixed values.

SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", ".worktrees",
    ".idea", ".vs", ".vscode", ".eclipse", ".claude",
    ".cache", ".eggs", ".env", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "env", "htmlcov", "site-packages", "venv",
    ".npm", ".nyc_output", ".pnpm-store", ".yarn", "bower_components", "coverage", "node_modules", ".next", ".nuxt", ".svelte-kit", ".angular", ".turbo", ".parcel-cache", ".docusaurus", ".expo",
    "dist", "obj", "Pods", "target", "temp", "tmp", ".terraform", ".serverless", "bazel-bin", "bazel-out", "bazel-testlogs",
    ".cargo", ".stack-work", ".dart_tool", "zig-cache", "zig-out", ".metals", ".bloop", ".bsp", ".ccls-cache", ".clangd", "elm-stuff", "_opam", ".cpcache", ".shadow-cljs",
    ".vercel", ".netlify",
    ".qdrant_code_embeddings", ".tmp", "vendor", "vendored",
)

SKIPPED_ENDINGS = (
    ".tmp", "~", ".pyc", ".pyo", ".o", ".a", ".so", ".dll", ".class", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".tiff", ".webp", ".svg", ".wasm", ".node", ".exe", ".bin", ".dat", ".db",
    ".sqlite", ".sqlite3", ".woff", ".woff2", ".ttf", ".eot", ".otf",
)

FAST_FOLDERS = (
    "generated", "gen", "auto-generated", "fixtures", "testdata", "test_data", "__tests__", "__mocks__", "__snapshots__", "__fixtures__", "__test__", "docs", "doc", "documentation",
    "examples", "example", "samples", "sample", "assets", "static", "public", "media", "third_party", "thirdparty", "3rdparty", "external", "migrations", "seeds", "e2e", "integration",
    "locale", "locales", "i18n", "l10n", "scripts", "tools", "hack", "bin", "build", "out",
)

FAST_ENDINGS = (
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".rar", ".7z", ".jar", ".war", ".ear", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".flac", ".ogg", ".mkv", ".webm", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".ppt", ".pptx", ".odt", ".ods", ".map", ".min.js", ".min.css", ".pem", ".crt", ".key", ".cer", ".p12", ".pb", ".avro", ".parquet", ".beam", ".elc", ".rlib", ".coverage", ".prof", ".out", ".patch", ".diff",
)

FAST_NAMES = (
    "LICENSE", "LICENSE.txt", "LICENSE.md", "LICENSE-MIT", "LICENSE-APACHE", "LICENCE", "LICENCE.txt", "LICENCE.md", "CHANGELOG", "CHANGELOG.md", "CHANGES.md", "HISTORY", "HISTORY.md", "AUTHORS", "AUTHORS.md",
    "CONTRIBUTORS", "CONTRIBUTORS.md", "CODEOWNERS", "go.sum", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "Gemfile.lock", "Cargo.lock", "mix.lock", "flake.lock", "pubspec.lock", "composer.lock",
    "package-lock.json", "configure", "Makefile.in", "config.guess", "config.sub",
)

FAST_PARTS = (".d.ts", ".bundle.", ".chunk.", ".generated.", ".pb.go", "_pb2.py", ".pb2.py", "_grpc.pb.go", "_string.go", "mock_", "_mock.", "_test_helpers.", ".stories.", ".spec.", ".test.")

MODES = ("full", "moderate", "fast")

LISTED = "file_path string, size bigint, mtime timestamp"

#: Files are handed on in batches of so many bytes.
BATCH_BYTES = 8 << 20


def ignore_pattern(rule: str) -> tuple[str, bool] | None:
    """A line of an ignore file as a pattern over relative paths, and whether it brings
    back what others left out; None for comments and blank lines."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    back = rule.startswith("!")
    rule = rule.removeprefix("!")
    folder = rule.endswith("/")
    rule = rule.strip("/") if folder else rule
    anchored = "/" in rule.strip("/") or rule.startswith("/")
    rule = rule.lstrip("/")
    out = []
    for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", rule):
        out.append({"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, part if part.startswith("[") else re.escape(part)))
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if folder else "(?:/|$)"), back


def ignored(path: Column, rules: Iterable[str]) -> Column:
    """By the last rule that matches."""
    out = F.lit(False)
    for found in map(ignore_pattern, rules):
        if found is not None:
            pattern, back = found
            out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def _one_of(values: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(v) for v in values) + ")"


def skipped_folders(mode: str) -> tuple[str, ...]:
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    return SKIPPED_FOLDERS if mode == "full" else SKIPPED_FOLDERS + FAST_FOLDERS


def wanted(path: Column, rules: Iterable[str] = (), known_languages: bool = True, mode: str = "full") -> Column:
    fast = mode != "full"
    name = F.substring_index(path, "/", -1)
    keep = ~path.rlike(rf"(?:^|/){_one_of(skipped_folders(mode))}/") & ~name.rlike(_one_of(SKIPPED_ENDINGS + (FAST_ENDINGS if fast else ())) + "$") & ~ignored(path, rules)
    if fast:
        keep = keep & ~name.isin(*FAST_NAMES) & ~name.rlike(_one_of(FAST_PARTS))
    return keep & (file_language(path) != "") if known_languages else keep


def folder_rules(ignore_files: DataFrame) -> DataFrame:
    """folder, place, pattern, back of the rules in ignore files (file_path, text); the root
    is the empty folder, every other one ends in a slash."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["file_path"], pdf["text"], strict=True):
                folder = path[: path.rfind("/") + 1]
                found = ((i, ignore_pattern(line)) for i, line in enumerate((text or "").splitlines()))
                rows += [(folder, i, *p) for i, p in found if p is not None]
            yield pd.DataFrame(rows, columns=["folder", "place", "pattern", "back"])

    return ignore_files.select("file_path", "text").mapInPandas(run, "folder string, place int, pattern string, back boolean")


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (file_path, ...) that the last matching rule of the deepest folder above them
    doesn't leave out. Paths alone are joined with the rules of their folders."""
    parts = F.split("file_path", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    placed = files.select("file_path", F.explode(above).alias("folder"))
    met = placed.join(rules, "folder").where(F.rlike(F.expr("substr(file_path, length(folder) + 1)"), F.col("pattern")))
    last = met.groupBy("file_path").agg(F.max_by("back", F.struct(F.length("folder"), "place")).alias("back"))
    return files.join(last.where("not back").select("file_path"), "file_path", "left_anti")


def _at(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if re.match("[a-z][a-z0-9+.-]*:", root) else os.path.abspath(root))


def _entries(root: str, folder: str) -> list[fs.FileInfo]:
    """Of a folder below the root, without symbolic links."""
    system, base = _at(root)
    local = isinstance(system, fs.LocalFileSystem)
    return [e for e in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))) if not (local and os.path.islink(e.path))]


def _walk(root: str, folder: str, deep: bool, skipped: frozenset[str]) -> Iterator[tuple]:
    stack = [folder]
    while stack:
        here = stack.pop()
        for e in _entries(root, here):
            path = f"{here}/{e.base_name}".lstrip("/")
            if e.type == fs.FileType.File:
                yield path, e.size, e.mtime.replace(tzinfo=None)
            elif deep and e.base_name not in skipped:
                stack.append(path)


def listing(spark: SparkSession, root: str, mode: str = "full") -> DataFrame:
    """file_path (below root), size and mtime (in UTC) of the files below a folder: a task
    walks each folder of the root."""
    skipped = frozenset(skipped_folders(mode))
    tops = [("", False)] + [(e.base_name, True) for e in _entries(root, "") if e.type == fs.FileType.Directory and e.base_name not in skipped]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, deep in zip(pdf["folder"], pdf["deep"], strict=True):
                rows = list(_walk(root, folder, deep, skipped))
                yield pd.DataFrame(rows, columns=["file_path", "size", "mtime"]).astype({"file_path": object, "size": "int64", "mtime": "datetime64[us]"})

    folders = spark.createDataFrame(tops, "folder string, deep boolean")
    return folders.repartition(min(len(tops), 10_000), "folder").mapInPandas(run, LISTED)


def with_text(listed: DataFrame, root: str) -> DataFrame:
    """Adds the files' text; bytes that aren't UTF-8 are replaced."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _at(root)
        for pdf in batches:
            start, held = 0, 0
            texts: list[str] = []
            for i, path in enumerate(pdf["file_path"]):
                with system.open_input_stream(f"{base}/{path}") as f:
                    texts.append(f.read().decode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= BATCH_BYTES or i + 1 == len(pdf):
                    yield pdf.iloc[start : i + 1].assign(text=texts)
                    start, held, texts = i + 1, 0, []

    return listed.select("file_path", "size", "mtime").repartition("file_path").mapInPandas(run, LISTED + ", text string")


def discover(spark: SparkSession, root: str, rules: Iterable[str] = (), known_languages: bool = True, max_bytes: int = 10 << 20, mode: str = "full", ignore_files: str = ".gitignore") -> DataFrame:
    """file_path (below root), size, mtime and text of the files below a folder, without
    those that rules, or ignore files in any folder, leave out. mode: full; moderate and
    fast also leave out generated files, examples, archives and the like."""
    files = listing(spark, root, mode)
    found = files.where((F.col("size") <= max_bytes) & wanted(F.col("file_path"), rules, known_languages, mode))
    own = folder_rules(with_text(files.where(F.substring_index("file_path", "/", -1) == ignore_files), root))
    return with_text(not_ignored(found, own), root)


def file_states(found: DataFrame) -> DataFrame:
    """rel_path, mtime_ns, size, sha256: what change detection compares."""
    return found.select(F.col("file_path").alias("rel_path"), (F.unix_micros("mtime") * 1000).alias("mtime_ns"), "size", F.sha2(F.col("text"), 256).alias("sha256"))
