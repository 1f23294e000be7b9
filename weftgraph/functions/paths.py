"""Paths, qualified names, URLs, spans and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension. Fixed values.
LANGUAGES = {
    ".py": "Python", ".go": "Go", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".rs": "Rust", ".java": "Java",
    ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C", ".h": "C", ".cs": "C#", ".php": "PHP", ".lua": "Lua",
    ".scala": "Scala", ".kt": "Kotlin", ".rb": "Ruby", ".sh": "Bash", ".bash": "Bash", ".zig": "Zig", ".ex": "Elixir", ".exs": "Elixir",
    ".hs": "Haskell", ".ml": "OCaml", ".mli": "OCaml", ".html": "HTML", ".css": "CSS", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML",
    ".hcl": "HCL", ".tf": "HCL", ".sql": "SQL", ".erl": "Erlang", ".swift": "Swift", ".dart": "Dart", ".groovy": "Groovy", ".pl": "Perl",
    ".r": "R", ".scss": "SCSS", ".vue": "Vue", ".svelte": "Svelte",
}


def package(qn: Column) -> Column:
    """The third part of a qualified name with at least four, else the second."""
    parts = F.split(qn, r"\.")
    return F.when(F.size(parts) >= 4, parts[2]).when(F.size(parts) >= 2, parts[1]).otherwise(F.lit(""))


def top_package(qn: Column) -> Column:
    parts = F.split(qn, r"\.")
    return F.when(F.size(parts) >= 2, parts[1]).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in sorted(LANGUAGES.items()) for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(""))


#: Languages by the whole name of a file. Fixed values.
FILE_NAMES = {
    "CMakeLists.txt": "CMake", "Dockerfile": "Dockerfile", "GNUmakefile": "Makefile", "Makefile": "Makefile", "makefile": "Makefile", "meson.build": "Meson", "meson.options": "Meson", "meson_options.txt": "Meson",
    "kustomization.yaml": "Kustomize", "kustomization.yml": "Kustomize", ".vimrc": "Vimscript", ".zshrc": "Zsh", ".zshenv": "Zsh", ".zprofile": "Zsh", "justfile": "Just", "Justfile": "Just", ".justfile": "Just",
    "hyprland.conf": "Hyprlang", "ssh_config": "SSH config", "sshd_config": "SSH config", "BUILD": "Starlark", "BUILD.bazel": "Starlark", "WORKSPACE": "Starlark", "WORKSPACE.bazel": "Starlark",
    "requirements.txt": "Requirements", "requirements-dev.txt": "Requirements", "requirements-test.txt": "Requirements", "Kconfig": "Kconfig", "go.mod": "Go module",
}


def file_language(path: Column, text: Column | None = None) -> Column:
    """By the file's name, then by its extension. What .m means is told by the text, if it
    is given: Objective-C by its directives, Magma by its way to end blocks, else MATLAB."""
    named = F.create_map(*[F.lit(x) for pair in FILE_NAMES.items() for x in pair])
    body = F.lit("") if text is None else F.coalesce(text, F.lit(""))
    m = F.when(body.rlike(r"(?m)^\s*(?:@interface|@implementation|@protocol|@property|@end\b|#import)"), "Objective-C").when(body.rlike(r"(?m)^\s*end (?:function|procedure|intrinsic|if|for|while);"), "Magma").otherwise("MATLAB")
    return F.coalesce(F.try_element_at(named, F.substring_index(path, "/", -1)), F.when(extension(path) == ".m", m).otherwise(language(path)))


def mentions_test(path: Column) -> Column:
    """The widest test of the three: the path has `test` in it."""
    return F.coalesce(path.contains("test"), F.lit(False))


def is_test_file(path: Column) -> Column:
    """By the usual places and names of test files."""
    return F.coalesce(path.rlike(r"(^|/)(tests?|__tests__|spec)/|_test\.|\.test\.|\.spec\.|(^|/)test_"), F.lit(False))


def is_test_function(path: Column, name: Column) -> Column:
    """A test by its file and its language's convention for names."""
    ext = extension(path)
    named = F.when(ext == ".go", name.rlike("^(Test|Benchmark|Example|Fuzz)")).when(ext == ".py", name.startswith("test_") | name.startswith("Test"))
    return is_test_file(path) & F.coalesce(named.otherwise(name.rlike("(?i)test|^it$|^describe$")), F.lit(False))


def url_path(url: Column) -> Column:
    """From the third slash up to a question mark; a fragment stays."""
    return F.regexp_extract(url, r"^[^/]*/[^/]*/[^/]*(/[^?]*)", 1)


def risk(hop: Column) -> Column:
    return F.when(hop == 1, "CRITICAL").when(hop == 2, "HIGH").when(hop == 3, "MEDIUM").otherwise("LOW")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.45, "medium").when(c >= 0.25, "speculative").otherwise("")


def proximity(a: Column, b: Column) -> Column:
    """1 and a tenth of the share of directories that two paths begin with."""
    x, y = F.split(a, "/"), F.split(b, "/")
    # directories: all parts but the last
    n = F.greatest(F.size(x), F.size(y)) - 1
    m = F.least(F.size(x), F.size(y)) - 1
    equal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda acc, i: F.struct(
            F.when(acc.go & (i <= m) & (F.try_element_at(x, i) == F.try_element_at(y, i)), acc.n + 1).otherwise(acc.n).alias("n"),
            (acc.go & (i <= m) & (F.try_element_at(x, i) == F.try_element_at(y, i))).alias("go"),
        ),
        lambda acc: acc.n,
    )
    return F.lit(1.0) + F.when(n > 0, F.lit(0.1) * equal / n).otherwise(F.lit(0.0))


def module_name(project: Column, path: Column) -> Column:
    """Dotted name of a file; a package's own file has the package's name."""
    plain = F.regexp_replace(path, r"\.[^./]*$", "")
    plain = F.regexp_replace(plain, r"(^|/)(__init__|index)$", "")
    return F.concat_ws(".", project, F.when(plain != "", F.regexp_replace(plain, "/", ".")))


def qualified_name(project: Column, path: Column, name: Column) -> Column:
    return F.concat_ws(".", module_name(project, path), name)


def folder_name(project: Column, path: Column) -> Column:
    return F.concat_ws(".", project, F.when(path != "", F.regexp_replace(path, "/", ".")))


def relative_import(module: Column, target: Column) -> Column:
    """Module named by a target with leading dots, seen from a module: one dot is the
    module's package, each more is one level up."""
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    parts = F.split(module, r"\.")
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0)))
    rest = F.regexp_replace(target, r"^\.+", "")
    return F.when(dots == 0, target).otherwise(F.concat_ws(".", F.array_join(base, "."), F.when(rest != "", rest)))


def hunk(line: Column) -> dict[str, Column]:
    """old_start, old_count, new_start, new_count of a `@@ -a,b +c,d @@` line; a count
    that isn't there is 1."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.regexp_extract(line, pattern, i)
    number = lambda c: F.when(c != "", c).try_cast("int")
    return {"old_start": number(part(1)), "old_count": F.coalesce(number(part(2)), F.lit(1)), "new_start": number(part(3)), "new_count": F.coalesce(number(part(4)), F.lit(1))}


def attribute(attrs: Column, *names: str) -> Column:
    """The first of the names that a map of attributes has, else empty."""
    return F.coalesce(*[F.try_element_at(attrs, F.lit(n)) for n in names], F.lit(""))


def http_info(attrs: Column) -> dict[str, Column]:
    full = attribute(attrs, "url.full", "http.url")
    path = attribute(attrs, "http.route", "http.target", "url.path")
    return {
        "method": attribute(attrs, "http.method", "http.request.method"),
        "path": F.when(path != "", path).otherwise(url_path(full)),
        "status": attribute(attrs, "http.status_code", "http.response.status_code"),
    }


def service_name(attrs: Column) -> Column:
    return attribute(attrs, "service.name")


def duration(start: Column, end: Column) -> Column:
    """Of two texts of nanoseconds, never negative."""
    return F.greatest(F.coalesce(end.try_cast("bigint") - start.try_cast("bigint"), F.lit(0)), F.lit(0))
