"""Infrastructure files, line by line: container files, environment files, shell,
Terraform, manifests of packages, compile commands, and URLs in their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_secret


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.posexplode(F.split("text", "\r?\n")).alias("i", "line")).select("file_path", (F.col("i") + 1).alias("line_no"), F.trim("line").alias("line"))


def dockerfile(files: DataFrame) -> DataFrame:
    """file_path, line_no, instruction, value; continued lines are joined."""
    joined = files.select("file_path", F.regexp_replace("text", r"\\\s*\n", " ").alias("text"))
    rows = _lines(joined).select("file_path", "line_no", F.upper(F.regexp_extract("line", r"^([A-Za-z]+)\s", 1)).alias("instruction"), F.regexp_extract("line", r"^[A-Za-z]+\s+(.*)$", 1).alias("value"))
    return rows.where(F.col("instruction").isin("FROM", "RUN", "CMD", "ENTRYPOINT", "EXPOSE", "ENV", "ARG", "WORKDIR", "COPY", "ADD", "USER", "LABEL", "HEALTHCHECK", "VOLUME"))


def assignments(files: DataFrame) -> DataFrame:
    """file_path, line_no, key, value of environment files and shell scripts, secrets left
    out."""
    pattern = r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=(?:\"([^\"]*)\"|'([^']*)'|([^#\s]*))"
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = _lines(files).select("file_path", "line_no", part(1).alias("key"), F.concat(part(2), part(3), part(4)).alias("value"))
    return rows.where((F.col("key") != "") & ~is_secret(F.col("key"), F.col("value")))


def env_urls(bindings: DataFrame) -> DataFrame:
    """Bindings whose value is a URL or an address with a port."""
    return bindings.where(F.col("value").rlike(r"^[a-z][a-z0-9+.-]*://\S+$|^[A-Za-z0-9.-]+:[0-9]{2,5}(/\S*)?$"))


def terraform(files: DataFrame) -> DataFrame:
    """file_path, line_no, block, kind, name."""
    pattern = r"^(resource|data|module|variable|output|provider)\s+\"([^\"]+)\"(?:\s+\"([^\"]+)\")?"
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = _lines(files).select("file_path", "line_no", part(1).alias("block"), part(2).alias("first"), part(3).alias("second")).where("block <> ''")
    return rows.select("file_path", "line_no", "block", F.when(F.col("second") != "", F.col("first")).alias("kind"), F.when(F.col("second") != "", F.col("second")).otherwise(F.col("first")).alias("name"))


def kubernetes(files: DataFrame) -> DataFrame:
    """file_path, kind, name of each document of YAML manifests."""
    docs = files.select("file_path", F.explode(F.split("text", r"(?m)^---\s*$")).alias("doc"))
    field = lambda p: F.regexp_extract("doc", p, 1)
    rows = docs.select("file_path", field(r"(?m)^kind:\s*[\"']?([A-Za-z]+)").alias("kind"), field(r"(?m)^metadata:\s*\n(?:[ \t]+.*\n)*?[ \t]+name:\s*[\"']?([^\s\"']+)").alias("name"))
    return rows.where("kind <> '' and name <> ''")


#: What names a package and its version on a line of a manifest. Fixed values.
MANIFESTS = {
    "requirements.txt": r"^([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*(?:[=<>!~]=?=?\s*([^\s;#]+))?",
    "go.mod": r"^(?:require\s+)?([a-z0-9.\-]+\.[a-z]+/\S+)\s+(v\S+)",
    "Gemfile": r"^gem\s+[\"']([^\"']+)[\"'](?:,\s*[\"']([^\"']+)[\"'])?",
    "Cargo.toml": r"^([A-Za-z0-9_\-]+)\s*=\s*[\"{].*?([0-9][0-9A-Za-z.\-]*)",
    "pyproject.toml": r"^[\"']([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*(?:[=<>!~]=?\s*([^\"',;]+))?",
}


def dependencies(files: DataFrame) -> DataFrame:
    """file_path, name, version of package manifests, by the file's name."""
    name = F.substring_index("file_path", "/", -1)
    rows = []
    package_json = files.where(name == "package.json")
    for section in ("dependencies", "devDependencies"):
        rows.append(package_json.select("file_path", F.explode(F.from_json(F.get_json_object("text", f"$.{section}"), "map<string,string>")).alias("name", "version")))
    for manifest, pattern in MANIFESTS.items():
        lines = _lines(files.where(name == manifest))
        rows.append(lines.select("file_path", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version")).where("name <> ''"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def compile_commands(files: DataFrame) -> DataFrame:
    """file, directory, includes, defines of compilation databases."""
    items = files.select(F.explode(F.from_json("text", "array<struct<directory:string,file:string,command:string,arguments:array<string>>>")).alias("e")).select("e.*")
    words = F.coalesce("arguments", F.split("command", r"\s+"))
    flags = lambda f: F.transform(F.filter(words, lambda w: w.startswith(f)), lambda w: F.substr(w, F.lit(3)))
    return items.select("file", "directory", flags("-I").alias("includes"), flags("-D").alias("defines"))


def path_aliases(files: DataFrame) -> DataFrame:
    """file_path, alias, target of TypeScript configurations."""
    paths = F.from_json(F.get_json_object("text", "$.compilerOptions.paths"), "map<string,array<string>>")
    return files.select("file_path", F.explode(paths).alias("alias", "targets")).select("file_path", "alias", F.explode("targets").alias("target"))


def _package(files: DataFrame, which, name, entry: str) -> DataFrame:
    """Of the files for which a condition holds: name and the folder of its sources."""
    folder = F.regexp_extract("file_path", "^(.*/)?[^/]*$", 1)
    own = files.where(which).select("file_path", name.alias("name"), folder.alias("folder")).where("name <> ''")
    return own.select("file_path", "name", F.rtrim(F.concat("folder", F.expr(entry)), F.lit("/")).alias("entry"))


def packages(files: DataFrame) -> DataFrame:
    """file_path, name, entry: the packages that manifests declare and the folder, below the
    root, where their sources are."""
    base = F.substring_index("file_path", "/", -1)
    field = lambda p: F.regexp_extract("text", p, 1)
    section = lambda s: F.regexp_extract("text", rf"(?ms)^\[{s}\]\s*$(.*?)(?=^\[|\z)", 1)
    quoted = lambda c: F.regexp_extract(c, r"(?m)^\s*name\s*=\s*[\"']([^\"']+)", 1)
    json = F.coalesce(F.get_json_object("text", "$.name"), F.lit(""))
    python = F.coalesce(F.nullif(quoted(section("project")), F.lit("")), quoted(section(r"tool\.poetry")))
    own = F.regexp_replace("text", r"(?s)<(parent|dependencies|dependencyManagement|build|profiles)>.*?</\1>", "")
    group, artifact = F.regexp_extract(own, r"<groupId>\s*([^<\s]+)", 1), F.regexp_extract(own, r"<artifactId>\s*([^<\s]+)", 1)
    both = F.when((group != "") & (artifact != ""), F.concat(group, F.lit("."), artifact)).otherwise("")
    parts = [
        _package(files, base == "package.json", json, "''"),
        _package(files, base == "go.mod", field(r"(?m)^module\s+(\S+)"), "''"),
        _package(files, base == "Cargo.toml", quoted(section("package")), "'src'"),
        _package(files, base == "pyproject.toml", python, "regexp_replace(name, '-', '_')"),
        _package(files, base == "composer.json", json, "''"),
        _package(files, base == "pubspec.yaml", field(r"(?m)^name:\s*[\"']?([^\s\"'#]+)"), "'lib'"),
        _package(files, base == "pom.xml", both, "'src/main/java'"),
        _package(files, base == "pom.xml", F.when(both != "", group).otherwise(""), "'src/main/java'"),
        _package(files, base.isin("build.gradle", "build.gradle.kts"), field(r"(?m)^\s*group\s*=?\s*[\"']([^\"']+)"), "'src/main/java'"),
        _package(files, base == "mix.exs", field(r"\bapp:\s*:(\w+)"), "concat('lib/', name)"),
        _package(files, base.endswith(".gemspec"), field(r"\.name\s*=\s*[\"']([^\"']+)"), "concat('lib/', name)"),
    ]
    psr4 = F.from_json(F.get_json_object("text", '$.autoload.psr-4'), "map<string,string>")
    folder = F.regexp_extract("file_path", "^(.*/)?[^/]*$", 1)
    spaces = files.where(base == "composer.json").select("file_path", folder.alias("folder"), F.explode(psr4).alias("name", "below"))
    parts.append(spaces.select("file_path", F.rtrim(F.col("name"), F.lit("\\")).alias("name"), F.rtrim(F.concat("folder", "below"), F.lit("/")).alias("entry")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
