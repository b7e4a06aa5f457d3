"""Entries of lockfiles and names of dependencies in the manifests of each ecosystem.

Line-wise formats are counted over lines, whose blocks an automaton joins (scans.states), so a long lockfile is many tasks;
manifests are read by columns of their own row. Whole files are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename
from .dependencies import LOCKFILES, dep_name, lockfiles, npm_names, requirement_name
from .scans import filled, lines, states

# Patterns that decide the results.
QUOTED = r"""['"]([^'"\n]+)['"]"""
GEM = r"""(?m)^\s*gem\s+['"]([^'"]+)['"]"""
POM = r"<(groupId|artifactId)>\s*([^<\s]+)\s*</\1>"
GRADLE = r"""['"]([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+)(?::[^'"]*)?['"]"""
GO_MODULE = r"(?m)^\s*(?:require\s+)?([a-z0-9][a-z0-9.-]*\.[a-z]{2,}/[^\s]+)\s+v\d"
SETUP_PY = r"(?s)(?:install_requires|extras_require|setup_requires|tests_require)\s*=\s*[\[{](.*?)[\]}]"
NPM_MEMBERS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
CARGO_TABLES = ["dependencies", "dev-dependencies", "build-dependencies", "workspace.dependencies"]
YAML_SECTIONS = {"environment.yml": ["dependencies", "pip"], "environment.yaml": ["dependencies", "pip"], "pubspec.yaml": ["dependencies", "dev_dependencies"]}
UPDATE_TOOLS = [
    ("Dependabot", [".github/dependabot.yml", ".github/dependabot.yaml"]),
    ("Renovate", ["renovate.json", ".renovaterc", ".renovaterc.json"]),
]
PYTHON_MANIFESTS = ["pyproject.toml", "requirements.txt", "Pipfile", "setup.py", "setup.cfg"]
# End of the fixed values.


def locked_entries(files: DataFrame) -> DataFrame:
    """Lockfiles (repo_id, path, content) -> (repo_id, path, entries): what each pins, counted as its format admits.

    JSON: members of `packages`, else of `dependencies`. yarn: empty lines that end an entry. pnpm: keys below the margin that
    are paths. TOML: package tables. go.sum: two lines a module. Gemfile.lock: lines two or three deep after `specs:`. The other
    formats count nothing, as does broken JSON. Null contents are empty.
    """
    name = basename(F.col("path"))
    files = files.where(name.isin(LOCKFILES)).select("repo_id", "path", F.coalesce("content", F.lit("")).alias("content"))
    json = F.coalesce(*(F.coalesce(F.size(F.map_keys(F.from_json(F.get_json_object("content", f"$.{m}"), "map<string,string>"))), F.size(F.from_json(F.get_json_object("content", f"$.{m}"), "array<string>"))) for m in ("packages", "dependencies")), F.lit(0))
    members = files.where(name == "package-lock.json").select("repo_id", "path", json.cast("long").alias("entries"))
    text, blank = F.col("text"), F.col("text") == ""
    kind = {n: name == n for n in LOCKFILES}
    # Two states. yarn: whether a line end waits for a second one. Gemfile: whether `specs:` has been seen.
    flip, one = F.array(F.lit(1), F.lit(0)), F.array(F.lit(1), F.lit(1))
    step = F.when(kind["yarn.lock"], F.when(blank, flip).otherwise(one)).when(kind["Gemfile.lock"] & (F.trim(text) == "specs:"), one)
    rows = states(lines(files.where(name != "package-lock.json")), ["repo_id", "path"], "line", step, 2)
    tables = F.regexp_count(text, F.lit(r"\[\[package\]\]"))
    own = (
        F.when(kind["yarn.lock"], (blank & (F.col("state") == 1)).cast("long"))
        .when(kind["pnpm-lock.yaml"], ((F.col("line") > 0) & text.startswith("  /")).cast("long"))
        .when(kind["poetry.lock"] | kind["Cargo.lock"], tables.cast("long"))
        .when(kind["Gemfile.lock"], ((F.col("state") == 1) & text.startswith("  ") & ~text.startswith("    ") & (F.trim(text) != "specs:")).cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )
    # What stands after the last line end is a line, but has no end of its own.
    sums = rows.groupBy("repo_id", "path").agg(F.sum(own).alias("n"), F.max("line").alias("ends"), F.max_by(own, "line").alias("last"))
    total = F.when(kind["go.sum"], F.floor(F.col("ends") / 2)).when(kind["yarn.lock"], F.col("n") - F.col("last")).otherwise(F.col("n"))
    return members.unionByName(sums.select("repo_id", "path", total.cast("long").alias("entries")))


def transitive_counts(files: DataFrame) -> DataFrame:
    """(repo_id, total_transitive_deps): entries of the first lockfile of each format outside of vendored folders."""
    chosen = lockfiles(files).select("repo_id", "path")
    return locked_entries(files.join(chosen, ["repo_id", "path"], "left_semi")).groupBy("repo_id").agg(F.sum("entries").alias("total_transitive_deps"))


def _sections(content: Column) -> Column:
    """Array of (table, body) of a TOML file: plain tables only, the lines before the first one as the table ''."""
    head = r"(?m)^[ \t]*\[[^\[\]\n]+\][ \t]*(?:#.*)?$"
    names = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*\[([^\[\]\n]+)\][ \t]*(?:#.*)?$"), 1), lambda n: F.regexp_replace(F.trim(n), r"""["']|\s*(?=[.])|(?<=[.])\s*""", ""))
    return F.zip_with(F.concat(F.array(F.lit("")), names), F.split(content, head, -1), lambda n, b: F.struct(n.alias("table"), b.alias("body")))


def _keys(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"""(?m)^[ \t]*["']?([A-Za-z0-9_.@/-]+)["']?[ \t]*="""), 1)


def _quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""("(?:[^"\\\n]|\\.)*"|'[^'\n]*')"""), 1)


def toml_names(content: Column, tables: list[str]) -> Column:
    """Keys of the named tables (a trailing ".*" takes the tables below), and tables that are members of one."""
    plain = [t for t in tables if "*" not in t]

    def of(s: Column) -> Column:
        below = [F.when(s["table"].startswith(t + "."), F.array(F.split(F.regexp_replace(s["table"], "^" + t.replace(".", "[.]") + "[.]", ""), "[.]")[0])) for t in plain]
        nested = [F.when(s["table"].rlike("^" + t.replace(".", "[.]").replace("*", r"[^.]+") + "$"), _keys(s["body"])) for t in tables if "*" in t]
        return F.coalesce(F.when(s["table"].isin(plain), _keys(s["body"])), *below, *nested, F.array().cast("array<string>"))

    return F.flatten(F.transform(_sections(content), of))


def toml_requirements(content: Column, members: list[tuple[str, str]]) -> Column:
    """Strings of array members: (table, key), where the key ".*" stands for each key of the table."""

    def of(s: Column) -> Column:
        found = []
        for table, key in members:
            name = r"""["']?[A-Za-z0-9_.-]+["']?""" if key == "*" else key.replace("-", "[-]")
            arrays = F.regexp_extract_all(s["body"], F.lit(rf"(?ms)^[ \t]*{name}[ \t]*=[ \t]*\[(.*?)\][ \t]*(?:#[^\n]*)?$"), 1)
            found.append(F.when(s["table"] == table, F.flatten(F.transform(arrays, lambda a: _quoted(F.regexp_replace(a, r"\{[^{}]*\}", ""))))))
        return F.flatten(F.array_compact(F.array(*found)))

    return F.flatten(F.transform(_sections(content), of))


def declared_names(files: DataFrame) -> DataFrame:
    """Manifests at the root (repo_id, path, content) -> distinct (repo_id, ecosystem, name), as keywords are held against them.

    package.json, requirements, pyproject.toml (project, groups, build, poetry), Pipfile, setup.py, setup.cfg, conda
    environments, go.mod, Cargo.toml, Gemfile, composer.json, pom.xml, Gradle builds, pubspec.yaml. Broken JSON gives no names.
    """
    path, text = F.col("path"), F.coalesce("content", F.lit(""))
    here = files.where(~path.contains("/"))
    requirements = lambda specs: F.transform(specs, lambda s: requirement_name(F.regexp_replace(F.trim(s), r"""^["']+|["']+$""", "")))
    plain = lambda names: F.transform(names, dep_name)
    pyproject = F.concat(
        requirements(toml_requirements(text, [("project", "dependencies"), ("project.optional-dependencies", "*"), ("dependency-groups", "*"), ("build-system", "requires")])),
        plain(toml_names(text, ["tool.poetry.dependencies", "tool.poetry.dev-dependencies", "tool.poetry.group.*.dependencies"])),
    )
    setup = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SETUP_PY), 1), lambda b: F.regexp_extract_all(b, F.lit(QUOTED), 1)))
    table = [
        (path == "package.json", "npm", plain(F.flatten(F.array(*(npm_names(text, m) for m in NPM_MEMBERS))))),
        (path.isin("requirements.txt", "requirements-dev.txt"), "pypi", requirements(F.transform(F.split(text, r"\r?\n"), lambda s: F.split(s, "#", 2)[0]))),
        (path == "pyproject.toml", "pypi", pyproject),
        (path == "Pipfile", "pypi", plain(toml_names(text, ["packages", "dev-packages"]))),
        (path == "setup.py", "pypi", requirements(setup)),
        (path == "go.mod", "go", plain(F.regexp_extract_all(text, F.lit(GO_MODULE), 1))),
        (path == "Cargo.toml", "cargo", plain(toml_names(text, CARGO_TABLES))),
        (path == "Gemfile", "gem", plain(F.regexp_extract_all(text, F.lit(GEM), 1))),
        (path == "composer.json", "composer", plain(F.flatten(F.array(*(npm_names(text, m) for m in ("require", "require-dev")))))),
        (path == "pom.xml", "maven", plain(F.regexp_extract_all(text, F.lit(POM), 2))),
        (path.isin("build.gradle", "build.gradle.kts"), "maven", plain(F.regexp_extract_all(text, F.lit(GRADLE), 1))),
    ]
    names, ecosystem = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for when, eco, found in reversed(table):
        names, ecosystem = F.when(when, found).otherwise(names), F.when(when, eco).otherwise(ecosystem)
    inline = here.select("repo_id", ecosystem.alias("ecosystem"), F.explode(names).alias("name"))
    found = inline.unionByName(_indented_names(here)).unionByName(_setup_cfg_names(here))
    return found.where("name IS NOT NULL").distinct()


def _indented_names(here: DataFrame) -> DataFrame:
    """Entries indented below the sections of YAML manifests. A section ends at a line no deeper than its key."""
    sections = F.create_map(*(x for n, s in YAML_SECTIONS.items() for x in (F.lit(n), F.array(*map(F.lit, s)))))
    rows = lines(here.where(F.col("path").isin(list(YAML_SECTIONS)))).where("trim(text) <> ''").where(~F.ltrim("text").startswith("#"))
    rows = rows.withColumns({"deep": F.length("text") - F.length(F.ltrim("text")), "bare": F.trim("text")})
    head = F.col("bare").endswith(":") & F.array_contains(F.element_at(sections, F.col("path")), F.regexp_replace("bare", ":+$", ""))
    rows = rows.withColumn("head", head)
    rows = filled(rows, ["repo_id", "path"], "line", F.when(F.col("head"), F.struct("line", "deep")), "section")
    # The least depth since the section's key says whether a line still belongs to it.
    since = Window.partitionBy("repo_id", "path", "section.line").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("section IS NOT NULL").withColumn("least", F.min(F.when(~F.col("head"), F.col("deep"))).over(since))
    entry = F.split(F.regexp_replace("bare", "^[- ]+", ""), "#", 2)[0]
    name = F.split(entry, r"[=<>!~\s:]", 2)[0]
    eco = F.when(F.col("path") == "pubspec.yaml", "pub").otherwise("pypi")
    return rows.where(~F.col("head") & (F.col("least") > F.col("section.deep"))).select("repo_id", eco.alias("ecosystem"), dep_name(name).alias("name"))


def _setup_cfg_names(here: DataFrame) -> DataFrame:
    """Requirements of setup.cfg: the value of the key and the indented lines below it; any other line at the margin ends them."""
    rows = lines(here.where("path = 'setup.cfg'"))
    key = F.col("text").rlike(r"^\s*(install_requires|setup_requires)\s*=")
    ends = (F.trim("text") != "") & ~F.col("text").rlike(r"^\s")
    step = F.when(key, F.array(F.lit(1), F.lit(1))).when(ends, F.array(F.lit(0), F.lit(0)))
    rows = states(rows, ["repo_id", "path"], "line", step, 2)
    spec = F.when(key, F.regexp_replace("text", "^[^=]*=", "")).otherwise(F.col("text"))
    return rows.where(key | ((F.col("state") == 1) & ~ends)).select("repo_id", F.lit("pypi").alias("ecosystem"), requirement_name(spec).alias("name"))


def update_tool(files: DataFrame) -> DataFrame:
    """(repo_id, dep_update_tooling): the first tool that a file at its place configures, or none."""
    rank = F.coalesce(*(F.when(F.col("path").isin(marks), k) for k, (_, marks) in enumerate(UPDATE_TOOLS)))
    tools = F.array(*(F.lit(t) for t, _ in UPDATE_TOOLS))
    return files.groupBy("repo_id").agg(F.coalesce(F.get(tools, F.min(rank)), F.lit("none")).alias("dep_update_tooling"))
