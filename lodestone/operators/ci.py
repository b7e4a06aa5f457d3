"""Continuous integration of repositories: configurations, the commands they run, what those hand on to, and flags.

files is (repo_id, path, content). A repository's files stay rows throughout; a command that calls a target of a Makefile, a
script of package.json or a shell script is joined to the lines behind it, a fixed number of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import yaml_rows
from . import scans
from .scans import filled, lines

# Paths, keys and patterns that decide the results.
CONFIGS = {
    ".github/workflows": "GitHub Actions",
    ".circleci/config.yml": "CircleCI",
    ".gitlab-ci.yml": "GitLab CI",
    "Jenkinsfile": "Jenkins",
    "azure-pipelines.yml": "Azure Pipelines",
    ".travis.yml": "Travis CI",
    "bitbucket-pipelines.yml": "Bitbucket Pipelines",
    ".buildkite/pipeline.yml": "Buildkite",
    "cloudbuild.yaml": "GCP Cloud Build",
    ".woodpecker.yml": "Woodpecker CI",
    ".drone.yml": "Drone CI",
}
WORKFLOW = r"^\.github/workflows/[^/]+\.ya?ml$"
COMMAND_KEYS = ["run", "script", "before_script", "after_script", "commands", "command"]
DISABLED = ["false", "${{ false }}", "${{false}}", "0", "no", "off"]
WRAPPER = (
    r"(?i)^\s*(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)*(?:sudo\s+|time\s+|nice\s+|exec\s+|xvfb-run(?:\s+-\S+)*\s+|env\s+(?:\S+=\S*\s+)*|"
    r"(?:poetry|pipenv|uv|hatch|pdm|rye)\s+run\s+(?:--\S+\s+)*|bundle\s+exec\s+|npx\s+(?:--\S+\s+)*|pnpm\s+(?:exec|dlx)\s+|yarn\s+dlx\s+)*"
)
SKIPS_TESTS = r"(?i)-DskipTests|-Dmaven\.test\.skip|(^|\s)-x\s+test\b|--no-run\b"
TESTS = (
    r"(?i)^(?:pytest|py\.test|tox|nox|behave|robot|python[0-9.]*\s+-m\s+(?:pytest|unittest|nose2|tox|nox)|python[0-9.]*\s+setup\.py\s+test|"
    r"jest|vitest|mocha|ava|karma|jasmine|tap|(?:npm|yarn|pnpm|bun)\s+(?:-\S+\s+)*(?:run\s+)?(?:test|tests)\b|go\s+test|gotestsum|"
    r"cargo\s+(?:test|nextest\s+run)|(?:\./)?gradlew?(?:\.bat)?\s+.*\b(?:test|check|build)\b|(?:\./)?mvnw?\s+.*\b(?:test|verify|install)\b|"
    r"mvn\s+.*\b(?:test|verify|install)\b|make\s+.*\b(?:test|tests|check|coverage)\b|just\s+.*\b(?:test|check)\b|rspec|rake\s+(?:test|spec)|"
    r"minitest|phpunit|\S*vendor/bin/phpunit|composer\s+(?:run-script\s+)?test|dotnet\s+test|ctest|bazel\s+test|ninja\s+test|swift\s+test|"
    r"playwright\s+test|cypress\s+run|coverage\s+run|pytest-\S+)\b"
)
LINTS = (
    r"(?i)^(?:eslint|pylint|ruff|flake8|golangci-lint|clippy|cargo\s+clippy|rubocop|black|isort|prettier|shellcheck|stylelint|standardrb|credo|"
    r"swiftlint|ktlint|(?:npm|yarn|pnpm|bun)\s+(?:-\S+\s+)*(?:run\s+)?lint|pre-commit\s+run|make\s+.*\blint\b|tox\s+.*\blint\b|nox\s+.*\blint\b)\b"
)
TYPECHECKS = (
    r"(?i)^(?:tsc|mypy|pyright|pyre|flow\s+check|(?:npm|yarn|pnpm|bun)\s+(?:-\S+\s+)*(?:run\s+)?type[-:]?check|make\s+.*\btype.?check\b|"
    r"tox\s+.*\b(?:mypy|type)\b|python[0-9.]*\s+-m\s+(?:mypy|pyright|pyre|ty)\b)\b"
)
DEPLOYS = r"(?i)\bdeploy\b|\brelease\b|\bpublish\b|\bpush.*ecr\b|\bpush.*registry\b"
LINT_ACTIONS = (
    r"(?i)^(?:golangci/golangci-lint-action|reviewdog/action-|github/super-linter|super-linter/super-linter|psf/black|astral-sh/ruff-action|"
    r"chartboost/ruff-action|pre-commit/action|rubocop/|wearerequired/lint-action)"
)
TYPECHECK_ACTIONS = r"(?i)^(?:jakebailey/pyright-action|tsuyoshicho/action-mypy|jpetrucciani/mypy-check)"
MAKE_CALL = r"(?i)^make(?:\s+-\S+|\s+\S+=\S*)*\s+([A-Za-z0-9_./-]+)"
NPM_CALL = r"(?i)^(?:npm|yarn|pnpm|bun)\s+(?:-\S+\s+)*(?:run(?:-script)?\s+)?([A-Za-z0-9:_-]+)"
SCRIPT_CALL = r"^(?:(?:ba|z|k|da)?sh\s+(?:-\S+\s+)*)?(\.?/?[A-Za-z0-9_./-]+\.(?:sh|bash))\b"
EXPRESSION = r"\$\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}"
JENKINS_STEP = r"""(?s)\b(?:sh|bat|powershell)\s*(?:\(\s*)?(?:'''(.*?)'''|\"\"\"(.*?)\"\"\"|'([^']*)'|\"([^\"]*)\")"""
MAKEFILES = ["Makefile", "makefile", "GNUmakefile"]
BREAKS = r"[\n;]|&&|\|\|"
HOPS = 2
# End of the fixed values.


def configs(files: DataFrame) -> DataFrame:
    """The files that configure a pipeline, with their system."""
    known = F.element_at(F.create_map(*(F.lit(x) for pair in CONFIGS.items() for x in pair)), F.col("path"))
    return files.withColumn("system", F.when(F.col("path").rlike(WORKFLOW), CONFIGS[".github/workflows"]).otherwise(known)).where("system IS NOT NULL")


def split_commands(block: Column, env: Column | None = None) -> Column:
    """Commands of a block of shell text: one for each line, ";" , "&&" or "||", without the programs that only wrap them.

    env (a map) stands in for ${{ env.NAME }} and ${{ NAME }}; what it does not hold is erased. Without env they stay.
    """

    def substituted(text: Column) -> Column:
        between = F.split(text, EXPRESSION, -1)
        names = F.regexp_extract_all(text, F.lit(EXPRESSION), 1)
        put = F.transform(names, lambda n: F.coalesce(F.try_element_at(env, F.regexp_replace(n, "(?i)^env[.]", "")), F.lit("")))
        return F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    parts = F.split(block, BREAKS, -1)
    if env is not None:
        parts = F.transform(parts, lambda p: F.when(F.size(env) > 0, substituted(p)).otherwise(p))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), WRAPPER, "")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(bare(p), r"^\s+|\s+$", "")), lambda c: (c != "") & ~c.startswith("#"))


def _environment(values: Column) -> Column:
    """The map of all `env` mappings of a document; of repeated names the last one counts."""
    at = lambda v: F.array_position(v["keys"], "env")
    is_entry = lambda v: (at(v) > 0) & (at(v) == F.size(v["keys"]) - 1) & v["value"].isNotNull()

    def said(v: Column) -> Column:
        low = F.lower(v["value"])
        return F.when(v["is_plain"] & low.isin("true", "yes", "on"), "True").when(v["is_plain"] & low.isin("false", "no", "off"), "False").otherwise(v["value"])

    entries = F.transform(F.array_sort(F.filter(values, is_entry)), lambda v: F.struct(F.element_at(v["keys"], -1).alias("name"), said(v).alias("said")))
    # One pass: each entry takes its name's place in the map.
    put = lambda env, e: F.map_concat(F.map_filter(env, lambda k, _: k != e["name"]), F.map_from_arrays(F.array(e["name"]), F.array(e["said"])))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), put)


def steps(files: DataFrame) -> DataFrame:
    """Configurations (repo_id, path, readable, commands, actions, deploys): commands are (line, place, command).

    A mapping whose `if` or `when` is a literal that switches it off gives neither commands nor actions. One that is no YAML is
    not readable, and has none. A configuration's scalars meet in one row, so what switches a step off is looked up there.
    """
    found = configs(files)
    jenkins = F.lower(F.substring_index("path", "/", -1)).startswith("jenkinsfile")
    yaml = found.where(~jenkins)
    rows = yaml_rows.values(yaml).groupBy("repo_id", "path").agg(F.collect_list(F.struct("line", "keys", "value", "is_plain")).alias("values"))
    first = lambda k: F.array_position(F.transform(k, lambda x: F.array_contains(F.array(*map(F.lit, COMMAND_KEYS)), F.lower(x))), True).cast("int")
    # `at` is the first key that holds commands; below it only places of sequences and `command` lead on.
    values = F.transform("values", lambda v: F.struct(v["line"].alias("line"), v["keys"].alias("keys"), v["value"].alias("value"), v["is_plain"].alias("is_plain"), first(v["keys"]).alias("at")))
    rows = rows.withColumn("values", values)
    outside = lambda v: (v["at"] == 0) | (F.size(v["keys"]) < v["at"])
    guards = lambda v: F.element_at(v["keys"], -1).isin("if", "when") & F.lower(F.trim(v["value"])).isin(DISABLED) & outside(v)
    rows = rows.withColumns({"off": F.transform(F.filter("values", guards), lambda v: F.slice(v["keys"], 1, F.size(v["keys"]) - 1)), "env": _environment(F.col("values"))})
    until = lambda v: F.when(v["at"] > 0, v["at"]).otherwise(F.size(v["keys"]))
    is_off = lambda v: F.exists("off", lambda o: (F.size(o) < until(v)) & (F.slice(v["keys"], 1, F.size(o)) == o))
    below = lambda v: F.forall(F.slice(v["keys"], v["at"] + 1, F.size(v["keys"])), lambda k: k.rlike(r"^\[\d+\]$") | (k == "command"))
    live = F.filter("values", lambda v: v["value"].isNotNull() & ~is_off(v))
    said = F.array_sort(F.filter(live, lambda v: (v["at"] > 0) & below(v)))
    cut = lambda v: F.transform(split_commands(v["value"], F.col("env")), lambda c, i: F.struct(v["line"].alias("line"), i.alias("place"), c.alias("command")))
    used = F.transform(F.filter(live, lambda v: (v["at"] == 0) & (F.lower(F.element_at(v["keys"], -1)) == "uses")), lambda v: v["value"])
    rows = rows.select("repo_id", "path", F.flatten(F.transform(said, cut)).alias("commands"), used.alias("actions"))
    bad = yaml_rows.unreadable(yaml).withColumn("bad", F.lit(True))
    rows = yaml.select("repo_id", "path", "content").join(bad, ["repo_id", "path"], "left").join(rows, ["repo_id", "path"], "left")
    readable = F.col("bad").isNull() & F.col("content").isNotNull()
    nothing = F.array().cast("array<struct<line:int,place:int,command:string>>")
    deploys = F.coalesce(F.col("content").rlike(DEPLOYS), F.lit(False)).alias("deploys")
    rows = rows.select("repo_id", "path", readable.alias("readable"), F.when(readable, F.coalesce("commands", nothing)).otherwise(nothing).alias("commands"), F.when(readable, F.coalesce("actions", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("actions"), deploys)
    calls = F.regexp_extract_all("content", F.lit(JENKINS_STEP), 0)
    block = lambda c: F.concat(*(F.regexp_extract(c, JENKINS_STEP, k) for k in (1, 2, 3, 4)))
    shell = F.flatten(F.transform(calls, lambda c, i: F.transform(split_commands(block(c)), lambda x, j: F.struct(i.alias("line"), j.alias("place"), x.alias("command")))))
    pipe = found.where(jenkins).select("repo_id", "path", F.col("content").isNotNull().alias("readable"), F.coalesce(shell, nothing).alias("commands"), F.array().cast("array<string>").alias("actions"), deploys)
    return rows.unionByName(pipe)


def called(command: Column) -> Column:
    """What a command hands its work to: make:TARGET, npm:SCRIPT or file:PATH; null where to nothing of the repository."""
    make, npm, script = (F.regexp_extract(command, p, 1) for p in (MAKE_CALL, NPM_CALL, SCRIPT_CALL))
    return F.when(make != "", F.concat(F.lit("make:"), make)).when(npm != "", F.concat(F.lit("npm:"), npm)).when(script != "", F.concat(F.lit("file:"), F.regexp_replace(script, "^[./]+", "")))


def recipes(files: DataFrame) -> DataFrame:
    """(repo_id, target, line, text): the lines that each target of the root's Makefiles runs; of files with a target, the first."""
    rank = F.array_position(F.array(*(F.lit(m) for m in MAKEFILES)), F.col("path"))
    makefiles = files.where(F.col("path").isin(MAKEFILES))
    rows, parts = lines(makefiles), scans.file_parts(makefiles)
    inside = F.col("text").rlike("^(\t| {4})")
    head = ~inside & (F.trim("text") != "") & ~F.col("text").startswith("#")
    rows = rows.withColumn("head", head)
    rows = filled(rows, ["repo_id", "path"], "line", F.when(F.col("head"), F.struct("line", F.regexp_extract("text", r"^([A-Za-z0-9_./-]+)\s*:(?!=)", 1).alias("target"))), "owner", parts=parts)
    rows = rows.where(~F.col("head") & inside & (F.col("owner.target") != ""))
    # The lines of a target's first rule, in the first of the files that has one.
    chosen = rows.groupBy("repo_id", F.col("owner.target").alias("target")).agg(F.min(F.struct(rank.alias("rank"), F.col("owner.line").alias("rule"))).alias("first"))
    rows = rows.select("repo_id", F.col("owner.target").alias("target"), rank.alias("rank"), F.col("owner.line").alias("rule"), "line", F.trim(F.regexp_replace(F.trim(F.regexp_replace("text", "^[\t ]+", "")), "^[@+-]+", "")).alias("text")).repartition(parts, "repo_id", "target")
    return rows.join(chosen, ["repo_id", "target"]).where("rank = first.rank AND rule = first.rule").select("repo_id", F.concat(F.lit("make:"), "target").alias("target"), "line", "text")


def bodies(files: DataFrame) -> DataFrame:
    """(repo_id, target, line, place, command): the commands behind all that a command can call in the repository."""
    scripts = F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")
    npm = files.where("path = 'package.json'").select("repo_id", F.explode(scripts).alias("script", "text")).select("repo_id", F.concat(F.lit("npm:"), "script").alias("target"), F.lit(0).alias("line"), "text")
    shell = lines(files.where(F.col("path").rlike(r"\.(sh|bash)$"))).select("repo_id", F.concat(F.lit("file:"), "path").alias("target"), "line", "text")
    every = recipes(files).unionByName(npm).unionByName(shell)
    return every.select("repo_id", "target", "line", F.posexplode(split_commands(F.col("text"))).alias("place", "command"))


def opened(commands: DataFrame, behind: DataFrame, hops: int = HOPS, parts: int | None = None) -> DataFrame:
    """commands (repo_id, command) and behind (repo_id, target, line, place, command) -> (repo_id, command, trail, ran).

    A command that calls a target is followed to the lines behind it, and those in turn, `hops` times. A command gives way to
    what is behind it if that holds a test, lint or type check anywhere; otherwise it stays beside it. What a trail already
    passed through is not opened again. trail is the array of places on the way, ran what is found there. A command is followed
    once in a repository, however many rows have it. What is behind a target is one row of its repository. parts is the number
    of partitions that hold the work; by default one for scans.TASK_ROWS commands.
    """
    parts = parts or scans.parts(commands, commands.count(), scans.TASK_ROWS)
    c = F.col("ran")
    checks = c.rlike(TESTS) | c.rlike(LINTS) | c.rlike(TYPECHECKS)
    strings = F.array().cast("array<string>")
    asked = commands.select("repo_id", "command").where("command IS NOT NULL").repartition(parts, "repo_id", "command").distinct()
    rows = asked.select("repo_id", "command", strings.alias("trail"), F.col("command").alias("ran"), called(F.col("command")).alias("open"), strings.alias("passed"))
    step = F.format_string("%012d.%06d", F.col("line"), F.col("place"))
    line = F.struct(step.alias("step"), F.col("command").alias("next"))
    inside = behind.repartition(parts, "repo_id", "target").groupBy("repo_id", F.col("target").alias("open")).agg(F.collect_list(line).alias("lines"))
    # An opened command meets the lines behind it and an empty line that stands for itself.
    itself = F.array(F.lit(None).cast("struct<step:string,next:string>"))
    for _ in range(hops):
        met = rows.repartition(parts, "repo_id", "open").join(inside, ["repo_id", "open"], "left")
        met = met.withColumn("line", F.explode(F.concat(itself, F.coalesce("lines", F.array().cast("array<struct<step:string,next:string>>")))))
        child = F.col("line").isNotNull()
        passed = F.when(child, F.array_append("passed", F.col("open"))).otherwise(F.col("passed"))
        onward = called(F.col("line.next"))
        rows = met.select(
            "repo_id", "command", F.when(child, F.array_append("trail", F.col("line.step"))).otherwise(F.col("trail")).alias("trail"), F.when(child, F.col("line.next")).otherwise(c).alias("ran"),
            F.when(child & ~F.array_contains(passed, onward), onward).alias("open"), passed.alias("passed"),
        )
    # A command that checks speaks against all that it stands behind.
    above = F.when(checks & (F.size("trail") > 0), F.transform(F.sequence(F.lit(0), F.size("trail") - 1), lambda n: F.struct(F.slice("trail", 1, n).alias("trail"), F.lit(None).cast("string").alias("ran"))))
    said = F.concat(F.array(F.struct("trail", "ran")), F.coalesce(above, F.array().cast("array<struct<trail:array<string>,ran:string>>")))
    each = rows.repartition(parts, "repo_id", "command").select("repo_id", "command", F.inline(said)).groupBy("repo_id", "command", "trail").agg(F.max("ran").alias("ran"), F.bool_or(c.isNull()).alias("gives_way"))
    return each.where("NOT gives_way").select("repo_id", "command", "trail", "ran")


def expanded(commands: DataFrame, behind: DataFrame, hops: int = HOPS) -> DataFrame:
    """commands (repo_id, call, command) and behind -> (repo_id, call, trail, command): opened(), for each call. call names a
    command within its repository."""
    parts = scans.parts(commands, commands.count(), scans.TASK_ROWS)
    found = opened(commands, behind, hops, parts)
    each = commands.repartition(parts, "repo_id", "command").join(found, ["repo_id", "command"]).select("repo_id", "call", "trail", F.col("ran").alias("command"))
    # A row of no repository is followed to nothing.
    return each.unionByName(commands.where("repo_id IS NULL AND command IS NOT NULL").select("repo_id", "call", F.array().cast("array<string>").alias("trail"), "command"))


def flags(files: DataFrame) -> DataFrame:
    """For each repository: ci_systems, ci_configs, runs_tests, runs_lint, runs_typecheck (null: no configuration could be read),
    has_deploy_pipeline, ci_present, ci_analysis_method (no_ci, parsed, parser_unavailable)."""
    rows = steps(files)
    runs = opened(rows.select("repo_id", F.inline("commands")), bodies(files), parts=scans.file_parts(files))
    c = F.col("ran")
    ran = runs.groupBy("repo_id").agg(F.bool_or(c.rlike(TESTS) & ~c.rlike(SKIPS_TESTS)).alias("t"), F.bool_or(c.rlike(LINTS)).alias("l"), F.bool_or(c.rlike(TYPECHECKS)).alias("y"))
    uses = lambda pattern: F.bool_or(F.exists("actions", lambda a: a.rlike(pattern)))
    order = F.array(*(F.lit(s) for s in CONFIGS.values()))
    each = rows.groupBy("repo_id").agg(
        F.array_sort(F.collect_set("path")).alias("ci_configs"), F.bool_or("deploys").alias("has_deploy_pipeline"), uses(LINT_ACTIONS).alias("al"), uses(TYPECHECK_ACTIONS).alias("ay"), F.nullif(F.count_if("readable"), F.lit(0)).alias("parsed"),
    )
    # A folder of workflows is a sign of the system even if none of its files is a configuration.
    system = F.when(F.col("path").startswith(".github/workflows/"), CONFIGS[".github/workflows"]).otherwise(F.element_at(F.create_map(*(F.lit(x) for pair in list(CONFIGS.items())[1:] for x in pair)), F.col("path")))
    systems = files.groupBy("repo_id").agg(F.collect_set(system).alias("systems"))
    no = lambda name: F.coalesce(F.col(name), F.lit(False))
    known = lambda flag: F.when(F.col("parsed").isNull() & (F.size("ci_configs") > 0), None).otherwise(flag)
    rows = systems.join(each, "repo_id", "left").join(ran, "repo_id", "left")
    rows = rows.withColumn("ci_configs", F.coalesce("ci_configs", F.array().cast("array<string>")))
    return rows.select(
        "repo_id", F.filter(order, lambda s: F.array_contains("systems", s)).alias("ci_systems"), "ci_configs", known(no("t")).alias("runs_tests"), known(no("l") | no("al")).alias("runs_lint"),
        known(no("y") | no("ay")).alias("runs_typecheck"), no("has_deploy_pipeline").alias("has_deploy_pipeline"), (F.size("systems") > 0).alias("ci_present"),
        F.when(F.size("ci_configs") == 0, "no_ci").when(F.col("parsed").isNotNull(), "parsed").otherwise("parser_unavailable").alias("ci_analysis_method"),
    )
