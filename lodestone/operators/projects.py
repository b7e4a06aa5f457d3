"""Project roots of repositories: where manifests stand, which workspace claims them, their numbers, weights and places.

files is (repo_id, path, content). A directory is its path, empty at the root. All that looks upwards (claims, weights) joins on
exploded ancestors, at most MOST_DEPTH for a root, so nothing compares every path with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, parent

# Markers, names and bounds that decide the results.
MARKERS = {
    "package.json": ["node"],
    "pyproject.toml": ["python"], "setup.py": ["python"], "setup.cfg": ["python"], "requirements.txt": ["python"],
    "Pipfile": ["python"], "tox.ini": ["python"], "noxfile.py": ["python"], "environment.yml": ["python"],
    "go.mod": ["go"],
    "pom.xml": ["maven"],
    "build.gradle": ["gradle"], "build.gradle.kts": ["gradle"], "settings.gradle": ["gradle"], "settings.gradle.kts": ["gradle"],
    "Cargo.toml": ["rust"],
    "Gemfile": ["ruby"],
    "composer.json": ["php"],
}
DOTNET = r"\.(sln|csproj|fsproj|vbproj)$"
IGNORED = [
    ".git", ".hg", ".svn", "node_modules", "bower_components", "vendor", "dist", "build", "target", "out", "bin", "obj", ".venv", "venv", "env",
    "__pycache__", ".tox", ".nox", ".gradle", ".idea", ".vscode", ".terraform", "third_party", "Pods", "coverage", ".next", ".turbo", ".pnpm-store",
    ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages", "Carthage", "DerivedData", ".dart_tool", "elm-stuff",
]
ANCILLARY = [
    "docs", "doc", "documentation", "website", "site", "www", "examples", "example", "samples", "sample", "demo", "demos", "benchmark", "benchmarks",
    "bench", "playground", "sandbox",
]
MOST_DEPTH, MOST_PROJECTS, MOST_PROBED = 4, 24, 8
COVERAGE, COVERAGE_BONUS = ["python", "node", "go"], 1.25
SECONDS_PER_PROJECT = {"discover": 30.0, "full": 90.0}
SECONDS_PER_1000_FILES = {"discover": 4.0, "full": 20.0}
# End of the fixed values.

_ANY = "**"


def _shuffled(df: DataFrame) -> DataFrame:
    """df to be joined by a shuffle: exploded rows are far more than Spark expects, and as a broadcast they would all pass the driver."""
    return df.hint("merge")


def _dirs(path: Column) -> Column:
    return F.filter(F.split(parent(path), "/"), lambda d: d != "")


def depth(root: Column) -> Column:
    return F.size(F.filter(F.split(root, "/"), lambda d: d != ""))


def is_ancillary(root: Column) -> Column:
    """Some directory of the path ships beside the product."""
    return F.exists(F.split(root, "/"), lambda d: F.lower(d).isin(ANCILLARY))


def ecosystems(path: Column) -> Column:
    """The ecosystems whose manifest the file is."""
    known = F.create_map(*(x for name, found in MARKERS.items() for x in (F.lit(name), F.array(*map(F.lit, found)))))
    return F.when(basename(path).rlike(DOTNET), F.array(F.lit("dotnet"))).otherwise(F.coalesce(F.try_element_at(known, basename(path)), F.array().cast("array<string>")))


def ancestors(root: Column) -> Column:
    """Array of (above, inner): the directories above root, the repository's included, and root's path below each."""
    parts = F.filter(F.split(root, "/"), lambda d: d != "")
    at = lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("above"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("inner"))
    return F.when(F.size(parts) == 0, F.array().cast("array<struct<above:string,inner:string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), at))


def walked(files: DataFrame) -> DataFrame:
    """Files that a walk to MOST_DEPTH directories reaches, with `root`, their directory."""
    dirs = _dirs(F.col("path"))
    seen = ~F.exists(dirs, lambda d: d.isin(IGNORED) | d.startswith("."))
    return files.where(seen & (F.size(dirs) <= MOST_DEPTH)).withColumn("root", parent(F.col("path")))


def roots(files: DataFrame) -> DataFrame:
    """(repo_id, root, ecosystem): one for each directory and ecosystem that has a manifest there."""
    return walked(files).select("repo_id", "root", F.explode(ecosystems(F.col("path"))).alias("ecosystem")).distinct()


def unreached(files: DataFrame) -> DataFrame:
    """(repo_id, root, reason_code, ecosystems): the directories at which the walk stops, and what their own manifests name."""
    dirs = _dirs(F.col("path"))
    first = F.slice(dirs, 1, MOST_DEPTH + 1)
    at = files.where((F.size(dirs) > MOST_DEPTH) & ~F.exists(first, lambda d: d.isin(IGNORED) | d.startswith(".")))
    direct = F.when(F.size(dirs) == MOST_DEPTH + 1, ecosystems(F.col("path"))).otherwise(F.array().cast("array<string>"))
    each = at.select("repo_id", F.array_join(first, "/").alias("root"), F.explode_outer(direct).alias("ecosystem"))
    return each.groupBy("repo_id", "root").agg(F.array_sort(F.collect_set("ecosystem")).alias("ecosystems")).select("repo_id", "root", F.lit("depth_limit").alias("reason_code"), "ecosystems")


def glob_matches(inner: Column, glob: Column) -> Column:
    """inner falls under the glob of a workspace: the path itself, what a star spans (slashes too), or something below it."""
    bare = F.regexp_replace(F.trim(glob), "/+$", "")
    pattern = F.regexp_replace(F.regexp_replace(bare, r"([.+^$(){}|\\])", r"\\$1"), r"\[!", "[^")
    pattern = F.regexp_replace(F.regexp_replace(pattern, r"\*", ".*"), r"\?", ".")
    inside = F.regexp_like(inner, F.concat(F.lit("^(?s:"), pattern, F.lit(")(?s:/.*)?$")))
    below = bare.endswith("/*") & F.startswith(inner, F.concat(F.regexp_replace(bare, r"/\*$", ""), F.lit("/")))
    return (bare != "") & (bare.isin(_ANY, "*") | inside | (inner == bare) | below)


def claims(files: DataFrame) -> DataFrame:
    """(repo_id, ecosystem, root, globs): the roots that claim projects below them for one command, and what they claim."""
    here = walked(files)
    name = basename(F.col("path"))
    text = F.coalesce("content", F.lit(""))
    strings = F.array().cast("array<string>")
    said = F.coalesce(F.from_json(F.get_json_object(text, "$.workspaces"), "array<string>"), F.from_json(F.get_json_object(text, "$.workspaces.packages"), "array<string>"), strings)
    node = here.where(name == "package.json").select("repo_id", "root", F.lit("node").alias("ecosystem"), F.array_compact(said).alias("globs"))
    listed = F.regexp_extract_all(text, F.lit(r"""(?m)^\s*-\s*['"]?([^'"\n]+)['"]?\s*$"""), 1)
    pnpm = here.where(name == "pnpm-workspace.yaml").select("repo_id", "root", F.lit("node").alias("ecosystem"), F.when(F.size(listed) == 0, F.array(F.lit(_ANY))).otherwise(F.filter(F.transform(listed, lambda g: F.trim(g)), lambda g: g != "")).alias("globs"))
    quoted = lambda key: F.regexp_extract_all(F.regexp_extract(text, rf"(?ms)^\s*{key}\s*=\s*\[(.*?)\]", 1), F.lit("""['"]([^'"]+)['"]"""), 1)
    members = F.when(F.size(quoted("members")) == 0, F.array(F.lit(_ANY))).otherwise(quoted("members"))
    rust = here.where((name == "Cargo.toml") & text.rlike(r"(?m)^\s*\[workspace\]")).select("repo_id", "root", F.lit("rust").alias("ecosystem"), F.filter(F.array_except(members, quoted("exclude")), lambda g: g.isNotNull()).alias("globs"))
    whole = F.when(name == "go.work", "go").when((name == "pom.xml") & text.contains("<modules>"), "maven").when(name.isin("settings.gradle", "settings.gradle.kts"), "gradle").when(name.endswith(".sln"), "dotnet")
    rest = here.select("repo_id", "root", whole.alias("ecosystem"), F.array(F.lit(_ANY)).alias("globs")).where("ecosystem IS NOT NULL")
    found = node.where(F.size("globs") > 0).unionByName(pnpm).unionByName(rust).unionByName(rest)
    each = found.groupBy("repo_id", "ecosystem", "root").agg(F.array_distinct(F.flatten(F.collect_list("globs"))).alias("globs"))
    # Only directories that are a project's root of some ecosystem claim anything; node's two files speak for one.
    return each.join(_shuffled(roots(files).select("repo_id", "root").distinct()), ["repo_id", "root"], "left_semi")


def workspace_claim(found: DataFrame, claimed: DataFrame) -> DataFrame:
    """found (repo_id, root, ecosystem) and claimed (repo_id, ecosystem, root, globs) -> found with `owner`: the nearest directory
    above the root that claims it for its ecosystem, null for none. Null roots or globs are claimed by nothing and claim nothing."""
    above = found.select("repo_id", "ecosystem", "root", F.inline(ancestors(F.col("root"))))
    own = claimed.select("repo_id", "ecosystem", F.col("root").alias("above"), F.explode("globs").alias("glob"))
    met = above.join(_shuffled(own), ["repo_id", "ecosystem", "above"]).where(glob_matches(F.col("inner"), F.col("glob")))
    nearest = met.groupBy("repo_id", "ecosystem", "root").agg(F.max_by("above", F.length("above")).alias("owner"))
    return found.join(_shuffled(nearest), ["repo_id", "ecosystem", "root"], "left")


def subtree_files(files: DataFrame) -> DataFrame:
    """(repo_id, root, files): files at or below each directory. Counts by directory go up, not files."""
    each = files.groupBy("repo_id", parent(F.col("path")).alias("root")).agg(F.count("*").alias("n"))
    up = F.array_append(F.transform(ancestors(F.col("root")), lambda a: a["above"]), F.col("root"))
    return each.select("repo_id", F.explode(up).alias("root"), "n").groupBy("repo_id", "root").agg(F.sum("n").alias("files"))


def projects(files: DataFrame, most: int = MOST_PROJECTS) -> tuple[DataFrame, DataFrame]:
    """Projects (repo_id, project_id, root, ecosystem, members, workspace, required, weight) and what is left out
    (repo_id, root, ecosystem, reason_code: project_budget_exhausted or workspace_root_not_probed).

    Roots are numbered from the shallowest, then by path and ecosystem; the first `most` that no workspace claims are projects.
    A repository whose projects are all ancillary requires all of them.
    """
    claimed = claims(files)
    found = workspace_claim(roots(files), claimed)
    order = F.row_number().over(Window.partitionBy("repo_id").orderBy(depth(F.col("root")), "root", "ecosystem"))
    free = found.where("owner IS NULL").withColumn("place", order)
    spaces = claimed.select("repo_id", "root", "ecosystem", F.lit(True).alias("workspace"))
    kept = free.where(F.col("place") <= most).join(_shuffled(spaces), ["repo_id", "root", "ecosystem"], "left").join(_shuffled(subtree_files(walked(files))), ["repo_id", "root"], "left")
    held = found.where("owner IS NOT NULL")
    members = held.groupBy("repo_id", "ecosystem", "owner").agg(F.array_sort(F.collect_list(F.struct(depth(F.col("root")).alias("d"), "root"))).alias("m")).select("repo_id", "ecosystem", F.col("owner").alias("root"), F.transform("m", lambda x: x["root"]).alias("members"))
    required = ~is_ancillary(F.col("root"))
    all_ancillary = ~F.max(required).over(Window.partitionBy("repo_id"))
    rows = kept.join(_shuffled(members), ["repo_id", "ecosystem", "root"], "left").select(
        "repo_id", F.concat(F.lit("p"), "place").alias("project_id"), "root", "ecosystem", F.coalesce("members", F.array().cast("array<string>")).alias("members"),
        F.coalesce("workspace", F.lit(False)).alias("workspace"), (required | all_ancillary).alias("required"), F.greatest(F.lit(1).cast("long"), F.coalesce("files", F.lit(0))).alias("weight"),
    )
    over = free.where(F.col("place") > most).select("repo_id", "root", "ecosystem", F.lit("project_budget_exhausted").alias("reason_code"))
    lost = held.join(_shuffled(kept.select("repo_id", "ecosystem", F.col("root").alias("owner"))), ["repo_id", "ecosystem", "owner"], "left_anti").select("repo_id", "root", "ecosystem", F.lit("workspace_root_not_probed").alias("reason_code"))
    return rows, over.unionByName(lost)


def allocated(found: DataFrame, most: int = MOST_PROBED) -> DataFrame:
    """found (repo_id, root, ecosystem, workspace, weight) with `place` and `probed`: by weight, more for ecosystems whose tools
    report coverage, then workspaces first, then by path; the first `most` of a repository are probed, at least one."""
    weight = F.col("weight") * F.when(F.col("ecosystem").isin(COVERAGE), COVERAGE_BONUS).otherwise(1.0)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(weight.desc(), F.desc("workspace"), "root", "ecosystem"))
    return found.withColumn("place", place).withColumn("probed", F.col("place") <= max(1, most))


def survey(files: DataFrame, most: int = MOST_PROBED) -> DataFrame:
    """For each repository: n_projects, n_projects_probed, n_projects_over_cap, ecosystems, files_scanned, dirs_scanned."""
    rows, _ = projects(files)
    each = allocated(rows, most).groupBy("repo_id").agg(F.count("*").alias("n_projects"), F.count_if("probed").alias("n_projects_probed"), F.array_sort(F.collect_set("ecosystem")).alias("ecosystems"))
    up = F.array_append(F.transform(ancestors(F.col("root")), lambda a: a["above"]), F.col("root"))
    seen = walked(files)
    counts = seen.groupBy("repo_id").agg(F.count("*").alias("files_scanned"))
    dirs = seen.select("repo_id", "root").distinct().select("repo_id", F.explode(up).alias("root")).groupBy("repo_id").agg(F.count_distinct("root").alias("dirs_scanned"))
    out = counts.join(dirs, "repo_id").join(each, "repo_id", "left").fillna(0, ["n_projects", "n_projects_probed"])
    return out.withColumns({"n_projects_over_cap": F.col("n_projects") - F.col("n_projects_probed"), "ecosystems": F.coalesce("ecosystems", F.array().cast("array<string>"))})


def estimated_seconds(surveyed: DataFrame, level: str) -> Column:
    """What a run at the level is likely to take; 0 for levels that start nothing."""
    per_file = SECONDS_PER_1000_FILES.get(level, 0.0) / 1000
    return SECONDS_PER_PROJECT.get(level, 0.0) * surveyed["n_projects_probed"] + per_file * surveyed["files_scanned"]
