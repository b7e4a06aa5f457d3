"""Declared dependencies: names, direct counts out of manifests, lockfiles by format, keyword groups. Column expressions only.

A manifest is read by columns of its own row, so nothing moves before the aggregates by repository, whose groups are counts,
or sets no larger than the keyword table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats of lockfiles in their order, and folders whose lockfiles are not the repository's own.
LOCKFILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "uv.lock", "go.sum", "Cargo.lock", "Gemfile.lock",
    "composer.lock", "packages.lock.json", "gradle.lockfile", "pubspec.lock",
]
NOT_OWN = ["node_modules", ".git"]
NAME = r"^[@a-z0-9][a-z0-9./:@+\-]*$"
REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9._\-]*)"
NO_REQUIREMENT = r"^(-|#|http|git\+|file:|\.|/)"
# End of the fixed values.

_NAMES = "map<string,string>"


def dep_name(raw: Column) -> Column:
    """The name as keywords are held against it: unquoted, lower case, hyphens for underscores; null where it is no name."""
    bare = F.regexp_replace(F.trim(raw), r"""^["']+|["']+$""", "")
    name = F.regexp_replace(F.translate(F.lower(F.trim(bare)), "_", "-"), "/+$", "")
    return F.when(name.rlike(NAME), name)


def requirement_name(line: Column) -> Column:
    """The name a requirement line begins with; null for options, comments, addresses, paths and blank lines."""
    text = F.trim(line)
    return F.when(~text.rlike(NO_REQUIREMENT), dep_name(F.nullif(F.regexp_extract(text, REQUIREMENT, 1), F.lit(""))))


def keyword_pattern(keyword: str) -> str:
    """A keyword stands between ends, slashes, colons or dots; a star at its end lets the segment go on."""
    stem = keyword.rstrip("*")
    return "(?:^|[/:.])" + re.escape(stem) + ("[a-z0-9+-]*" if keyword != stem else "") + "(?:$|[/:.])"


def keyword_hits(deps: DataFrame, keywords: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(repo_id, ecosystem, name) and (group, ecosystem or 'any', keyword) -> repo_id, keyword_group, hits: sorted keywords.

    Every repository has every group; "none" is an empty array. Null names and ecosystems match nothing, except that 'any' looks
    at the name alone. The keywords are a constant table: each is one literal pattern, and one aggregate holds them all.
    """
    table = list(keywords)
    found = [F.max(F.col("name").rlike(keyword_pattern(k)) & (F.lit(True) if eco == "any" else F.col("ecosystem") == eco)) for _, eco, k in table]
    flags = deps.groupBy("repo_id").agg(*(f.alias(f"k{i}") for i, f in enumerate(found)))
    groups = []
    for group in dict.fromkeys(g for g, _, _ in table):
        hits = [F.when(F.col(f"k{i}"), k.rstrip("*")) for i, (g, _, k) in enumerate(table) if g == group]
        groups.append(F.struct(F.lit(group).alias("keyword_group"), F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))).alias("hits")))
    return flags.select("repo_id", F.inline(F.array(*groups)))


def npm_names(content: Column, member: str = "dependencies") -> Column:
    """Names in a member of a package.json; empty where the member or the JSON is not an object."""
    return F.coalesce(F.map_keys(F.from_json(F.get_json_object(content, f"$.{member}"), _NAMES)), F.array().cast("array<string>"))


def go_requires(content: Column) -> Column:
    """Requirements of a go.mod: lines of `require (` blocks that are neither blank nor comments, and single `require` lines."""
    block = r"(?ms)^[ \t]*require \([^\n]*(.*?)(?:^[ \t]*\)[ \t\r]*$|\z)"
    inside = F.array_join(F.regexp_extract_all(content, F.lit(block), 1), "\n")
    return F.coalesce(
        F.regexp_count(inside, F.lit(r"(?m)^[ \t]*(?!//)[^\s]")) + F.regexp_count(F.regexp_replace(content, block, ""), F.lit(r"(?m)^[ \t]*require ")), F.lit(0)
    ).cast("long")


def direct_counts(manifests: DataFrame) -> DataFrame:
    """(repo_id, path, content) -> repo_id, runtime_deps, dev_deps of the root's package.json and go.mod; zero where none."""
    npm, go = F.col("path") == "package.json", F.col("path") == "go.mod"
    count = lambda names: F.size(names).cast("long")
    runtime = F.when(npm, count(npm_names(F.col("content")))).when(go, go_requires(F.col("content"))).otherwise(0)
    dev = F.when(npm, count(npm_names(F.col("content"), "devDependencies"))).otherwise(0)
    return manifests.groupBy("repo_id").agg(F.sum(runtime).alias("runtime_deps"), F.sum(dev).alias("dev_deps"))


def lockfiles(files: DataFrame) -> DataFrame:
    """(repo_id, path) -> repo_id, format, path: of each format the smallest path outside vendored folders."""
    name = F.element_at(F.split("path", "/"), -1)
    own = ~F.coalesce(*[F.when(F.col("path").contains(d), True) for d in NOT_OWN], F.lit(False))
    return files.where(name.isin(LOCKFILES) & own).groupBy("repo_id", name.alias("format")).agg(F.min("path").alias("path"))
