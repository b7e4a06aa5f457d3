"""Column functions over posix paths relative to a repository's root, and over the heads of files."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, extensions and patterns that decide the results.
LANGUAGES = {
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".mjs": "JavaScript",
    ".cjs": "JavaScript",
    ".py": "Python",
    ".go": "Go",
    ".rs": "Rust",
    ".java": "Java",
    ".kt": "Kotlin",
    ".kts": "Kotlin",
    ".rb": "Ruby",
    ".php": "PHP",
    ".cs": "C#",
    ".cpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".c": "C",
    ".h": "C/C++",
    ".swift": "Swift",
    ".dart": "Dart",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".erl": "Erlang",
    ".hrl": "Erlang",
    ".scala": "Scala",
    ".clj": "Clojure",
    ".hs": "Haskell",
    ".sh": "Shell",
    ".bash": "Shell",
    ".zsh": "Shell",
    ".sql": "SQL",
    ".css": "CSS",
    ".scss": "CSS",
    ".sass": "CSS",
    ".less": "CSS",
    ".html": "HTML",
    ".htm": "HTML",
    ".vue": "Vue",
    ".svelte": "Svelte",
    ".tf": "Terraform",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".json": "JSON",
    ".toml": "TOML",
    ".md": "Markdown",
    ".mdx": "Markdown",
}
#: Languages that have a name but are no source code.
NOT_CODE = ("CSS", "HTML", "Terraform", "YAML", "JSON", "TOML", "Markdown")
SKIPPED_DIRS = [
    "node_modules", ".git", "vendor", "dist", "build", "out", ".cache", "__pycache__", ".pytest_cache", ".mypy_cache", "venv",
    ".venv", "env", ".env", "target", ".next", ".nuxt", ".output", ".turbo", "coverage", ".nyc_output", "htmlcov", "migrations",
    "generated", "gen", "__generated__", ".tox", "eggs", "*.egg-info",
]
KEPT_DOT_DIRS = [
    ".github", ".gitlab", ".circleci", ".devcontainer",
]
TESTS = [r"\.(test|spec)\.(ts|tsx|js|jsx|mjs)$", r"(^|/)test_[^/]+\.(py)$", r"(^|/)[^/]+_test\.(go|py|rb)$", r"(^|/)__tests__/", r"(^|/)tests?/", r"(^|/)spec/", r"\.(test|spec)\.rs$"]
TESTS_BY_CASE = r"[A-Z][^/]*Test[s]?\.(java|kt|cs)$"
FIXTURES = [r"(^|/)tests?/fixtures?/", r"(^|/)__snapshots__/", r"(^|/)__mocks__/", r"\.snap$", r"\.fixture\.(json|ts|js|yaml)$"]
GENERATED = ["// Code generated", "# DO NOT EDIT", "# This file is auto-generated", "// AUTO-GENERATED"]
GENERATED_BY_CASE = r"/* eslint-disable \*/"
CI_PREFIXES = r"\.github/|\.gitlab|\.circleci/"
HEAD = 500
SNIFF = 4096
# End of the fixed values.

CODE_EXTENSIONS = sorted(ext for ext, name in LANGUAGES.items() if name not in NOT_CODE)


def any_of(patterns: list[str], ignore_case: bool = True) -> str:
    """One pattern that finds what any of them finds."""
    return ("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for names without one, that begin with their only dot or end in a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable(LANGUAGES.items())))
    return F.coalesce(F.element_at(known, extension(path)), F.lit("Other"))


def is_code(path: Column) -> Column:
    return extension(path).isin(CODE_EXTENSIONS)


def is_walked(path: Column) -> Column:
    """No directory above the file is skipped by its name or hidden."""
    dirs = F.filter(F.split(parent(path), "/"), lambda d: d != "")
    return ~F.exists(dirs, lambda d: d.isin(SKIPPED_DIRS) | (d.startswith(".") & ~d.isin(KEPT_DOT_DIRS)))


def is_test(path: Column) -> Column:
    return path.rlike(any_of(TESTS)) | path.rlike(TESTS_BY_CASE)


def is_fixture(path: Column) -> Column:
    return path.rlike(any_of(FIXTURES))


def is_generated(text: Column) -> Column:
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD)
    return head.rlike(any_of(GENERATED)) | head.rlike(GENERATED_BY_CASE)


def is_ci_config(path: Column) -> Column:
    return F.lower(path).rlike(f"(^|/)({CI_PREFIXES})")


def infrastructure_kind(path: Column, text: Column, in_chart: Column) -> Column:
    """Dockerfile, Terraform, CloudFormation, Helm, Docker Compose, Kubernetes, Ansible, or null.

    in_chart says that the file stands where a chart directory makes it a part of the chart; see operators.files.
    """
    name, ext = F.lower(basename(path)), extension(path)
    head = F.substring(F.coalesce(text, F.lit("")), 1, SNIFF)
    low = F.lower(head)
    yaml = ext.isin(".yaml", ".yml")
    services = head.rlike(r"(^|\n)services:") & low.rlike("image:|build:|container_name:")
    marked = head.rlike(r"(^|\n)hosts:") | low.rlike(r"ansible\.builtin\.|\nbecome:|gather_facts:|\nvars_files:")
    placed = F.concat(F.lit("/"), path).rlike("/(roles|playbooks)/") | parent(path).endswith("playbooks")
    tasks = head.rlike(r"(^|\n)- name:") | low.contains("\ntasks:")
    return (
        F.when(name.rlike(r"^dockerfile($|\.)|\.dockerfile$"), "Dockerfile")
        .when(ext.isin(".tf", ".tfvars", ".hcl"), "Terraform")
        .when(~(yaml | (ext == ".json")) | is_ci_config(path), None)
        .when(ext == ".json", F.when(low.rlike('awstemplateformatversion|"aws::'), "CloudFormation"))
        .when(name.isin("chart.yaml", "chart.yml") | in_chart, "Helm")
        .when(name.startswith("docker-compose") | name.startswith("compose."), "Docker Compose")
        .when(low.contains("apiversion:") & low.contains("kind:"), "Kubernetes")
        .when(low.contains("awstemplateformatversion") | (low.contains("resources:") & low.contains("aws::")), "CloudFormation")
        .when(services, "Docker Compose")
        .when(marked | (placed & tasks), "Ansible")
    )
