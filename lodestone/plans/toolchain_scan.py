"""Toolchains of repositories that suppliers stand for, through the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import toolchain

#: A supplier's number modulo six says which of these layouts its repository has.
_LAYOUTS = [
    {"package.json": '{"dependencies": {"next": "1", "react": "1", "@trpc/server": "1"}, "devDependencies": {"jest": "1", "nyc": "1"}}', "jest.config.js": "coverageThreshold: { lines: 80 }", ".eslintrc.json": "{}", "renovate.json": ""},
    {"package.json": '{"main": "index.js", "dependencies": {"express": "1", "zod": "1"}}', "vitest.config.ts": "coverage: { thresholds: { lines: 90 } }", ".prettierrc": "", ".prettierrc.json": ""},
    {"pyproject.toml": '[project]\ndependencies = ["fastapi>1", "Flask"]\n[tool.ruff]\n[tool.pytest.ini_options]\naddopts = "--cov"\n', "setup.cfg": "[flake8]\n", "Dockerfile": ""},
    {"go.mod": "module x\n", "cmd/a/main.go": "", ".golangci.yml": "", "Makefile": ""},
    {"Cargo.toml": "[package]\n", "src/main.rs": "fn main() {}\n", "spec/a_spec.rb": "", "Gemfile": "", "test/a.rb": ""},
    {"pubspec.yaml": "name: x\n", "README.md": "uses flask and next.config.js"},
]


def toolchains(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = [F.array(*(F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in files.items())) for files in _LAYOUTS]
    k = F.col("s_suppkey")
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("repo_id"), F.inline(F.get(F.array(*layout), (k % len(_LAYOUTS)).cast("int"))))
    got = toolchain.toolchain(files)
    joined = {n: F.array_join(n, ",") for n in ("frameworks", "test_frameworks", "test_configs")}
    linters = F.array_join(F.transform("linters", lambda x: F.concat_ws("=", x["tool"], x["file"])), ",")
    return got.withColumns(joined | {"linters": linters, "coverage_tooling": F.coalesce("coverage_tooling", F.lit("")), "coverage_threshold": F.coalesce("coverage_threshold", F.lit(-1)).cast("long")})


QUERIES = {"toolchains": toolchains}
ORACLE = {
    "toolchains": """
    WITH t AS (SELECT * FROM (VALUES
        (0, 'React,tRPC', 'ESLint=.eslintrc.json', 'jest', 'jest.config.js', 'NYC/Istanbul', -1, 'web app'),
        (1, 'Express,Zod', 'Prettier=.prettierrc.json', 'vitest', 'vitest.config.ts', 'configured in vitest.config.ts', 90, 'library'),
        (2, 'Docker,FastAPI,Flask', 'ruff=pyproject.toml,flake8=setup.cfg', 'pytest', 'pyproject.toml', '', -1, 'API service'),
        (3, 'Go Modules,Make', 'golangci-lint=.golangci.yml', 'go test', '', '', -1, 'CLI / service'),
        (4, 'Rust (Cargo),Ruby (Bundler)', '', 'cargo test,RSpec,Minitest', '', '', -1, 'CLI'),
        (5, 'Flutter/Dart', '', '', '', '', -1, 'mobile')) AS v(k, frameworks, linters, test_frameworks, test_configs, coverage_tooling, coverage_threshold, project_type))
    SELECT s_suppkey AS repo_id, frameworks, linters, test_frameworks, test_configs, coverage_tooling, CAST(coverage_threshold AS BIGINT) AS coverage_threshold, project_type FROM supplier JOIN t ON s_suppkey % 6 = k""",
}
