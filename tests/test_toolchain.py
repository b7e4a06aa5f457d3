"""What the files of a repository say about its tools."""

import pytest

from lodestone.operators import toolchain

FILES = "repo_id string, path string, content string"


def _tools(spark, files):
    return toolchain.toolchain(spark.createDataFrame([("r", k, v) for k, v in files.items()], FILES)).collect()[0]


def test_a_web_app_and_its_runners(spark):
    files = {"package.json": '{"private": true, "main": "x.js", "dependencies": {"react": "18", "next": "1"}, "devDependencies": {"jest": "29", "nyc": "15"}}', ".eslintrc.json": "{}", "jest.config.js": "coverageThreshold: { global: { lines: 80 } }", "vitest.config.ts": "coverage: {\n thresholds: { lines: 90 } }"}
    got = _tools(spark, files)
    assert got["frameworks"] == ["React"] and got["project_type"] == "web app"
    assert [tuple(x) for x in got["linters"]] == [("ESLint", ".eslintrc.json")]
    assert (got["test_frameworks"], got["test_configs"]) == (["vitest", "jest"], ["vitest.config.ts", "jest.config.js"])
    # The threshold is read only where it is spelled in lower case.
    assert (got["coverage_tooling"], got["coverage_threshold"]) == ("NYC/Istanbul", 90)
    assert _tools(spark, files | {"next.config.js": ""})["frameworks"] == ["Next.js"]


@pytest.mark.parametrize(
    "files, kind",
    [
        ({"package.json": '{"main": "a.js"}'}, "library"), ({"package.json": '{"main": "a.js"}', "angular.json": ""}, "web app"), ({"package.json": "broken", "README.md": "flask"}, "unknown"),
        ({"requirements.txt": "Flask==1\n"}, "API service"), ({"pubspec.yaml": ""}, "mobile"), ({"main.tf": None}, "infrastructure"), ({"go.mod": "", "main.go": ""}, "CLI / service"), ({"go.mod": ""}, "unknown"),
        ({"Cargo.toml": "", "src/main.rs": "fn main() {}"}, "CLI"), ({"Cargo.toml": "", "src/lib.rs": ""}, "library"), ({"sub/angular.json": ""}, "unknown"),
    ],
)
def test_kinds_of_repositories(spark, files, kind):
    assert _tools(spark, files)["project_type"] == kind
