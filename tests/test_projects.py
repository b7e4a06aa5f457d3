"""Roots, workspaces, numbers and places of projects; entries of lockfiles and names in manifests."""

import pytest

from lodestone.operators import manifests, projects

FILES = "repo_id string, path string, content string"


def _files(spark, files):
    return spark.createDataFrame([("r", k, v) for k, v in files.items()], FILES)


def _projects(spark, files):
    found, left = projects.projects(_files(spark, files))
    return {r["root"]: r for r in found.collect()}, {(r["root"], r["reason_code"]) for r in left.collect()}


def test_roots_are_walked_with_bounds(spark):
    files = {"pyproject.toml": "", "src/a.py": "", "vendor/x/package.json": "{}", "a/node_modules/p/package.json": "{}", ".ci/go.mod": "", "a/b/c/d/Gemfile": "", "a/b/c/d/e/go.mod": "", "a/b/c/d/e/f/Cargo.toml": "", "n/x.csproj": "", "n/Cargo.toml": ""}
    df = _files(spark, files)
    assert {(r["root"], r["ecosystem"]) for r in projects.roots(df).collect()} == {("", "python"), ("a/b/c/d", "ruby"), ("n", "dotnet"), ("n", "rust")}
    assert [tuple(r) for r in projects.unreached(df).collect()] == [("r", "a/b/c/d/e", "depth_limit", ["go"])]
    got = projects.survey(df).collect()[0]
    # Ten files, of which the walk reaches five, in nine directories: "", src, a and its three, n.
    assert (got["files_scanned"], got["dirs_scanned"], got["n_projects"], got["ecosystems"]) == (5, 7, 4, ["dotnet", "python", "ruby", "rust"])


@pytest.mark.parametrize(
    "root, content, inside, claimed",
    [
        ("package.json", '{"workspaces": ["packages/*"]}', "packages/a/package.json", True),
        ("package.json", '{"workspaces": {"packages": ["packages/*"]}}', "apps/a/package.json", False),
        ("package.json", "not json", "packages/a/package.json", False),
        ("Cargo.toml", '[workspace]\nmembers = ["c/*", "d"]\nexclude = ["d"]\n', "c/x/Cargo.toml", True),
        ("Cargo.toml", '[workspace]\nmembers = ["c/*", "d"]\nexclude = ["d"]\n', "d/Cargo.toml", False),
        ("Cargo.toml", "[workspace]\n", "any/Cargo.toml", True),
        ("pom.xml", "<project><modules></modules></project>", "m/pom.xml", True),
        ("pom.xml", "<project/>", "m/pom.xml", False),
        ("settings.gradle", "", "m/build.gradle.kts", True),
        ("all.sln", "", "m/x.fsproj", True),
    ],
)
def test_workspaces_claim_what_they_name(spark, root, content, inside, claimed):
    found, _ = _projects(spark, {root: content, inside: "{}"})
    assert (len(found) == 1 and found[""]["members"] == [inside.rsplit("/", 1)[0]] and found[""]["workspace"]) is claimed


def test_nearest_claim_and_lost_members(spark):
    files = {"go.work": "", "go.mod": "", "pnpm-workspace.yaml": "packages:\n  - 'a/**'\n", "package.json": "{}", "a/go.work": "", "a/go.mod": "", "a/b/go.mod": "", "a/b/package.json": "{}"}
    found, left = _projects(spark, files)
    # a is a member of the root's workspace, so what a claims has no project of its own to go to.
    assert {(r["root"], r["ecosystem"]) for r in projects.projects(_files(spark, files))[0].collect()} == {("", "go"), ("", "node")}
    assert left == {("a/b", "workspace_root_not_probed")}
    rows = {r["ecosystem"]: r["members"] for r in projects.projects(_files(spark, files))[0].collect()}
    assert rows == {"go": ["a"], "node": ["a/b"]}


def test_budget_keeps_the_first_and_ancillary_is_lifted(spark):
    files = {f"p{i:02d}/pyproject.toml": "" for i in range(30)} | {f"p{i:02d}/f{j}.py": "" for i in range(30) for j in range(30 - i)}
    found, left = _projects(spark, files)
    assert set(found) == {f"p{i:02d}" for i in range(24)} and left == {(f"p{i:02d}", "project_budget_exhausted") for i in range(24, 30)}
    assert [found[f"p{i:02d}"]["weight"] for i in range(24)] == [31 - i for i in range(24)]
    only, _ = _projects(spark, {"docs/pyproject.toml": ""})
    both, _ = _projects(spark, {"docs/pyproject.toml": "", "go.mod": ""})
    assert only["docs"]["required"] and both[""]["required"] and not both["docs"]["required"]
    rows = [("r", "a", "rust", False, 10), ("r", "b", "rust", True, 10), ("r", "c", "python", False, 8), ("r", "d", "go", False, 9)]
    placed = projects.allocated(spark.createDataFrame(rows, "repo_id string, root string, ecosystem string, workspace boolean, weight long"), 2).orderBy("place").collect()
    assert [(r["root"], r["probed"]) for r in placed] == [("d", True), ("b", True), ("a", False), ("c", False)]


def test_lockfiles_are_counted_by_format(spark):
    locks = {
        "package-lock.json": '{"packages": {"": {}, "a": {"x": 1}, "b": null}}', "v1/package-lock.json": '{"dependencies": {"a": {}}}', "bad/package-lock.json": "{",
        "yarn.lock": "# x\n\n\na@1:\n  v\n\n\n\nb@2:\n\n", "pnpm-lock.yaml": "  /no:\npackages:\n  /a/1:\n    x\n  /b/2:\n", "poetry.lock": "[[package]]\nname\n[[package]]\n", "Cargo.lock": "[[package]]",
        "go.sum": "a v1 h1:x\na v1/go.mod h1:y\nb v2 h1:z\n", "Gemfile.lock": "GEM\n  remote: x\n  specs:\n  rails (7)\n    dep (1)\n   odd\nPLATFORMS\n  ruby\n", "uv.lock": "[[package]]", "composer.lock": None, "x.txt": "a",
    }
    got = {r["path"]: r["entries"] for r in manifests.locked_entries(_files(spark, locks)).collect()}
    assert got == {"package-lock.json": 3, "v1/package-lock.json": 1, "bad/package-lock.json": 0, "yarn.lock": locks["yarn.lock"].count("\n\n"), "pnpm-lock.yaml": 2, "poetry.lock": 2, "Cargo.lock": 1, "go.sum": 1, "Gemfile.lock": 3, "uv.lock": 0, "composer.lock": 0}


def test_names_of_many_manifests(spark):
    files = {
        "pyproject.toml": '[tool.poetry]\nname = "s"\n[tool.poetry.dependencies]\npython = "^3.11"\ndjango = "^5"\n[tool.poetry.group.dev.dependencies]\npytest = "^8"\n[dependency-groups]\nx = ["ruff>=1", {include-group = "y"}]\n',
        "requirements.txt": "boto3==1\n# c\nsqlalchemy>=2  # in\n-e .\n", "Pipfile": '[packages]\nrequests = "*"\n[dev-packages]\nblack = "*"\n',
        "setup.cfg": "[flake8]\nmax-line-length = 100\n", "setup.py": "setup(install_requires=['numpy>1', \"Foo_Bar\"], extras_require={'t': ['z']})", "Gemfile": "gem 'sinatra'\n",
        "go.mod": "module example.com/svc\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n)\n", "build.gradle": "implementation 'a.b:c:1.0'\n", "sub/package.json": '{"dependencies": {"no": "1"}}',
        "composer.json": '{"require": {"php/x": "1"}}', "pubspec.yaml": "name: n\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^1\ndev_dependencies:\n  lints: 2\nflutter:\n  uses: x\n",
    }
    got = {}
    for r in manifests.declared_names(_files(spark, files)).collect():
        got.setdefault(r["ecosystem"], set()).add(r["name"])
    assert got == {
        "pypi": {"python", "django", "pytest", "ruff", "boto3", "sqlalchemy", "requests", "black", "numpy", "foo-bar", "t", "z"}, "gem": {"sinatra"}, "go": {"github.com/gin-gonic/gin"},
        "maven": {"a.b:c"}, "composer": {"php/x"}, "pub": {"flutter", "sdk", "http", "lints"},
    }
    assert manifests.update_tool(_files(spark, files | {"renovate.json": ""})).first()[1] == "Renovate" and manifests.update_tool(_files(spark, files)).first()[1] == "none"


def test_no_table_of_projects_passes_the_driver(spark):
    files = spark.createDataFrame([(1, "package.json", "{}")], "repo_id long, path string, content string")
    rows, left_out = projects.projects(files)
    for df in (rows, left_out):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
