"""Workflow files as rows, the commands they run and what those hand on to."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import yaml_rows
from lodestone.operators import ci, scans

FILES = "repo_id string, path string, content string"


def _values(spark, text):
    rows = yaml_rows.values(spark.createDataFrame([("r", "f", text)], FILES)).collect()
    return {"/".join(r["keys"]): r["value"] for r in rows}


def test_sequences_block_scalars_and_flow_values(spark):
    text = """
# a comment
"on":
  push:
    branches: [ main, 'dev: x' ]
  pull_request:
jobs:
  t:
    steps:
    - uses: actions/checkout@v4
    - name: "a \\"b\\""   # why
      run: |
        pip install -e .

        key: not a key
          deeper
        # kept
    - run: >-
        one
        two

        three
      with: {a: 1, b: 'x'}
    -
      run: plain
        goes on
    script:
      - - x
        - y
      - z: 1
        w: ~
      - |
        text
"""
    steps = "jobs/t/steps"
    assert _values(spark, text) == {
        "on/push/branches/[0]": "main", "on/push/branches/[1]": "dev: x", "on/pull_request": None,
        f"{steps}/[0]/uses": "actions/checkout@v4", f"{steps}/[1]/name": 'a "b"', f"{steps}/[1]/run": "pip install -e .\n\nkey: not a key\n  deeper\n# kept\n",
        f"{steps}/[2]/run": "one two\nthree", f"{steps}/[2]/with/a": "1", f"{steps}/[2]/with/b": "x", f"{steps}/[3]/run": "plain goes on",
        "jobs/t/script/[0]/[0]": "x", "jobs/t/script/[0]/[1]": "y", "jobs/t/script/[1]/z": "1", "jobs/t/script/[1]/w": None, "jobs/t/script/[2]": "text\n",
    }
    assert _values(spark, "") == {} == _values(spark, None)
    assert _values(spark, "- a\n- b: c\r\n  d: e\n") == {"[0]": "a", "[1]/b": "c", "[1]/d": "e"}


def test_documents_that_are_not_read(spark):
    bad = {"tab": "a: 1\n\tb: 2\n", "stray": "a: 1\nfoo\n", "open": "a: [1\nb: 2\n", "second": "---\na: 1\n---\nb: 2"}
    good = {"flow": "---\na: [1,\n 2]\n", "none": None, "tabbed text": "a: |\n  x\n  \ty\n"}
    df = spark.createDataFrame([("r", k, v) for k, v in (bad | good).items()], FILES)
    assert {r["path"] for r in yaml_rows.unreadable(df).collect()} == set(bad)


PIPELINE = {
    "Makefile": "all: lint check\n\ncheck:\n\t@pytest -q\n\n# not this one\nlint:\n\truff check .\n",
    ".github/workflows/main.yml": "on: [push]\nenv:\n  PYTHON: python3\njobs:\n  one:\n    steps:\n      - run: make check\n      - run: ${{ env.PYTHON }} -m mypy src\n"
    "      - run: bash tools/look.sh\n      - name: off\n        if: false\n        run: eslint .\n  two:\n    if: ${{ false }}\n    steps:\n      - run: flake8\n      - uses: psf/black@v1\n",
    "tools/look.sh": "#!/bin/sh\npip-audit\n",
}


def _flags(spark, files):
    return ci.flags(spark.createDataFrame([("r", k, v) for k, v in files.items()], FILES)).collect()[0]


def test_pipeline_is_followed_into_the_repository(spark):
    got = _flags(spark, PIPELINE)
    assert got["ci_systems"] == ["GitHub Actions"] and got["ci_analysis_method"] == "parsed" and got["ci_present"]
    assert got["runs_tests"] is True and got["runs_typecheck"] is True
    # All that lints stands behind a literal that switches it off, or behind a target that nothing calls.
    assert got["runs_lint"] is False and got["has_deploy_pipeline"] is False


def test_unread_and_absent_configurations(spark):
    broken = _flags(spark, {".travis.yml": "script:\n\t- pytest\n", "a": None})
    assert (broken["runs_tests"], broken["ci_analysis_method"], broken["ci_systems"]) == (None, "parser_unavailable", ["Travis CI"])
    none = _flags(spark, {"README": "x"})
    assert (none["runs_tests"], none["ci_analysis_method"], none["ci_present"]) == (False, "no_ci", False)
    skipped = _flags(spark, {"Jenkinsfile": "stage { sh 'mvn -DskipTests install' \n sh(\"\"\"\n tsc\n npm publish\"\"\") }"})
    assert (skipped["runs_tests"], skipped["runs_typecheck"], skipped["has_deploy_pipeline"]) == (False, True, True)


def _expanded(spark, commands, files, hops=2):
    behind = ci.bodies(spark.createDataFrame([("r", k, v) for k, v in files.items()], FILES))
    rows = spark.createDataFrame([("r", str(k), c) for k, c in enumerate(commands)], "repo_id string, call string, command string")
    got = ci.expanded(rows, behind, hops).orderBy("call", "trail").collect()
    return [r["command"] for r in got]


def test_expansion_replaces_only_what_is_conclusive(spark):
    files = {"package.json": '{"scripts": {"test": "eslint .", "build": "node b.js", "deep": "npm run test"}}', "Makefile": "a: b\n\tmake b\nb:\n\tmake c\nc:\n\tpytest\nloop:\n\tmake loop\n\techo x\n"}
    assert _expanded(spark, ["npm test", "npm run build", "yarn deep"], files) == ["eslint .", "npm run build", "node b.js", "eslint ."]
    assert _expanded(spark, ["make a"], files) == ["make a", "make b", "make c"] and _expanded(spark, ["make a"], files, 3) == ["pytest"]
    assert _expanded(spark, ["make loop"], files, 5) == ["make loop", "make loop", "echo x"]
    assert _expanded(spark, ["bash gone.sh", "make nothing"], files) == ["bash gone.sh", "make nothing"]


def test_calls_are_followed_in_parts_that_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(scans, "TASK_ROWS", 5)
    behind = ci.bodies(spark.createDataFrame([("r", "Makefile", "a:\n\tmake b\nb:\n\tpytest\n")], FILES))
    rows = spark.createDataFrame([("r", str(k), ["make a", "ls"][k % 2]) for k in range(40)] + [("r", "none", None), (None, "odd", "make a")], "repo_id string, call string, command string")
    df = ci.expanded(rows, behind)
    got = {(r["repo_id"], r["call"]): (len(r["trail"]), r["command"]) for r in df.collect()}
    assert got == {("r", str(k)): [(2, "pytest"), (0, "ls")][k % 2] for k in range(40)} | {(None, "odd"): (0, "make a")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\(repo_id[^\n]*?(?:command|open)#[^\n]*?, (\d+)\)", plan)) == {"9"}


def test_commands_are_split_and_unwrapped(spark):
    cut = lambda text: spark.range(1).select(ci.split_commands(F.lit(text))).first()[0]
    assert cut("cd x && A=1 poetry run pytest; # no\n sudo time tox || true\n\n") == ["cd x", "pytest", "tox", "true"]


@pytest.mark.parametrize("block", [2, 1024])
def test_automaton_is_the_same_whatever_the_blocks(spark, block):
    text = "x" + "".join("\n" * n + "x" for n in (1, 2, 3, 4, 5, 6)) + "\n\n"
    rows = scans.lines(spark.createDataFrame([("r", "a", text), ("r", "b", ""), ("r", "c", None)], FILES))
    step = F.when(F.col("text") == "", F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(1)))
    got = scans.states(rows, ["repo_id", "path"], "line", step, 2, block=block)
    ends = got.groupBy("path").agg(F.max("line").alias("last"))
    pairs = got.join(ends, "path").where("text = '' AND state = 1 AND line < last").groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in pairs} == {"a": text.count("\n\n")}


def test_values_grow_in_parts_by_file(spark, monkeypatch):
    df = spark.createDataFrame([("r", f"f{k}", "a: 1\n" * 20) for k in range(40)], FILES)
    monkeypatch.setattr(scans, "TASK_BYTES", 500)
    plan = yaml_rows.values(df)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\([^\n]*?, (\d+)\)", plan)) == {"8"}
