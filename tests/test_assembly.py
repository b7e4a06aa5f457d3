"""Blocks that meet in one row, and the plan in which they do."""

import pytest

from lodestone.operators import assembly


def _blocks(spark):
    tree = spark.createDataFrame([("a", 10, {"Python": 7, "Go": 3}, "Python", 4, 1, "x"), ("b", 0, {}, None, 0, 0, "y")], "repo_id string, total_loc long, loc_by_language map<string,long>, primary_language string, source_files long, spec_files long, other string")
    ci = spark.createDataFrame([("a", ["Travis CI", "Jenkins"], True, None), ("c", [], False, False)], "repo_id string, ci_systems array<string>, ci_present boolean, runs_tests boolean")
    return [assembly.facts(tree, "tree", assembly.DECLARED["tree"]), assembly.facts(ci, "ci", assembly.DECLARED["ci"])]


def test_blocks_meet_and_unmeasured_is_not_zero(spark):
    rows = {r["repo_id"]: r for r in assembly.assembled(_blocks(spark), assembly.DECLARED).collect()}
    assert rows["a"]["tree"].asDict() == {"total_loc": 10, "loc_by_language": {"Python": 7, "Go": 3}, "primary_language": "Python", "source_files": 4, "spec_files": 1}
    assert rows["a"]["ci"].asDict() == {"ci_systems": ["Travis CI", "Jenkins"], "ci_present": True, "runs_tests": None}
    assert rows["b"]["tree"]["loc_by_language"] == {} and rows["b"]["tree"]["total_loc"] == 0 and rows["b"]["tree"]["primary_language"] is None
    assert rows["b"]["ci"]["ci_systems"] is None and rows["c"]["ci"]["ci_systems"] == [] and rows["c"]["tree"]["total_loc"] is None
    flat = {r["repo_id"]: r for r in assembly.flat_row(assembly.assembled(_blocks(spark), assembly.DECLARED)).collect()}
    assert (flat["a"]["loc"], flat["a"]["test_ratio"], flat["a"]["test_source_ratio"], flat["a"]["commit_count"]) == (10, 0.25, "1:3", None)
    assert (flat["b"]["test_ratio"], flat["b"]["test_source_ratio"], flat["c"]["test_source_ratio"], flat["c"]["ci_runs_tests"]) == (None, "0 tests", None, False)


def test_one_exchange_however_many_blocks(spark):
    whole = assembly.flat_row(assembly.assembled(_blocks(spark) * 2, assembly.DECLARED))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(repo_id") == 1 and "Join" not in plan


def test_undeclared_facts_are_refused(spark):
    stray = assembly.facts(spark.createDataFrame([("a", 1)], "repo_id string, secret long"), "tree", {"secret": assembly.NUMBER})
    with pytest.raises(Exception, match="not declared: tree.secret"):
        assembly.assembled([stray], assembly.DECLARED).collect()
