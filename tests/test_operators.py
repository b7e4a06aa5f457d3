"""Operators over checkouts, logs and texts, on small cases with known results."""

import re
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, redact, testlogs
from lodestone.operators import commits, files, scans
from lodestone.sources.checkouts import CheckoutFiles, CheckoutLog

U = "\x1f"
TREE = {
    "src/a.py": "x=1\n\ny=2\n", "src/b.go": "// Code generated by x\n", "vendor/b.py": "x", ".hidden/c.py": "x", "chart/Chart.yaml": "apiVersion: v2\n",
    "chart/templates/d.yaml": "kind: Pod\n", "other/templates/e.yaml": "a: 1\n", "k/p.yaml": "apiVersion: v1\nkind: Pod\n", "tests/test_a.py": "assert 1\n",
    "tests/fixtures/f.json": "{}\n", "Dockerfile": "FROM x\n", "main.tf": "a\nb\n", ".github/workflows/ci.yml": "apiVersion: 1\nkind: x\n", "src/__init__.py": "",
}


@pytest.fixture(scope="module")
def checkout(tmp_path_factory):
    root = tmp_path_factory.mktemp("checkout")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=a@x.org", *a], check=True, capture_output=True)
    run("init", "-q")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    run("add", "-f", ".")
    run("commit", "-qm", "feat: first")
    return str(root)


@pytest.fixture(scope="module")
def stats(spark, checkout):
    spark.dataSource.register(CheckoutFiles)
    rows = spark.read.format("checkout_files").option("r", checkout).load()
    return files.file_stats(rows.select("repo_id", "path", F.decode("content", "UTF-8").alias("text")))


def test_tree_of_a_checkout(stats):
    got = {r["path"]: r for r in stats.collect()}
    assert set(got) == set(TREE) - {"vendor/b.py", ".hidden/c.py"}
    assert {p: r["iac_kind"] for p, r in got.items() if r["iac_kind"]} == {"chart/Chart.yaml": "Helm", "chart/templates/d.yaml": "Helm", "k/p.yaml": "Kubernetes", "Dockerfile": "Dockerfile", "main.tf": "Terraform"}
    assert got["src/b.go"]["is_generated"] and got["src/a.py"]["loc"] == 2 and got["src/__init__.py"]["loc"] == 0


def test_tree_aggregates(stats):
    (lang,) = files.languages(stats).collect()
    assert (lang["total_loc"], lang["loc_by_language"], lang["files_by_language"], lang["primary_language"], lang["secondary_languages"]) == (3, {"Python": 3}, {"Python": 3}, "Python", [])
    (test,) = files.tests(stats).collect()
    assert tuple(test)[1:] == (1, 1, 2)
    (iac,) = files.infrastructure(stats).collect()
    assert (iac["iac_files"], iac["iac_loc"], iac["helm_files"], iac["terraform_loc"], iac["ansible_files"]) == (5, 7, 2, 2, 0)
    assert files.largest(stats, 2).select("path").collect() == [("k/p.yaml",), ("main.tf",)]


def test_order_statistics_are_elements_of_the_sorted_sizes(spark):
    sizes = [1, 1, 2, 2, 2, 3, 5, 8, 13, 600, 1200]
    rows = [("r", f"{k}.py", ".py", "Python", n, True, False, False, False, None) for k, n in enumerate(sizes)]
    stats = spark.createDataFrame(rows, "repo_id string, path string, ext string, lang string, loc long, is_code boolean, is_generated boolean, is_test boolean, is_fixture boolean, iac_kind string")
    (got,) = files.sizes(stats).collect()
    n = len(sizes)
    assert (got["files"], got["median_loc"], got["p90_loc"], got["over_500"], got["over_1000"]) == (n, sizes[n // 2], sizes[int(n * 0.9)], 2, 1)
    assert files.sizes(stats.where("false")).count() == files.languages(stats.where("false")).count() == 0


def test_path_predicates(spark):
    cases = {"a/FooTest.java": (True, ".java"), "a/footest.java": (False, ".java"), "x/TESTS/a": (True, ""), ".bashrc": (False, ""), "a.": (False, ""), "b.spec.ts": (True, ".ts")}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r[0]: (r[1], r[2]) for r in df.select("p", paths.is_test(F.col("p")), paths.extension(F.col("p"))).collect()} == cases


def test_log_of_a_checkout(spark, checkout):
    spark.dataSource.register(CheckoutLog)
    lines = spark.read.format("checkout_log").option("r", checkout).load()
    (c,) = commits.commit_classes(commits.commits(lines), commits.commit_files(lines)).collect()
    assert (c["subject"], c["name"], c["files"], c["klass"]) == ("feat: first", "Ann", len(TREE), None)
    assert spark.read.format("checkout_log").option("none", "/nowhere").load().count() == 0


def _header(k: str, who: str, at: str, subject: str) -> str:
    return U.join([k * 7, k, who, f"{who}@x", at, subject])


LOG = [
    "9\t9\tstray", _header("4", "Ann", "2024-03-01T23:30:00-05:00", "feat: add"), "10\t0\tsrc/a.py", "5\t0\ttests/test_a.py", "",
    _header("3", "dependabot[bot]", "2024-02-01T00:00:00+00:00", "bump x"), "1\t1\tpackage.json", _header("2", "Bob", "2024-01-01T00:00:00+00:00", "Fixes crash"),
    "30\t20\tsrc/b.py", "-\t-\timg.bin", _header("1", "Bob", "2023-01-01T00:00:00+00:00", "tests in bulk"), *(f"1\t0\tspec/{k}.rb" for k in range(20)),
]


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_classes_of_commits(spark, monkeypatch, block):
    monkeypatch.setattr(commits, "BLOCK", block)
    lines = spark.createDataFrame([("r", k, t) for k, t in enumerate(LOG)], "repo_id string, line_no long, text string")
    log = commits.commits(lines)
    classes = commits.commit_classes(log, commits.commit_files(lines))
    got = {r["short"]: (r["klass"], r["latent_tasks"], r["is_repair"], r["is_mineable"], r["files"]) for r in classes.collect()}
    assert got == {"4": ("A", 1, False, False, 2), "3": (None, 0, False, False, 1), "2": (None, 0, True, True, 2), "1": ("B", 15, False, False, 20)}
    (n,) = commits.class_counts(classes).collect()
    assert (n["class_a"], n["class_b"], n["class_d"], n["confirmed"], n["provisional"], n["real_commits"], n["authors"]) == (1, 1, 1, 16, 16, 3, 2)
    assert commits.commits_by_month(log).collect()[0][1] == [0] * 9 + [1, 1, 1]
    (s,) = commits.repository_stats(log, spark.createDataFrame([("r", 0)], "repo_id string, merge_commits long")).collect()
    assert (s["commits"], s["human_authors"], s["bot_authors"], s["span_days"], s["conventional_rate"], s["looks_like_burst_copy"]) == (4, 2, 1, 426, 0.25, False)


def test_commits_are_counted_in_parts_that_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(scans, "TASK_ROWS", 5)
    log = spark.createDataFrame([("r", k, "x", f"x{k % 3}@y", "2024-01-01T00:00:00+00:00", "s", False) for k in range(40)], "repo_id string, header long, name string, address string, at string, subject string, is_bot boolean")
    changed = spark.createDataFrame([("r", k, f"{d}/a.c", 1, 0) for k in range(40) for d in "ab"], "repo_id string, header long, path string, added long, deleted long")
    classes = commits.commit_classes(log, changed)
    plan = classes._jdf.queryExecution().executedPlan().toString()
    assert [int(n) for n in re.findall(r"Exchange hashpartitioning\([^\n]*?, (\d+)\)", plan)] == [8, 8]
    assert {(r["files"], r["dirs"]) for r in classes.collect()} == {(2, 2)} and commits.class_counts(classes).first()["authors"] == 3


def test_a_size_that_ends_in_a_half_is_rounded_up(spark):
    log = spark.createDataFrame([("r", 1, "x", "x@y", "2024-01-01T00:00:00+00:00", "s", False)], "repo_id string, header long, name string, address string, at string, subject string, is_bot boolean")
    changed = spark.createDataFrame([("r", 1, p, n, 0) for p, n in (("src/a.c", 17), ("src/b.c", 1), ("lib/c.c", 1))], "repo_id string, header long, path string, added long, deleted long")
    (row,) = commits.commit_classes(log, changed).collect()
    # 3 * 0.15 + 2 * 0.1 + 19 / 2000 is 0.6595.
    assert (row["repair_complexity"], row["band"]) == (0.66, "Large")


def test_refs_collapse_by_commit(spark):
    rows = [("r", "refs/heads/b", "commit", "s1", None, 5), ("r", "refs/heads/a", "commit", "s1", None, 5), ("r", "refs/tags/v1", "tag", "t", "s2", 9)]
    got = commits.collapsed_refs(spark.createDataFrame(rows, "repo_id string, ref string, object_type string, sha string, peeled_sha string, commits long")).orderBy("place").collect()
    assert [(r["tip"], r["ref"], r["names"]) for r in got] == [("s2", "refs/tags/v1", 1), ("s1", "refs/heads/a", 2)]


def test_masks(spark):
    cases = {
        "write to a.b@c.org now": "write to [email] now", "see src/x/y.py and lib/z.py": "see [path] and [path]", "src/a.py lib/b.py": "[path]", "in main.py": "in [file]",
        "uses PostgreSQL and BillingGateway": "uses PostgreSQL and [identifier]", "Acme": "[identifier]", "Python": "Python", "Then it ran": "Then it ran",
        "e.g. the U.S. form": "e.g. the U.S. form", "call os.path.join": "call [identifier]", "the db_url of AWS": "the [identifier] of [identifier]", "it's 'so' ok": "it's ok", "": "",
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None, "word " * 1000]], "t string").withColumn("s", redact.scrubbed(F.col("t")))
    rows = df.select("t", "s", redact.leak(F.col("s")).alias("leak"), redact.leak(F.col("t")).alias("before")).collect()
    got = {r["t"]: r["s"] for r in rows}
    assert {t: got[t] for t in cases} == cases and got[None] == ""
    assert len(got["word " * 1000]) <= redact.MOST_CHARS + 3 and got["word " * 1000].endswith("word...")
    assert {r["leak"] for r in rows} == {None}
    assert {r["t"]: r["before"] for r in rows}["uses PostgreSQL and BillingGateway"] == "a class name"


LOGS = [
    ("pytest", "collected 4 items\n3 passed, 1 failed in 0.4s", (4, 3, 1, None, None)), ("pytest", "no tests ran", (0, None, None, None, None)),
    ("pytest", "9 passed" + "x" * 6000, (None, None, None, None, None)), ("jest", "Tests:  1 failed, 2 passed, 3 total", (3, 2, 1, None, None)),
    ("vitest", "  Tests  2 passed | 1 skipped (3)", (3, 2, None, None, 1)), ("mocha", "  5 passing\n  1 pending", (6, 5, None, None, 1)), ("mocha", "", (None,) * 5),
    ("cargo", "test result: ok. 1 passed; 0 failed; 2 ignored\ntest result: ok. 4 passed; 1 failed; 0 ignored", (8, 5, 1, None, 2)),
    ("go", '{"Action":"pass","Test":"A"}\n{"Action":"pass"}\n {bad\n{"Action":"fail","Test":"B"}', (2, 1, 1, None, 0)), ("go", '{"Action":"pass"}', (None,) * 5),
    ("dotnet", "Failed: 1\nPassed: 2\nSkipped: 0\nTotal: 3", (3, 2, 1, None, 0)), ("phpunit", "OK (7 tests, 9 assertions)", (7, 7, 0, None, None)),
    ("phpunit", "Tests: 9, Failures: 2, Skipped: 1", (9, 6, 2, None, 1)), ("rspec", "5 examples, 1 failure, 2 pending", (5, 2, 1, None, 2)), ("other", "1 passed", (None,) * 5), ("jest", None, (None,) * 5),
]


def test_counts_of_logs(spark):
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(LOGS)], "k int, runner string, log string")
    got = df.select("k", testlogs.counts(F.col("log"), F.col("runner")).alias("c")).orderBy("k").collect()
    assert [tuple(r["c"]) for r in got] == [want for _, _, want in LOGS]


def test_listings(spark):
    rows = [("go_list", "TestA\nok pkg\n ExampleB", 2), ("cargo_list", "a: test\nb: bench\nc: test ", 2), ("jest_files", "/a/b.test.ts\nC:\\x.js\nrel.js", 2), ("phpunit_list", " - A::b\n - C", 2), ("rspec_dry", "3 examples, 0 failures", 3), ("what", "x", 0)]
    df = spark.createDataFrame(rows, "kind string, t string, n int")
    assert all(r[0] == r[1] for r in df.select("n", testlogs.listed(F.col("t"), F.col("kind"))).collect())


def test_patterns_are_valid_everywhere():
    for pattern in (commits.CONVENTIONAL, commits.NOISE, commits.FEATURE, commits.REPAIR, *(p for _, p, _ in redact.MASKS)):
        re.compile(pattern)
