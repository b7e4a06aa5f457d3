"""More of the library's operators over rows of the driver tables; the SQL says what the numbers that made a row must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import testlogs, versions
from ..operators import assembly, closed, commits, files, identity, scans
from ..sources import sinks

_SUBJECTS = ["feat: add x", "fix(core): y", "chore: bump z", "docs: w", "implement v"]
_PATHS = ["src/a{}/f.py", "tests/test_a{}.py", "docs/a{}.md", "proto/a{}/x.proto", "web/a{}/b.spec.ts"]


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of twenty repositories, headers numbered by key."""
    k = F.col("o_orderkey")
    who = F.concat(F.lit("c"), F.col("o_custkey") % 300)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        (F.col("o_custkey") % 20).alias("repo_id"), k.alias("header"), k.cast("string").alias("sha"), F.when(F.col("o_custkey") % 9 == 0, "dependabot[bot]").otherwise(who).alias("name"),
        F.concat(who, F.lit("@x.org")).alias("address"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("at"), _pick(_SUBJECTS, k % 5).alias("subject"),
    ).withColumn("is_bot", commits.is_bot(F.col("name"), F.col("address")))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select("repo_id", F.col("header").alias("l_orderkey"))
    log = log.repartition(scans.parts(log, log.count(), scans.TASK_ROWS), "l_orderkey")
    path = F.regexp_replace(_pick(_PATHS, F.col("l_partkey") % 5), r"\{\}", (F.col("l_suppkey") % 3).cast("string"))
    # Neither table is small for sure, whatever is known of its size: lines meet their orders in the orders' parts.
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(log.hint("merge"), "l_orderkey")
    return items.select("repo_id", F.col("l_orderkey").alias("header"), path.alias("path"), F.col("l_quantity").cast("long").alias("added"), (F.col("l_linenumber") % 2).cast("long").alias("deleted"))


def commit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = commits.commit_classes(_log(spark, sf_dir), _changed(spark, sf_dir))
    return found.select("repo_id", "header", F.coalesce("klass", F.lit("")).alias("klass"), "latent_tasks", "is_repair", "is_mineable", "band", F.col("dirs").cast("long").alias("dirs"))


def commit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.class_counts(commits.commit_classes(_log(spark, sf_dir), _changed(spark, sf_dir)))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written out as lines and read again: a header and the files that stand below it."""
    s = F.lit(commits.SEPARATOR)
    heads = _log(spark, sf_dir).select("repo_id", F.col("header").alias("key"), F.lit(0).alias("n"), F.concat_ws(commits.SEPARATOR, "sha", F.substring("sha", 1, 7), "name", "address", "at", F.concat("subject", s, F.lit("end"))).alias("text"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(_log(spark, sf_dir).select("repo_id", F.col("header").alias("l_orderkey")), "l_orderkey")
    below = items.select("repo_id", F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n"), F.concat_ws("\t", F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col("l_quantity").cast("int").cast("string")), F.col("l_linenumber"), F.concat(F.lit("f"), "l_partkey")).alias("text"))
    number = F.row_number().over(Window.partitionBy("repo_id").orderBy("key", "n")) - 1
    lines = heads.unionByName(below).select("repo_id", number.cast("long").alias("line_no"), "text")
    log, changed = commits.commits(lines), commits.commit_files(lines)
    return log.select("repo_id", "header", "sha", "subject").join(changed, ["repo_id", "header"], "left").groupBy("repo_id", "sha", "subject").agg(F.count("path").alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))


def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first is the header order that the statistics go by."""
    log = _log(spark, sf_dir)
    newest = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("at"), "sha"))
    got = commits.repository_stats(log.withColumn("header", newest))
    return got.select("repo_id", "commits", "human_authors", "bot_authors", F.round(F.col("bot_share") * 10000).cast("long").alias("bot_share"), "span_days", "active_days", F.round(F.col("conventional_rate") * 10000).cast("long").alias("conventional_rate"))


def log_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.commits_by_month(_log(spark, sf_dir)).select("repo_id", F.array_join("commits_by_month", ",").alias("commits_by_month"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their language by the key, some vendored, generated, tests or fixtures."""
    k = F.col("doc_id")
    folder = _pick(["src", "tests", "node_modules/x", "tests/fixtures", "lib"], k % 5)
    path = F.concat(folder, F.lit("/f"), k, _pick([".py", ".ts", ".go", ".md", ".TSX", ""], k % 6))
    text = F.when(k % 11 == 0, F.concat(F.lit("// Code generated by x\n"), "text")).otherwise(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("repo_id"), path.alias("path"), text.alias("text"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = files.file_stats(_tree(spark, sf_dir))
    return stats.groupBy("repo_id", "ext", "lang", "is_code", "is_generated", "is_test", "is_fixture").agg(F.count("*").alias("files"))


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = files.languages(files.file_stats(_tree(spark, sf_dir)))
    return got.select("repo_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("files_by_language")))).alias("files_by_language"), F.size("secondary_languages").cast("long").alias("others"))


def file_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.tests(files.file_stats(_tree(spark, sf_dir)))


def infrastructure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = [
        ("Dockerfile", "FROM x\n"), ("infra/main.tf", "resource\n\n"), ("k8s/a.yaml", "apiVersion: v1\nkind: Pod\n"), ("docker-compose.yml", "services:\n  a:\n    image: b\n"), ("charts/c/Chart.yaml", "name: c\n"),
        ("cf/t.json", '{"AWSTemplateFormatVersion": "x"}\n'), ("playbooks/site.yml", "- name: x\n  hosts: all\n"), (".github/workflows/a.yml", "apiVersion: v1\nkind: Pod\n"), ("src/a.py", "x\n"),
    ]
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("d"), k, F.lit("/"), _pick([p for p, _ in kinds], k % 9)).alias("path"), _pick([t for _, t in kinds], k % 9).alias("text"))
    return files.infrastructure(files.file_stats(rows))


def test_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    p, f, s = k % 50 + 1, k % 7 + 1, k % 3 + 1
    logs = {
        "pytest": F.concat(F.lit("==== "), f, F.lit(" failed, "), p, F.lit(" passed, "), s, F.lit(" skipped in 1.2s ====\n")),
        "cargo": F.concat(F.lit("test result: FAILED. "), p, F.lit(" passed; "), f, F.lit(" failed; "), s, F.lit(" ignored; 0 measured\n")),
        "rspec": F.concat(p + f + s, F.lit(" examples, "), f, F.lit(" failures, "), s, F.lit(" pending\n")),
    }
    log = F.get(F.array(*logs.values()), (k % 3).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("o_orderkey"), testlogs.counts(log, _pick(list(logs), k % 3)).alias("c"))
    return rows.select("o_orderkey", *(F.col(f"c.{n}").cast("long").alias(n) for n in ("passed", "failed", "skipped")))


def version_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier asks for a range of minor versions; the versions at hand are those that parts name."""
    low = F.col("s_suppkey") % 9
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("repo_id"), F.lit("python").alias("lane"), F.concat(F.lit(">=3."), low, F.lit(",<3."), low + 2).alias("spec"))
    asked = asked.select("repo_id", "lane", versions.windows("spec", "lane", F.lit(False)).alias("windows"))
    there = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 4 <> 1").select(F.lit("python").alias("lane"), F.array(F.lit(3), (F.col("p_partkey") % 8).cast("int"), (F.col("p_size") % 3).cast("int")).alias("version"), F.lit(False).alias("is_default")).distinct()
    return versions.chosen(asked, there).select("repo_id", F.array_join("version", ".").alias("version"))


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts name companies: the key without its legal words groups what is spelled in several ways."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("Acme "), k % 6, _pick([" Inc.", " GmbH", "", ", LLC"], k % 4))
    family = _pick(identity.BY_STRENGTH, F.floor(k / 6) % 3)
    found = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 5 = 0").select(F.col("p_brand").alias("repo_id"), family.alias("family"), name.alias("name"), k.alias("seen"))
    nobody = spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey = 3").select(F.concat(F.lit("acme"), "r_regionkey").alias("key"))
    return identity.candidates(found, nobody).select("repo_id", "key", F.array_join("families", ",").alias("families"), "place")


def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.col("o_orderkey").cast("long").alias("place"))
    old, new = orders.where("k % 3 <> 0"), orders.where("k % 2 = 0").withColumn("o_orderstatus", F.lit("new"))
    return sinks.upserted(old, new, "k", "place").select("k", F.col("o_orderstatus").alias("status"))


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("k"), (k % 2 == 0).alias("flag"), F.when(k % 3 > 0, k).alias("number"), F.array(F.lit("a"), F.col("c_mktsegment")).alias("items"), F.map_from_arrays(F.array(F.lit("z"), F.lit("b")), F.array(k, k + 1)).alias("tally"),
    )
    return sinks.cells(rows)


def assembled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of suppliers' nations: sizes from customers, histories from suppliers; regions have no history, which stays null."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("loc"), F.count_if(F.col("c_custkey") % 4 == 0).alias("specs"))
    tree = customers.groupBy(F.col("c_nationkey").alias("repo_id")).agg(F.sum("loc").alias("total_loc"), F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "loc"))).alias("loc_by_language"), F.max_by("c_mktsegment", F.struct("loc", "c_mktsegment")).alias("primary_language"), F.sum("n").alias("source_files"), F.sum("specs").alias("spec_files"))
    git = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("repo_id")).agg(F.count("*").alias("commits"), F.count_if(F.col("s_acctbal") > 0).alias("human_authors"))
    ci = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("repo_id"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("Travis CI"))).otherwise(F.array().cast("array<string>")).alias("ci_systems"), (F.col("n_nationkey") % 2 == 0).alias("ci_present"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") % 3 == 1).alias("runs_tests"))
    own = lambda block, table: assembly.facts(table, block, {k: v for k, v in assembly.DECLARED[block].items() if k in table.columns})
    measured = assembly.assembled([own("tree", tree), own("git", git), own("ci", ci)], assembly.DECLARED)
    row = assembly.flat_row(measured).drop("languages", "active_days", "span_days", "capacity", "test_code_files")
    kinds = {c: closed.number() for c in row.columns if c not in ("primary_language", "test_source_ratio", "ci_present", "ci_runs_tests")}
    kinds |= {"primary_language": closed.token("[A-Z]+"), "test_source_ratio": closed.token(r"1:\d+|0 tests"), "ci_present": closed.choice([True, False]), "ci_runs_tests": closed.choice([True, False])}
    good = closed.enforce(row, {c: kinds[c] for c in row.columns}).where("size(violations) = 0").drop("violations")
    closed.audit_no_leak(good, exempt=["primary_language"])
    counts = {c: F.col(c).cast("string") for c in ("commit_count", "author_count")}
    return good.withColumns({"test_ratio": F.round(F.col("test_ratio") * 10000).cast("long"), **counts})


_ALL = (commit_kinds, commit_counts, log_lines, log_stats, log_months, file_kinds, file_languages, file_tests, infrastructure_files, test_logs, version_choice, company_names, upserted_rows, csv_cells, assembled_rows)
QUERIES = {q.__name__: q for q in _ALL}
_CLASSES = """
    c AS (SELECT o_custkey % 20 AS repo_id, o_orderkey AS header, o_orderkey % 5 AS s, o_custkey % 9 = 0 AS bot, o_custkey % 300 AS who, count(l_orderkey) AS files,
                 count(*) FILTER (l_partkey % 5 IN (1, 4)) AS tests, count(*) FILTER (l_partkey % 5 IN (0, 3)) AS work, count(DISTINCT ['src', 'tests', 'docs', 'proto', 'web'][l_partkey % 5 + 1]) AS dirs,
                 coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS added, coalesce(sum(l_linenumber % 2), 0) AS deleted,
                 count(*) FILTER (l_partkey % 5 IN (0, 2, 3)) AS mined
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    k AS (SELECT *, CASE WHEN files <= 30 AND dirs <= 3 AND NOT bot AND s NOT IN (2) AND tests >= 1 AND work >= 1 THEN 'A' WHEN NOT bot AND s NOT IN (2) AND tests >= 5 AND work < 3 THEN 'B'
                         WHEN files <= 30 AND dirs <= 3 AND NOT bot AND work >= 1 AND tests = 0 AND s IN (0, 4) THEN 'C-pre' ELSE '' END AS klass,
                 s = 1 AND work >= 1 AND NOT bot AND deleted >= 1 AND (tests >= 1 OR added <= 10 * deleted) AS is_repair,
                 round(least(1.0, 0.15 * work + 0.1 * dirs + (added + deleted) / 2000.0), 3) AS size, NOT bot AND mined >= 2 AND added + deleted BETWEEN 20 AND 10000 AS is_mineable FROM c)"""
_LOG = """l AS (SELECT o_custkey % 20 AS repo_id, o_orderkey AS key, o_orderkey % 5 AS s, o_custkey % 9 = 0 AS bot, o_custkey % 300 AS who, o_orderdate AS ts FROM orders)"""
_TREE = """
    f AS (SELECT source AS repo_id, doc_id, ['py', 'ts', 'go', 'md', 'tsx', ''][doc_id % 6 + 1] AS e, ['src', 'tests', 'node_modules', 'fixtures', 'lib'][doc_id % 5 + 1] AS d, doc_id % 11 = 0 AS gen,
                 len(list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12)) <> '')) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS loc FROM documents WHERE doc_id % 5 <> 2),
    g AS (SELECT *, CASE e WHEN 'py' THEN 'Python' WHEN 'go' THEN 'Go' WHEN 'md' THEN 'Markdown' WHEN '' THEN 'Other' ELSE 'TypeScript' END AS lang, e IN ('py', 'ts', 'go', 'tsx') AS code FROM f)"""
ORACLE = {
    "commit_kinds": f"""
    WITH {_CLASSES}
    SELECT repo_id, header, klass, CASE klass WHEN 'B' THEN least(tests, 15) WHEN '' THEN 0 ELSE 1 END AS latent_tasks, is_repair, is_mineable,
           CASE WHEN size < 0.33 THEN 'Small' WHEN size < 0.66 THEN 'Medium' ELSE 'Large' END AS band, dirs FROM k""",
    "commit_counts": f"""
    WITH {_CLASSES}, t AS (SELECT *, CASE klass WHEN 'B' THEN least(tests, 15) WHEN '' THEN 0 ELSE 1 END AS n FROM k)
    SELECT repo_id, count(*) AS analyzed_commits, count(*) FILTER (klass = 'A') AS class_a, count(*) FILTER (klass = 'B') AS class_b, count(*) FILTER (klass = 'C-pre') AS class_c_pre,
           count(*) FILTER (is_repair) AS class_d, CAST(coalesce(sum(n) FILTER (klass IN ('A', 'B')), 0) AS BIGINT) AS confirmed, CAST(sum(n) AS BIGINT) AS provisional,
           count(*) FILTER (NOT bot) AS real_commits, count(*) FILTER (is_mineable) AS mineable_commits, count(DISTINCT CASE WHEN NOT bot THEN who END) AS authors FROM t GROUP BY repo_id""",
    "log_lines": f"""
    WITH {_LOG}
    SELECT repo_id, CAST(key AS VARCHAR) AS sha, ['feat: add x', 'fix(core): y', 'chore: bump z', 'docs: w', 'implement v'][s + 1] || chr(31) || 'end' AS subject, count(l_orderkey) AS files,
           CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END), 0) AS BIGINT) AS added, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS deleted
    FROM l LEFT JOIN lineitem ON l_orderkey = key GROUP BY ALL""",
    "log_stats": f"""
    WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, CAST(key AS VARCHAR)) AS place FROM l)
    SELECT repo_id, count(*) AS commits, count(DISTINCT CASE WHEN NOT bot THEN who END) AS human_authors, count(DISTINCT CASE WHEN bot THEN who END) AS bot_authors,
           CAST(round(avg(CASE WHEN bot THEN 1 ELSE 0 END) * 10000) AS BIGINT) AS bot_share, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS span_days,
           count(DISTINCT CAST(ts AS DATE)) AS active_days, CAST(round(avg(CASE WHEN s <> 4 THEN 1 ELSE 0 END) FILTER (place <= 200) * 10000) AS BIGINT) AS conventional_rate FROM r GROUP BY repo_id""",
    "log_months": f"""
    WITH {_LOG}, t AS (SELECT repo_id, date_trunc('month', max(ts)) AS top FROM l GROUP BY 1), m AS (SELECT repo_id, top, unnest(range(0, 12)) AS k FROM t),
    n AS (SELECT m.repo_id, m.k, count(l.key) AS c FROM m LEFT JOIN l ON l.repo_id = m.repo_id AND date_trunc('month', l.ts) = m.top - to_months(CAST(11 - k AS INTEGER)) GROUP BY 1, 2)
    SELECT repo_id, string_agg(c, ',' ORDER BY k) AS commits_by_month FROM n GROUP BY 1""",
    "file_kinds": f"""
    WITH {_TREE} SELECT repo_id, CASE WHEN e = '' THEN '' ELSE '.' || e END AS ext, lang, code AS is_code, gen AS is_generated, d IN ('tests', 'fixtures') AS is_test, d = 'fixtures' AS is_fixture, count(*) AS files FROM g GROUP BY ALL""",
    "file_languages": f"""
    WITH {_TREE}, b AS (SELECT repo_id, lang, count(*) AS n FROM g WHERE code AND NOT gen GROUP BY 1, 2)
    SELECT r.repo_id, '{{' || coalesce(string_agg('"' || lang || '":' || n, ',' ORDER BY lang), '') || '}}' AS files_by_language, greatest(0, least(3, count(lang) - 1)) AS others
    FROM (SELECT DISTINCT repo_id FROM g) AS r LEFT JOIN b ON b.repo_id = r.repo_id GROUP BY 1""",
    "file_tests": f"""
    WITH {_TREE} SELECT repo_id, count(*) FILTER (d = 'tests' AND loc <= 5000) AS spec_files, count(*) FILTER (d = 'fixtures' OR d = 'tests' AND loc > 5000) AS fixture_files, count(*) FILTER (d IN ('tests', 'fixtures')) AS test_files FROM g GROUP BY 1""",
    "infrastructure_files": """
    WITH p AS (SELECT p_brand AS repo_id, p_partkey % 9 AS k FROM part)
    SELECT repo_id, count(*) FILTER (k < 7) AS iac_files, CAST(coalesce(sum([1, 1, 2, 3, 1, 1, 2][k + 1]) FILTER (k < 7), 0) AS BIGINT) AS iac_loc,
           count(*) FILTER (k = 6) AS ansible_files, 2 * count(*) FILTER (k = 6) AS ansible_loc, count(*) FILTER (k = 5) AS cloudformation_files, count(*) FILTER (k = 5) AS cloudformation_loc,
           count(*) FILTER (k = 3) AS docker_compose_files, 3 * count(*) FILTER (k = 3) AS docker_compose_loc, count(*) FILTER (k = 0) AS dockerfile_files, count(*) FILTER (k = 0) AS dockerfile_loc,
           count(*) FILTER (k = 4) AS helm_files, count(*) FILTER (k = 4) AS helm_loc, count(*) FILTER (k = 2) AS kubernetes_files, 2 * count(*) FILTER (k = 2) AS kubernetes_loc,
           count(*) FILTER (k = 1) AS terraform_files, count(*) FILTER (k = 1) AS terraform_loc FROM p GROUP BY 1""",
    "test_logs": "SELECT o_orderkey, o_orderkey % 50 + 1 AS passed, o_orderkey % 7 + 1 AS failed, o_orderkey % 3 + 1 AS skipped FROM orders",
    "version_choice": """
    WITH h AS (SELECT DISTINCT p_partkey % 8 AS minor, p_size % 3 AS patch FROM part WHERE p_partkey % 4 <> 1),
    r AS (SELECT s_suppkey, minor, patch, row_number() OVER (PARTITION BY s_suppkey ORDER BY minor, patch DESC) AS place FROM supplier JOIN h ON minor >= s_suppkey % 9 AND minor < s_suppkey % 9 + 2)
    SELECT s.s_suppkey AS repo_id, '3.' || minor || '.' || patch AS version FROM supplier AS s LEFT JOIN r ON r.s_suppkey = s.s_suppkey AND place = 1""",
    "company_names": """
    WITH e AS (SELECT DISTINCT p_brand AS repo_id, p_partkey % 6 AS k, p_partkey // 6 % 3 AS f FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 6 <> 3),
    g AS (SELECT repo_id, 'acme' || k AS key, count(*) AS n, min(f) AS best, string_agg(['licence_file', 'copyright_header', 'git_remote'][f + 1], ',' ORDER BY f) AS families FROM e GROUP BY 1, 2)
    SELECT repo_id, key, families, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, best, key) AS INTEGER) AS place FROM g""",
    "upserted_rows": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
    "csv_cells": """
    SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS number,
           '["a","' || c_mktsegment || '"]' AS items, '{"b":' || (c_custkey + 1) || ',"z":' || c_custkey || '}' AS tally FROM customer""",
    "assembled_rows": """
    WITH c AS (SELECT c_nationkey AS k, sum(c_custkey) AS loc, count(*) AS n, count(*) FILTER (c_custkey % 4 = 0) AS specs FROM customer GROUP BY 1),
    p AS (SELECT c_nationkey AS k, c_mktsegment AS lang FROM customer GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY sum(c_custkey) DESC, c_mktsegment DESC) = 1),
    g AS (SELECT s_nationkey AS k, count(*) AS commits, count(*) FILTER (s_acctbal > 0) AS authors FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1)
    SELECT n_nationkey AS repo_id, CAST(loc AS BIGINT) AS loc, lang AS primary_language, specs AS test_spec_files, CAST(round(round(specs / n, 4) * 10000) AS BIGINT) AS test_ratio,
           CASE WHEN specs > 0 THEN '1:' || CAST(round((n - specs) / specs) AS BIGINT) WHEN specs = 0 THEN '0 tests' END AS test_source_ratio, n_nationkey % 2 = 0 AS ci_present,
           CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 3 = 1 END AS ci_runs_tests, CAST(commits AS VARCHAR) AS commit_count, CAST(authors AS VARCHAR) AS author_count
    FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN p ON p.k = n_nationkey LEFT JOIN g ON g.k = n_nationkey""",
}
