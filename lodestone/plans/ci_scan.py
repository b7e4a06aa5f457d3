"""Pipelines of repositories through the library's readers, over files that are derived from rows of the driver tables.

A turn of a conversation stands for a workflow file of the repository that its conversation is; customers stand for targets of
Makefiles, fifty to a repository, and orders for the commands that call them. The SQL never sees a file: it says what the rows
they were made of must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import yaml_rows
from ..operators import ci, scans


def _workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce(F.nullif(F.regexp_replace(F.trim(F.regexp_replace("text", r"\s*\n\s*", "\n")), r"^\s+|\s+$", ""), F.lit("")), F.lit("-")).alias("text"))
    content = F.concat(
        F.lit("# of a turn\nname: 'c: "), F.col("conv_id"), F.lit("'\non: [push, "), F.col("role"), F.lit("]\nenv:\n  ROLE: "), F.col("role"), F.lit(" # who\njobs:\n  t"), F.col("turn"),
        F.lit(":\n    steps:\n    - uses: actions/"), F.col("role"), F.lit("\n      with: {depth: "), F.col("turn"), F.lit("}\n    - run: |\n        "), F.regexp_replace("text", "\n", "\n        "),
        F.lit("\n    - run: ${{ env.ROLE }} -m pytest && poetry run mypy .\n    - name: off\n      if: false\n      run: eslint ."),
        F.when(F.col("role") == "assistant", "\n    - run: make -j2 check").when(F.col("turn") % 3 == 1, "\n    - run: pytest -q").otherwise(""), F.lit("\n"),
    )
    path = F.concat(F.lit(".github/workflows/t"), F.col("turn"), F.lit(".yml"))
    return turns.select(F.col("conv_id").alias("repo_id"), path.alias("path"), content.alias("content"))


def yaml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = yaml_rows.values(_workflows(spark, sf_dir))
    return found.select("repo_id", "path", F.array_join("keys", "/").alias("keys"), F.sha2(F.coalesce("value", F.lit("")), 256).alias("value_sha256"))


def ci_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = ci.steps(_workflows(spark, sf_dir)).select("repo_id", "path", F.inline("commands"))
    return commands.groupBy("repo_id", "path", "command").agg(F.count("*").alias("n"))


def ci_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _workflows(spark, sf_dir)
    makefiles = flows.select("repo_id").distinct().select("repo_id", F.lit("Makefile").alias("path"), F.lit("all: check\n\ncheck: all\n\t@ruff check .\n# then\n\tbash ci/run.sh\n").alias("content"))
    scripts = flows.select("repo_id").distinct().where("repo_id % 4 = 0").select("repo_id", F.lit("ci/run.sh").alias("path"), F.lit("#!/bin/sh\nset -e; sudo tsc --noEmit\n").alias("content"))
    plain = spark.read.parquet(f"{sf_dir}/region.parquet").select((-1 - F.col("r_regionkey")).cast("long").alias("repo_id"), F.lit("README").alias("path"), F.col("r_name").alias("content"))
    found = ci.flags(flows.unionByName(makefiles).unionByName(scripts).unionByName(plain))
    return found.withColumns({"ci_systems": F.array_join("ci_systems", ","), "ci_configs": F.array_join("ci_configs", ",")}).drop("has_deploy_pipeline")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Makefile for fifty customers: each target calls the next but one or the seventh after it, and some run a check."""
    k = F.col("c_custkey")
    rule = F.concat(F.lit("t"), k, F.lit(": FORCE\n\techo "), k, F.lit("\n\t-make t"), F.floor(k / 50) * 50 + (k * 2 + 1) % 50, F.lit("\n"), F.when(k % 5 == 0, F.concat(F.lit("\t@+time pytest tests/"), k, F.lit("\n"))).otherwise(""), F.lit("V"), k, F.lit(" := 1\n"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("repo_id", F.floor(k / 50))
    customers = customers.repartition(scans.parts(customers, customers.count(), scans.TASK_ROWS), "repo_id")
    return customers.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list(rule)), "\n").alias("content")).select("repo_id", F.lit("Makefile").alias("path"), "content")


def ci_indirection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by orders, followed three times."""
    k = F.col("o_custkey")
    calls = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(k / 50).alias("repo_id"), F.col("o_orderkey").cast("string").alias("call"), F.concat(F.lit("make FAST=1 t"), k).alias("command"))
    parts = scans.parts(calls, calls.count(), scans.TASK_ROWS)
    got = ci.opened(calls, ci.bodies(_targets(spark, sf_dir)), hops=3, parts=parts)
    # A call gives what its command does, so the places of a command meet before the calls do.
    said = got.groupBy("repo_id", "command").agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("trail", "ran"))), lambda c: c["ran"])).alias("commands"))
    return calls.repartition(parts, "repo_id", "command").join(said, ["repo_id", "command"], "left").select("repo_id", "call", "commands")


QUERIES = {q.__name__: q for q in (yaml_values, ci_commands, ci_flags, ci_indirection)}
_TURNS = """t AS (SELECT conv_id, turn, role, '.github/workflows/t' || turn || '.yml' AS path,
           coalesce(nullif(regexp_replace(trim(regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g')), '^\\s+|\\s+$', '', 'g'), ''), '-') AS text FROM conversations)"""
ORACLE = {
    "yaml_values": rf"""
    WITH {_TURNS},
    v AS (SELECT conv_id, path, unnest([
            {{'k': 'name', 'v': 'c: ' || conv_id}}, {{'k': 'on/[0]', 'v': 'push'}}, {{'k': 'on/[1]', 'v': role}}, {{'k': 'env/ROLE', 'v': role}},
            {{'k': 'jobs/t' || turn || '/steps/[0]/uses', 'v': 'actions/' || role}}, {{'k': 'jobs/t' || turn || '/steps/[0]/with/depth', 'v': CAST(turn AS VARCHAR)}},
            {{'k': 'jobs/t' || turn || '/steps/[1]/run', 'v': text || chr(10)}},
            {{'k': 'jobs/t' || turn || '/steps/[2]/run', 'v': '${{{{ env.ROLE }}}} -m pytest && poetry run mypy .'}},
            {{'k': 'jobs/t' || turn || '/steps/[3]/name', 'v': 'off'}}, {{'k': 'jobs/t' || turn || '/steps/[3]/if', 'v': 'false'}},
            {{'k': 'jobs/t' || turn || '/steps/[3]/run', 'v': 'eslint .'}},
            {{'k': 'jobs/t' || turn || '/steps/[4]/run', 'v': CASE WHEN role = 'assistant' THEN 'make -j2 check' WHEN turn % 3 = 1 THEN 'pytest -q' END}}]) AS e FROM t)
    SELECT conv_id AS repo_id, path, e.k AS keys, sha256(e.v) AS value_sha256 FROM v WHERE e.v IS NOT NULL""",
    "ci_commands": rf"""
    WITH {_TURNS},
    p AS (SELECT conv_id, path, unnest(regexp_split_to_array(text, '[\n;]|&&|\|\|')) AS command FROM t
          UNION ALL SELECT conv_id, path, unnest([role || ' -m pytest', 'mypy .', CASE WHEN role = 'assistant' THEN 'make -j2 check' WHEN turn % 3 = 1 THEN 'pytest -q' END]) FROM t),
    c AS (SELECT conv_id, path, trim(regexp_replace(command, '^\s+|\s+$', '', 'g')) AS command FROM p)
    SELECT conv_id AS repo_id, path, command, count(*) AS n FROM c WHERE command <> '' AND NOT starts_with(command, '#') GROUP BY ALL""",
    "ci_flags": """
    WITH f AS (SELECT conv_id, string_agg('.github/workflows/t' || turn || '.yml', ',' ORDER BY '.github/workflows/t' || turn || '.yml') AS configs,
                      bool_or(role <> 'assistant' AND turn % 3 = 1) AS pytest, bool_or(role = 'assistant') AS make FROM conversations GROUP BY conv_id)
    SELECT conv_id AS repo_id, 'GitHub Actions' AS ci_systems, configs AS ci_configs, pytest AS runs_tests, make AS runs_lint, true AS runs_typecheck,
           true AS ci_present, 'parsed' AS ci_analysis_method FROM f
    UNION ALL SELECT -1 - r_regionkey, '', '', false, false, false, false, 'no_ci' FROM region""",
    "ci_indirection": """
    WITH RECURSIVE line AS (
        SELECT c_custkey // 50 AS repo, 't' || c_custkey AS target, unnest([{'p': 1, 'c': 'echo ' || c_custkey}, {'p': 2, 'c': 'make t' || (c_custkey // 50 * 50 + (c_custkey * 2 + 1) % 50)},
               {'p': 3, 'c': CASE WHEN c_custkey % 5 = 0 THEN 'pytest tests/' || c_custkey END}]) AS l FROM customer),
    w AS (SELECT o_custkey // 50 AS repo, CAST(o_orderkey AS VARCHAR) AS call, CAST([] AS INTEGER[]) AS trail, 'make FAST=1 t' || o_custkey AS command, CAST([] AS VARCHAR[]) AS passed FROM orders
          UNION ALL
          SELECT w.repo, call, list_append(trail, l.p), l.c, list_append(passed, line.target) FROM w JOIN line
          ON w.repo = line.repo AND w.command LIKE 'make %' AND line.target = regexp_extract(w.command, 't[0-9]+$') AND NOT list_contains(passed, line.target)
          WHERE len(trail) < 3 AND l.c IS NOT NULL),
    hit AS (SELECT repo, call, trail FROM w WHERE command LIKE 'pytest %'),
    gone AS (SELECT DISTINCT repo, call, trail[1:n] AS trail FROM (SELECT *, unnest(range(len(trail))) AS n FROM hit) AS h)
    SELECT w.repo AS repo_id, w.call, string_agg(command, ' | ' ORDER BY w.trail) AS commands FROM w
    WHERE NOT EXISTS (SELECT 1 FROM gone AS g WHERE g.repo = w.repo AND g.call = w.call AND g.trail = w.trail) GROUP BY 1, 2""",
}
