"""Functions and decisions of sources that orders are written out as, through the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structure


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a Python or a TypeScript file, or a test; its key says how often each statement stands there."""
    k = F.col("o_orderkey")
    times = lambda text, n: F.repeat(F.lit(text), (k % n).cast("int"))
    python = F.concat(F.lit("# if\ndef a(x,\n  y):\n    if x:\n        raise E('for')\n"), times("    for y in x:\n        pass\n", 4), F.lit("    def b():\n"), times("        while x: pass\n", 3), F.lit("        return 'if'\n"))
    script = F.concat(F.lit("function a(x) {\n"), times("  if (x) { y('{'); } else { z(); } // if {\n", 4), F.lit("  const f = () => {\n"), times("    for (;;) { }\n", 3), F.lit("  };\n}\n"))
    path = F.when(k % 10 == 0, F.concat(F.lit("tests/t"), k, F.lit(".py"))).when(k % 2 == 1, F.concat(F.lit("src/m"), k, F.lit(".py"))).otherwise(F.concat(F.lit("web/c"), k, F.lit(".ts")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 50).alias("repo_id"), path.alias("path"), F.when(k % 2 == 1, python).otherwise(script).alias("content"))


def function_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.functions(_files(spark, sf_dir)).groupBy("repo_id", "path", "decisions").agg(F.count("*").alias("n"))


def structure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.structure(_files(spark, sf_dir))


def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for functions, their line items for decisions."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count("*").alias("decisions"))
    return structure.top_share(items, [], "decisions").select(F.col("top").alias("top_decisions"), F.col("total").alias("decisions"), F.col("n").alias("functions"))


QUERIES = {q.__name__: q for q in (function_decisions, structure_totals, top_share)}
_COUNTS = """
    f AS (SELECT o_custkey % 50 AS repo_id, o_orderkey AS k, o_orderkey % 4 AS a, o_orderkey % 3 AS b, o_orderkey % 2 = 1 AS python, o_orderkey % 10 = 0 AS test,
                 CASE WHEN o_orderkey % 2 = 1 THEN 'src/m' || o_orderkey || '.py' ELSE 'web/c' || o_orderkey || '.ts' END AS path FROM orders),
    d AS (SELECT repo_id, path, unnest(CASE WHEN python THEN [2 + 2 * a, 2 * b] WHEN a = 0 THEN [2 * b] ELSE [3 * a, 2 * b] END) AS decisions FROM f WHERE NOT test)"""
ORACLE = {
    "function_decisions": f"WITH {_COUNTS} SELECT repo_id, path, CAST(decisions AS BIGINT) AS decisions, count(*) AS n FROM d GROUP BY ALL",
    "structure_totals": f"""
    WITH {_COUNTS},
    s AS (SELECT repo_id, CAST(sum(CASE WHEN test THEN 0 WHEN python THEN 7 + 2 * a + b ELSE 4 + a + b END) AS BIGINT) AS prod_loc, count(*) FILTER (NOT test) AS source_files,
                 count(*) FILTER (test) AS test_files, count(*) FILTER (python) AS hits FROM f GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY decisions DESC) AS place, count(*) OVER (PARTITION BY repo_id) AS n FROM d),
    g AS (SELECT repo_id, any_value(n) AS n, sum(decisions) AS total, sum(CASE WHEN place <= greatest(1, (n + 50) // 100) THEN decisions ELSE 0 END) AS top FROM r GROUP BY 1)
    SELECT s.repo_id, prod_loc, source_files, test_files, coalesce(n, 0) AS n_functions_seen, round(CASE WHEN total > 0 THEN top / total WHEN n > 0 THEN 0 END, 4) AS decisions_gini_top1pct,
           CASE WHEN source_files > 0 THEN round(hits / greatest(prod_loc / 1000, 0.001), 3) END AS error_handling_per_kloc
    FROM s LEFT JOIN g ON s.repo_id = g.repo_id""",
    "top_share": """
    WITH v AS (SELECT l_suppkey, count(*) AS decisions FROM lineitem GROUP BY l_suppkey),
    r AS (SELECT decisions, row_number() OVER (ORDER BY decisions DESC, l_suppkey) AS place, count(*) OVER () AS n FROM v)
    SELECT CAST(sum(CASE WHEN place <= greatest(1, (n + 50) // 100) THEN decisions ELSE 0 END) AS BIGINT) AS top_decisions,
           CAST(sum(decisions) AS BIGINT) AS decisions, max(n) AS functions
    FROM r""",
}
