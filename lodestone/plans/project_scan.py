"""Workspaces, weights and places of projects, through the library's operators, over paths that orders and pages stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import projects

# What each repository's workspaces claim: every third repository excludes nothing, as its globs are all there.
_CLAIMS = [
    ("node", "", ["apps/*", "libs/a?/"]), ("node", "apps/p1", ["**"]), ("rust", "", ["crates/[a-c]*"]), ("rust", "libs", ["b1/m2", "!x"]), ("go", "apps", ["*"]),
]


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders spread roots over a repository of fifty customers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tops = F.array(*map(F.lit, ("apps", "libs", "crates", "")))
    root = F.array_join(F.filter(F.array(F.get(tops, (k % 4).cast("int")), F.when(k % 5 > 0, F.concat(F.get(F.array(*map(F.lit, "pabd")), (k % 16 / 4).cast("int")), k % 3)), F.when(k % 7 > 3, F.concat(F.lit("m"), c % 3))), lambda x: x != ""), "/")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select((c % 50).alias("repo_id"), root.alias("root"), F.get(F.array(*map(F.lit, ("node", "rust", "go"))), (F.floor(k / 8) % 3).cast("int")).alias("ecosystem")).distinct()


def workspace_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(e).alias("ecosystem"), F.lit(r).alias("root"), F.array(*map(F.lit, g)).alias("globs")) for e, r, g in _CLAIMS))
    claimed = _found(spark, sf_dir).select("repo_id").distinct().where("repo_id % 3 <> 0").select("repo_id", F.inline(rows))
    return projects.workspace_claim(_found(spark, sf_dir), claimed)


def subtree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host; a page's path stands for a file's."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/?", ""), "[?#].*$", "")
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("repo_id"), path.alias("path"))
    return projects.subtree_files(files)


def project_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's parts stand for the projects of a repository, their sizes for files."""
    key = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_brand").alias("repo_id"), F.concat(F.lit("d"), key).alias("root"), F.when(key % 3 == 0, "python").when(key % 3 == 1, "rust").otherwise("node").alias("ecosystem"),
        (key % 2 == 0).alias("workspace"), F.col("p_size").cast("long").alias("weight"),
    )
    return projects.allocated(rows, 5).where("probed").select("repo_id", "root", "ecosystem", "place")


def discovered_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of repositories that customers' numbers lay out: a workspace at the root, packages below it, a site and a crate."""
    k = F.col("c_custkey")
    n = k.cast("string")
    file = lambda path, content: F.struct(path.alias("path"), content.alias("content"))
    files = F.array(
        file(F.lit("package.json"), F.when(k % 2 == 0, '{"workspaces": {"packages": ["packages/*"]}}').otherwise('{"name": "x"}')),
        file(F.concat(F.lit("packages/p"), n, F.lit("/package.json")), F.lit("{}")), file(F.concat(F.lit("packages/p"), n, F.lit("/src/a.js")), F.lit("")),
        file(F.concat(F.lit("docs/s"), k % 3, F.lit("/pyproject.toml")), F.lit("")), file(F.lit("node_modules/q/package.json"), F.lit("{}")),
        file(F.concat(F.lit("x"), k % 4, F.lit("/Cargo.toml")), F.lit("[package]")), file(F.lit("a/b/c/d/e/go.mod"), F.lit("")),
    )
    table = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(k / 2).alias("repo_id"), F.inline(files)).groupBy("repo_id", "path").agg(F.max("content").alias("content"))
    found, _ = projects.projects(table)
    return found.withColumn("members", F.array_join("members", ","))


QUERIES = {q.__name__: q for q in (workspace_claim, subtree_files, project_allocation, discovered_projects)}
ORACLE = {
    "workspace_claim": """
    WITH f AS (SELECT DISTINCT o_custkey % 50 AS repo_id, array_to_string(list_filter([['apps', 'libs', 'crates', ''][o_orderkey % 4 + 1],
                      CASE WHEN o_orderkey % 5 > 0 THEN ['p', 'a', 'b', 'd'][o_orderkey % 16 // 4 + 1] || o_orderkey % 3 END,
                      CASE WHEN o_orderkey % 7 > 3 THEN 'm' || o_custkey % 3 END], lambda x: x <> ''), '/') AS root,
                      ['node', 'rust', 'go'][o_orderkey // 8 % 3 + 1] AS ecosystem FROM orders),
    g AS (SELECT * FROM (VALUES ('node', '', '^apps/.+$'), ('node', '', '^libs/a.(/.*)?$'), ('node', 'apps/p1', '^apps/p1/.+$'), ('rust', '', '^crates/[a-c].*$'),
                                ('rust', 'libs', '^libs/b1/m2(/.*)?$'), ('go', 'apps', '^apps/.+$')) AS t(ecosystem, owner, pattern)),
    m AS (SELECT f.*, g.owner, row_number() OVER (PARTITION BY repo_id, root, f.ecosystem ORDER BY length(g.owner) DESC) AS place
          FROM f JOIN g ON f.ecosystem = g.ecosystem AND regexp_matches(f.root, g.pattern) WHERE repo_id % 3 <> 0)
    SELECT f.repo_id, f.root, f.ecosystem, m.owner FROM f LEFT JOIN m ON f.repo_id = m.repo_id AND f.root = m.root AND f.ecosystem = m.ecosystem AND m.place = 1""",
    "subtree_files": """
    WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '[?#].*$', '') AS path FROM pages),
    d AS (SELECT repo_id, regexp_replace(path, '/?[^/]*$', '') AS dir FROM p),
    u AS (SELECT DISTINCT repo_id, array_to_string(string_split(dir, '/')[1:n], '/') AS root FROM (SELECT DISTINCT repo_id, dir, unnest(range(len(string_split(dir, '/')) + 1)) AS n FROM d) AS x)
    SELECT u.repo_id, u.root, count(*) AS files FROM u JOIN d ON u.repo_id = d.repo_id AND (u.root = '' OR d.dir = u.root OR starts_with(d.dir, u.root || '/')) GROUP BY 1, 2""",
    "project_allocation": """
    SELECT p_brand AS repo_id, 'd' || p_partkey AS root, ['python', 'rust', 'node'][p_partkey % 3 + 1] AS ecosystem,
           CAST(row_number() OVER w AS INTEGER) AS place
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size * CASE WHEN p_partkey % 3 = 1 THEN 1.0 ELSE 1.25 END DESC, p_partkey % 2, 'd' || p_partkey)
    QUALIFY row_number() OVER w <= 5""",
    "discovered_projects": """
    WITH c AS (SELECT c_custkey AS k, c_custkey // 2 AS repo_id FROM customer), r AS (SELECT repo_id, max(k % 2 = 0) AS workspace, count(*) AS n FROM c GROUP BY repo_id),
    p AS (SELECT repo_id, 0 AS d, '' AS root, 'node' AS ecosystem FROM r
          UNION SELECT repo_id, 2, 'packages/p' || k, 'node' FROM c WHERE repo_id IN (SELECT repo_id FROM r WHERE NOT workspace)
          UNION SELECT repo_id, 2, 'docs/s' || k % 3, 'python' FROM c UNION SELECT repo_id, 1, 'x' || k % 4, 'rust' FROM c)
    SELECT p.repo_id, 'p' || row_number() OVER (PARTITION BY p.repo_id ORDER BY d, root, ecosystem) AS project_id, root, ecosystem,
           CASE WHEN root = '' AND workspace THEN (SELECT string_agg('packages/p' || k, ',' ORDER BY 'packages/p' || k) FROM c WHERE c.repo_id = p.repo_id) ELSE '' END AS members,
           root = '' AND workspace AS workspace, NOT starts_with(root, 'docs') AS required,
           CASE WHEN root = '' THEN 1 + 2 * n + (SELECT count(DISTINCT k % 3) + count(DISTINCT k % 4) FROM c WHERE c.repo_id = p.repo_id) WHEN starts_with(root, 'packages') THEN 2 ELSE 1 END AS weight
    FROM p JOIN r ON p.repo_id = r.repo_id""",
}
