"""Sizes, refs and votes over the driver tables, through the library's operators; the SQL says the same in words of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commits, files, identity

WORDS = [("a", "tion"), ("a", "heit"), ("a", "the"), ("b", "ment"), ("b", "ing"), ("c", "eau")]


def _documents(spark: SparkSession, sf_dir: str, repo: str) -> DataFrame:
    """Documents as files of a repository: their length for lines, every seventh a test."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flag = {"is_code": F.lit(True), "is_generated": F.lit(False), "iac_kind": F.lit(None).cast("string"), "is_test": F.col("doc_id") % 7 == 0}
    return docs.select(F.col(repo).alias("repo_id"), F.col("doc_id").alias("path"), F.col("n_chars").cast("long").alias("loc"), *(c.alias(n) for n, c in flag.items()))


def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sizes(_documents(spark, sf_dir, "source")).withColumnsRenamed({"repo_id": "source"})


def largest_files_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.largest(_documents(spark, sf_dir, "lang")).withColumnsRenamed({"repo_id": "lang", "path": "doc_id", "loc": "n_chars"})


def ref_alias_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tip = F.col("s_nationkey")
    refs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        (tip % 3).alias("repo_id"), F.col("s_name").alias("ref"), F.when(tip % 2 == 0, "tag").otherwise("commit").alias("object_type"),
        tip.alias("sha"), F.when(tip % 4 == 0, tip + 100).alias("peeled_sha"), (tip * 7 % 11).alias("commits"),
    )
    return commits.collapsed_refs(refs, 5)


def industry_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.col("text").contains(w), F.struct(F.lit(i).alias("industry"), F.lit(w).alias("word"))) for i, w in WORDS)))
    votes = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("repo_id"), F.col("lang").alias("source"), F.inline(found))
    return identity.industry(votes).select("repo_id", "industry")


QUERIES = {q.__name__: q for q in (size_distribution, largest_files_topk, ref_alias_collapse, industry_vote)}
ORACLE = {
    "size_distribution": """
    SELECT source, count(*) AS files, list_sort(list(n_chars))[count(*) // 2 + 1] AS median_loc,
           list_sort(list(n_chars))[CAST(floor(count(*) * CAST(0.9 AS DOUBLE)) AS BIGINT) + 1] AS p90_loc,
           count(*) FILTER (n_chars > 500) AS over_500, count(*) FILTER (n_chars > 1000) AS over_1000, count(*) FILTER (doc_id % 7 <> 0) AS non_test
    FROM documents WHERE n_chars > 0 GROUP BY source""",
    "largest_files_topk": """
    SELECT lang, doc_id, n_chars, place
    FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE n_chars > 0) AS r
    WHERE place <= 10""",
    "ref_alias_collapse": """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, ref) AS place
                   FROM (SELECT s_nationkey % 3 AS repo_id, CASE WHEN s_nationkey % 4 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS tip,
                                min(s_name) AS ref, count(*) AS names, s_nationkey * 7 % 11 AS commits
                         FROM supplier GROUP BY s_nationkey) AS t) AS r
    WHERE place <= 5""",
    "industry_vote": """
    WITH w AS (SELECT * FROM (VALUES ('a', 'tion'), ('a', 'heit'), ('a', 'the'), ('b', 'ment'), ('b', 'ing'), ('c', 'eau')) AS t(industry, word)),
    v AS (SELECT DISTINCT source AS repo_id, lang, industry, word FROM documents JOIN w ON contains(text, word) WHERE lang IS NOT NULL),
    c AS (SELECT repo_id, industry, count(*) AS votes, max(count(*)) OVER (PARTITION BY repo_id) AS most FROM v GROUP BY 1, 2)
    SELECT repo_id, min(industry) AS industry FROM c WHERE votes = most AND votes >= 2 GROUP BY repo_id HAVING count(*) = 1""",
}
