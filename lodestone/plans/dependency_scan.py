"""Names and keyword groups over parts, through the library's operators; the SQL says the same in words of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dependencies

# A part stands for a dependency, its brand for the repository, its type for the ecosystem.
KEYWORDS = [("sizes", "any", "cold"), ("sizes", "any", "small"), ("makes", "PROMO", "large"), ("makes", "any", "bol*"), ("nothing", "any", "zzzz")]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = dependencies.dep_name(F.concat(F.lit(' "'), F.translate("p_name", " ", "."), F.lit('_X/" ')))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("repo_id"), F.col("p_type").alias("ecosystem"), name.alias("name"))


def dep_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).groupBy("repo_id", "name").agg(F.count("*").alias("n"))


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = dependencies.keyword_hits(_parts(spark, sf_dir), KEYWORDS)
    return hits.select("repo_id", "keyword_group", F.concat_ws(",", "hits").alias("hits"))


QUERIES = {"dep_names": dep_names, "keyword_hits": keyword_hits}
ORACLE = {
    "dep_names": "SELECT p_brand AS repo_id, lower(replace(p_name, ' ', '.')) || '-x' AS name, count(*) AS n FROM part GROUP BY 1, 2",
    "keyword_hits": """
    WITH s AS (SELECT p_brand AS repo_id, p_type AS ecosystem, unnest(string_split(lower(p_name) || '-x', ' ')) AS segment FROM part),
         k AS (SELECT * FROM (VALUES ('sizes', 'any', 'cold'), ('sizes', 'any', 'small'), ('makes', 'PROMO', 'large'),
                                     ('makes', 'any', 'bol*'), ('nothing', 'any', 'zzzz')) AS t(keyword_group, eco, keyword)),
         h AS (SELECT DISTINCT repo_id, keyword_group, rtrim(keyword, '*') AS keyword FROM s JOIN k
               ON (eco = 'any' OR eco = ecosystem) AND (segment = keyword OR keyword LIKE '%*' AND starts_with(segment, rtrim(keyword, '*'))))
    SELECT r.repo_id, g.keyword_group, coalesce(string_agg(h.keyword, ',' ORDER BY h.keyword), '') AS hits
    FROM (SELECT DISTINCT p_brand AS repo_id FROM part) AS r CROSS JOIN (SELECT DISTINCT keyword_group FROM k) AS g
    LEFT JOIN h ON h.repo_id = r.repo_id AND h.keyword_group = g.keyword_group GROUP BY 1, 2""",
}
