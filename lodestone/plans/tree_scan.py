"""Digests, lanes and reports that documents, events and orders stand for, through the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import junit
from ..operators import digest, intervals


def merkle_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("repo_id"), F.concat(F.lit("d/"), F.col("doc_id") % 7, F.lit("/"), "doc_id").alias("path"), F.col("text").alias("content"))
    return digest.tree_digest(docs)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event starts a lane of its user that lasts as long as its value and number say: whole seconds, sometimes days."""
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    long = F.when(F.col("event_id") % 50 == 0, 400_000).otherwise(600 * (F.col("event_id") % 13))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 200).alias("run"), F.col("event_id").alias("lane"), at.alias("started"), (at + long).alias("ended"))


def lane_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(_spans(spark, sf_dir), ["run"], "lane", "started", "ended", unit=3600)


def lane_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.start_order(_spans(spark, sf_dir), ["run"], "lane", "started").select("run", "lane", "place")


def junit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order stands for a report of its customer; every ninth is broken, every fourth holds several suites."""
    k = F.col("o_orderkey")
    suite = lambda n, more="": F.concat(F.lit("<testsuite name='a > b' tests=\""), n % 40, F.lit("\" failures='"), n % 3, F.lit("' "), F.when(n % 2 == 0, F.concat(F.lit('errors="'), n % 2, F.lit('" skipped="2"'))).otherwise(""), F.lit(">"), F.lit(more), F.lit("<testcase/></testsuite>"))
    one, several = suite(k, "<testsuite tests='1000'/>"), F.concat(F.lit("<?xml version='1.0'?><!-- <testsuite tests='9'> --><testsuites>"), suite(k), suite(k + 1), F.lit("</testsuites>"))
    text = F.when(k % 9 == 0, F.concat(F.lit("<testsuites>"), suite(k))).when(k % 4 == 0, several).otherwise(one)
    return junit.junit_counts(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("repo_id"), text.alias("text")))


QUERIES = {q.__name__: q for q in (merkle_digest, lane_meetings, lane_order, junit_reports)}
_SPANS = """s AS (SELECT user_id % 200 AS run, event_id AS lane, CAST(epoch(ts) AS BIGINT) AS a, CAST(epoch(ts) AS BIGINT) + CASE WHEN event_id % 50 = 0 THEN 400000 ELSE 600 * (event_id % 13) END AS b FROM events)"""
_FOLD = "sha256(string_agg(hash, '' ORDER BY k, hash))"
ORACLE = {
    "merkle_digest": f"""
    WITH p AS (SELECT source, 'd/' || doc_id % 7 || '/' || doc_id AS path, text FROM documents),
    l0 AS (SELECT source, sha256(path) AS k, sha256(path || chr(0) || coalesce(sha256(text), 'unreadable') || chr(0)) AS hash FROM p),
    l1 AS (SELECT source, left(k, 6) AS up, {_FOLD} AS hash, count(*) AS files FROM l0 GROUP BY 1, 2),
    l2 AS (SELECT source, left(k, 4) AS up, {_FOLD} AS hash, sum(files) AS files FROM (SELECT source, up AS k, hash, files FROM l1) AS x GROUP BY 1, 2),
    l3 AS (SELECT source, left(k, 2) AS up, {_FOLD} AS hash, sum(files) AS files FROM (SELECT source, up AS k, hash, files FROM l2) AS x GROUP BY 1, 2)
    SELECT source AS repo_id, {_FOLD} AS repo_digest, CAST(sum(files) AS BIGINT) AS files FROM (SELECT source, up AS k, hash, files FROM l3) AS x GROUP BY 1""",
    "lane_meetings": f"WITH {_SPANS} SELECT x.run, x.lane AS first, y.lane AS second FROM s AS x JOIN s AS y ON x.run = y.run AND x.lane < y.lane AND x.a < y.b AND y.a < x.b AND x.a < x.b AND y.a < y.b",
    "lane_order": f"WITH {_SPANS} SELECT run, lane, CAST(row_number() OVER (PARTITION BY run ORDER BY a, lane) AS INTEGER) AS place FROM s",
    "junit_reports": """
    WITH r AS (SELECT o_custkey, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [o_orderkey, o_orderkey + 1] ELSE [o_orderkey] END) AS n FROM orders WHERE o_orderkey % 9 <> 0),
    c AS (SELECT o_custkey, sum(n % 40) AS collected, sum(n % 3) AS failed, 0 AS errored, sum(CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END) AS skipped FROM r GROUP BY 1)
    SELECT o_custkey AS repo_id, CAST(collected AS BIGINT) AS collected, CAST(failed AS BIGINT) AS failed, CAST(errored AS BIGINT) AS errored, CAST(skipped AS BIGINT) AS skipped,
           CAST(greatest(0, collected - failed - errored - skipped) AS BIGINT) AS passed FROM c""",
}
