"""Closed output over the driver tables, through the library's operators; the SQL says the same in words of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import closed

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def register(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return register


@_query("""
    SELECT violation, count(*) AS n, min(doc_id) AS first_doc
    FROM (SELECT doc_id, 'n_chars: number' AS violation FROM documents WHERE n_chars < 1 OR n_chars > 50000
          UNION ALL SELECT doc_id, 'lang: enum' FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
          UNION ALL SELECT doc_id, 'source: token' FROM documents WHERE NOT regexp_full_match(source, '[a-z]{1,4}')) AS v
    GROUP BY violation""")
def enforce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"doc_id": closed.number(), "n_chars": closed.number(1, 50000), "lang": closed.choice(["en", "de", "fr"]), "source": closed.token("[a-z]{1,4}")}
    found = closed.enforce(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*fields), fields)
    each = found.select("doc_id", F.explode("violations").alias("v")).select("doc_id", F.concat_ws(": ", "v.field", "v.why").alias("violation"))
    return each.groupBy("violation").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@_query("""
    SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'other' END AS event_type,
           count(*) AS n, count(DISTINCT user_id) AS users
    FROM events GROUP BY 1""")
def fold_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"event_type": closed.choice(["view", "click", "purchase"], fold=True), "user_id": closed.number()}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*fields).fillna(closed.OTHER, ["event_type"])
    return closed.enforce(events, fields).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@_query("""
    SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS name, count(*) AS n
    FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2""")
def fold_and_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null")
    counts = events.groupBy("user_id", "event_type").count().groupBy("user_id")
    maps = counts.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("by_type"))
    out = closed.enforce(maps, {"user_id": closed.number(), "by_type": closed.tally(["click", "view"])})
    return out.select("user_id", F.explode("by_type").alias("name", "n"))


@_query("""
    SELECT o_orderkey, CASE WHEN regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+') THEN o_orderpriority ELSE '' END AS priority,
           CAST(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END AS BIGINT) AS kept
    FROM orders""")
def refused_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fields = {
        "o_orderkey": closed.number(),
        "priority": closed.prose(lambda c: F.when(~c.rlike("^[1-3]-[A-Z]+$"), "rule")),
        "status": closed.list_of(closed.choice(["F", "O"])),
    }
    rows = orders.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.array("o_orderstatus").alias("status"))
    return closed.enforce(rows, fields).select("o_orderkey", "priority", F.size("status").cast("long").alias("kept"))
