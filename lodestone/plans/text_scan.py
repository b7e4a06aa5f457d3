"""Sizes and shares of text files; documents stand for files, lang for language, source for repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nonblank_lines


def loc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("lang").agg(F.sum(nonblank_lines(F.col("text"))).alias("loc"), F.count("*").alias("files")).orderBy(F.desc("loc"), "lang")


QUERIES = {"loc_by_lang": loc_by_lang}
ORACLE = {
    "loc_by_lang": r"""
        SELECT lang, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))) AS BIGINT) AS loc,
               count(*) AS files
        FROM documents GROUP BY lang""",
}
