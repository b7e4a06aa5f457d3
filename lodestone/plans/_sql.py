"""Queries written as Spark SQL over the tables of a folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def over_tables(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose {table} names are the parquet tables of the folder; only the tables it names are opened."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})

    return run


def same_sql(sql: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """The query and its DuckDB text where both engines read the same words."""
    return over_tables(sql), re.sub(r"\{(\w+)\}", r"\1", sql)
