"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if pd.isna(v):
            return None
        return int(v) if hasattr(v, "__int__") and not isinstance(v, (str, pd.Timestamp)) else str(v)

    return sorted((repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_null_is_not_zero(spark):
    from lodestone.functions.text import nonblank_lines
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\n\n b\n",), ("",), (None,), ("x\r\ny\rz",)], "t string")
    assert [r[0] for r in df.select(nonblank_lines(F.col("t"))).collect()] == [2, 0, 0, 3]
    assert [r[0] for r in df.select(nonblank_lines(F.col("t"), 2)).collect()] == [2, 0, 0, 2]
