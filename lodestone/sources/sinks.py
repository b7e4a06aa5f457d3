"""Rows as text cells and files: null is an empty cell, lists and maps are compact JSON with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        column = F.map_from_entries(F.array_sort(F.map_entries(column)))
    nested = isinstance(kind, (T.MapType, T.ArrayType, T.StructType))
    return F.coalesce(F.to_json(column, {"ignoreNullFields": "false"}) if nested else column.cast("string"), F.lit(""))


def cells(df: DataFrame) -> DataFrame:
    return df.select(*(cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    cells(df).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, with nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str, place: str) -> DataFrame:
    """old with the rows of new in place of those of the same key, and the others of new after the last place of old.

    Both have the same columns; place numbers rows from 0. The result keeps the order; its places may have gaps.
    """
    fresh = new.join(old.select(key), key, "left_anti")
    kept = old.join(new.select(key), key, "left_anti")
    same = new.drop(place).join(old.select(key, place), key)
    base = old.agg(F.coalesce(F.max(place) + 1, F.lit(0)).alias("_base"))
    shifted = fresh.join(F.broadcast(base)).withColumn(place, F.col(place) + F.col("_base")).drop("_base")
    return kept.unionByName(same).unionByName(shifted)
